"""Linter run log: fault classification, counts and status text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failure_reason(error_code: Column, error_name: Column) -> Column:
    return (
        F.when(error_code == "ENOENT", "binary_not_found")
        .when((error_name == "SyntaxError") | (error_code == "ERR_INVALID_ARG_TYPE"), "parse_error")
        .otherwise("runtime_error")
    )


def classify_runs(log: DataFrame) -> DataFrame:
    """``repo_id, linter, ran, error_code, error_name, error_message`` to status rows.

    A failed tool becomes a ``failed`` row without findings; nothing is raised.
    """
    failed = F.coalesce("error_code", "error_name", "error_message").isNotNull()
    reason = F.when(failed, failure_reason(
        F.coalesce("error_code", F.lit("")), F.coalesce("error_name", F.lit(""))
    ))
    # The text of a missing tool.
    missing = F.concat(
        F.col("linter"), F.lit(" binary not found. Install it on the server to enable "),
        F.col("linter"), F.lit(" linting."),
    )
    return log.select(
        "repo_id", "linter",
        F.when(~F.col("ran"), "skipped").when(failed, "failed").otherwise("success").alias("status"),
        F.when(F.col("ran") & (reason == "binary_not_found"), missing)
        .when(F.col("ran") & failed, F.coalesce("error_message", F.lit("")))
        .alias("error"),
        F.when(F.col("ran"), reason).alias("reason"),
    )


def with_counts(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Issue and file counts of every run over the whole checkout.

    Counting per file first keeps the distinct count of files combinable.
    """
    per_file = findings.groupBy("repo_id", "linter", "file").agg(F.count(F.lit(1)).alias("n"))
    counts = per_file.groupBy("repo_id", "linter").agg(
        F.sum("n").alias("issue_count"), F.count(F.lit(1)).alias("files_with_issues")
    )
    return runs.join(counts, ["repo_id", "linter"], "left").fillna(
        0, ["issue_count", "files_with_issues"]
    )


def status_text() -> Column:
    """Display text of a run row with ``status, reason, issue_count``."""
    n = F.col("issue_count")
    # The display texts.
    return (
        F.when(
            F.col("status") == "success",
            F.when(n == 0, "Clean").when(n == 1, "1 issue").otherwise(
                F.concat(n.cast("string"), F.lit(" issues"))
            ),
        )
        .when(
            F.col("status") == "failed",
            F.when(F.col("reason") == "binary_not_found", "Not installed on this server")
            .otherwise("Did not run"),
        )
        .otherwise("Skipped — no matching files")
    )


def results_of_successful(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings whose run succeeded; the rest of a repository is unaffected."""
    good = runs.where(F.col("status") == "success").select("repo_id", "linter")
    return findings.join(good, ["repo_id", "linter"], "left_semi")
