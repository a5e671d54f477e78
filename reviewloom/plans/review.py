"""Review jobs over many repositories: admission, full, incremental and unchanged reviews."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions import urls as U
from reviewloom.operators import eligibility, files as fl, languages as lang, merge, runs as rn, scan
from reviewloom.operators.lint_reports import normalize_lint_reports
from reviewloom.operators.ranking import numbered
from reviewloom.operators.responses import parse_issues, parse_reviews
from reviewloom.plans.prompts import full_prompts, incremental_prompts

# Text of a review without changes.
UNCHANGED_SUMMARY = "No changes since the last review."


def admit(requests: DataFrame, metadata: DataFrame, gate: DataFrame | None = None) -> DataFrame:
    """Requests (``repo_id, review_id, repo_url``) with the first reason to refuse them.

    Checks run cheapest first: URL, metadata rules, download size, secrets. Refused
    requests keep their row with ``error_code`` instead of failing the job.
    """
    checked = requests.join(eligibility.check_eligibility(metadata), "repo_id", "left")
    size = F.col("size_kb") > eligibility.SIZE_LIMIT_KB
    code = F.coalesce(
        U.preflight_error(F.col("repo_url")),
        U.url_error(F.col("repo_url")),
        F.when(F.col("http_status").isNull(), "REPO_NOT_FOUND"),
        F.col("eligibility_code"),
        F.when(size, "REPO_TOO_LARGE"),
    )
    if gate is not None:
        blocked = gate.select("repo_id", F.col("code").alias("gate_code"))
        checked = checked.join(blocked, "repo_id", "left")
        code = F.coalesce(code, F.col("gate_code"))
    return checked.select(
        *requests.columns, F.col("default_branch"), F.col("warnings"), code.alias("error_code")
    )


@dataclass
class LintStage:
    """Tables of the lint stage, all keyed by ``repo_id``."""

    secrets: DataFrame
    gate: DataFrame
    detections: DataFrame
    plan: DataFrame
    runs: DataFrame
    findings: DataFrame


def lint_stage(
    spark: SparkSession, files: DataFrame, reports: DataFrame, run_log: DataFrame
) -> LintStage:
    """Secret gate, language detection, linter plan, run status and all findings.

    Reports and runs outside the plan are ignored; a failed run has no findings. The tables
    are lazy; ``stored.stored_lint_stage`` writes each of them once.
    """
    def analyzed(open_files: DataFrame) -> DataFrame:
        return scan.analyze_database_usage(fl.walk_with_content(open_files, scan.MONGO_EXTENSIONS))

    return staged_tables(spark, scan.scan_secrets(files), files, analyzed, reports, run_log)


def staged_tables(
    spark: SparkSession, secrets: DataFrame, files: DataFrame, analyzed: Callable[[DataFrame], DataFrame],
    reports: DataFrame, run_log: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = lambda name, table: table,
) -> LintStage:
    """The lint stage from secrets, a listing, and a function from admitted files to analyzer
    findings; ``keep`` gets each table once, by name, and returns what later steps read."""
    secrets = keep("secrets", secrets)
    gate = keep("gate", scan.secret_gate(secrets))
    open_files = scan.without_blocked(files, gate)
    detections = keep("detections", lang.detect_languages(open_files))
    plan = keep("plan", lang.linter_plan(detections, lang.registry_table(spark)))
    statuses = rn.classify_runs(run_log)
    analyzer = plan.where(F.col("linter") == scan.ANALYZER).select(
        "repo_id", "linter", F.lit("success").alias("status"),
        F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("reason"),
    )
    planned = plan.select("repo_id", "linter", "registry_pos")
    statuses = keep("statuses", (
        statuses.where(F.col("linter") != scan.ANALYZER).unionByName(analyzer)
        .join(planned, ["repo_id", "linter"])
    ))
    if "report_pos" not in reports.columns:
        reports = reports.withColumn("report_pos", F.lit(0))
    # Reports that no run of the plan stands behind are left out unparsed.
    reported = normalize_lint_reports(rn.results_of_successful(reports, statuses)).unionByName(
        analyzed(open_files).withColumn("report_pos", F.lit(0)))
    findings = keep("findings", rn.results_of_successful(reported, statuses))
    runs = keep("runs", rn.with_counts(statuses, findings))
    return LintStage(secrets, gate, detections, plan, runs, findings)


def full_review_prompts(admitted: DataFrame, stage: LintStage) -> DataFrame:
    """Prompts of admitted full reviews (``review_id, repo_id, repo_url, warnings``)."""
    reviews = admitted.where(F.col("error_code").isNull()).withColumn(
        "notices", F.array().cast("array<string>")
    )
    keys = reviews.select("review_id", "repo_id")

    def keyed(table: DataFrame) -> DataFrame:
        return table.join(keys, "repo_id")

    findings = with_list_position(keyed(stage.findings))
    return full_prompts(reviews, findings, keyed(stage.runs), keyed(stage.detections))


def with_list_position(findings: DataFrame) -> DataFrame:
    """One ``seq`` across all linters of a review: registry order, then the order of a tool's
    reports, then that of each report."""
    names = [entry[1] for entry in lang.REGISTRY]
    linter = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("linter"))
    placed = findings.withColumn("linter_pos", linter)
    order = ["linter_pos", "report_pos", "seq", "file", "line", "rule_id", "message"]
    numbers = numbered(placed, ["review_id"], order, F.struct("linter_pos", "report_pos"), "list_no")
    return numbers.withColumn("seq", F.col("list_no")).drop("linter_pos", "list_no")


def incremental_review_prompts(
    admitted: DataFrame, stage: LintStage, changes: DataFrame
) -> DataFrame:
    """Diff prompts of admitted incremental reviews; lint rows are cut to changed files."""
    reviews = admitted.where(F.col("error_code").isNull())
    keys = reviews.select("review_id", "repo_id")
    findings = with_list_position(stage.findings.join(keys, "repo_id"))
    return incremental_prompts(reviews, changes, findings)


def merged_issues(
    responses: DataFrame, modes: DataFrame, previous: DataFrame, changes: DataFrame
) -> DataFrame:
    """Issue lists after parsing: full reviews keep the new list, incremental ones merge it
    into the previous list, unchanged ones keep the previous list.

    ``responses`` has ``review_id, repo_id, text``; ``modes`` has ``repo_id, review_id, mode``;
    ``changes`` is keyed by ``review_id`` and ``previous`` by ``repo_id``, of which every
    review of the repository takes the whole list. ``list_pos`` orders each merged list; a
    ``list_pos`` of ``previous`` is its order, else its ``seq``.
    """
    new = parse_issues(responses, "review_id", "repo_id")
    columns = new.columns

    def of_mode(table: DataFrame, mode: str, keys: list[str]) -> DataFrame:
        return table.join(modes.where(F.col("mode") == mode).select(*keys), keys, "left_semi")

    full = of_mode(new, "full", ["review_id"]).withColumn("origin", F.lit(1))
    if "list_pos" in previous.columns:
        previous = previous.withColumn("seq", F.col("list_pos"))
    stored = previous.drop("review_id").join(
        modes.where(F.col("mode") != "full").select("repo_id", "review_id"), "repo_id"
    ).select(*columns)
    incremental = merge.merge_round(
        of_mode(stored, "incremental", ["review_id"]),
        of_mode(new, "incremental", ["review_id"]),
        of_mode(changes, "incremental", ["review_id"]),
        key="review_id",
    )
    kept = of_mode(stored, "unchanged", ["review_id"]).withColumn("origin", F.lit(0))
    return merge.with_list_position(full.unionByName(incremental).unionByName(kept))


def unchanged_reports(requests: DataFrame, previous_issues: DataFrame) -> DataFrame:
    """Reports of requests whose head equals the base: previous issues, no score, no work."""
    counts = previous_issues.groupBy("repo_id").agg(F.count(F.lit(1)).alias("issue_count"))
    unchanged = requests.where(F.col("mode") == "unchanged").join(counts, "repo_id", "left")
    count = F.coalesce("issue_count", F.lit(0).cast("bigint"))
    return unchanged.select(
        "repo_id", "review_id", F.lit("incremental").alias("mode"), "base_sha", "head_sha",
        F.lit(UNCHANGED_SUMMARY).alias("summary"), F.lit(None).cast("int").alias("score"),
        count.alias("issue_count"), count.alias("lint_issues_found"),
        F.lit(False).alias("pr_opened"),
    )


def assemble_reports(
    reviews: DataFrame,
    responses: DataFrame,
    issues: DataFrame,
    lint_totals: DataFrame,
    runs: DataFrame,
    languages: DataFrame,
    changes: DataFrame,
    outcomes: DataFrame,
    generated_at: str,
) -> DataFrame:
    """One report header per review.

    Unbounded lists (issues, changed files) stay in their own tables keyed by
    ``review_id`` and appear here as counts; languages and runs are bounded by the
    registry and are nested.
    """
    # The join moves answers to their review anyway: moved before the parse, it runs in as many tasks.
    parsed = parse_reviews(responses.repartition("review_id")).where(F.col("parse_error").isNull()).select(
        "review_id", "provider_used", "summary", "score"
    )

    # All counts in one keyed aggregate, so the headers meet them in one join.
    names = ("issue_count", "changed_file_count", "lint_issues_found")

    def share(table: DataFrame, into: str, n: Column) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return table.select(
            "review_id", *[(n.cast("bigint") if name == into else zero).alias(name) for name in names]
        )

    counts = (
        share(issues, "issue_count", F.lit(1))
        .unionByName(share(changes, "changed_file_count", F.lit(1)))
        .unionByName(share(lint_totals, "lint_issues_found", F.col("total")))
        .groupBy("review_id").agg(*[F.sum(name).alias(name) for name in names])
    )
    run_list = runs.groupBy("review_id").agg(
        F.transform(
            F.sort_array(
                F.collect_list(
                    F.struct("registry_pos", "linter", "status", "issue_count", "reason")
                )
            ),
            lambda r: F.struct(r["linter"], r["status"], r["issue_count"], r["reason"]),
        ).alias("linter_runs")
    )
    language_list = languages.groupBy("review_id").agg(
        F.sort_array(F.collect_list(F.struct("registry_pos", "language")))
        .getField("language").alias("languages")
    )
    headers = reviews.select(
        "review_id", "repo_id", "repo_url", "default_branch", "mode", "base_sha", "head_sha",
        "warnings",
    )
    report = (
        headers.join(parsed, "review_id")
        .join(counts, "review_id", "left")
        .join(run_list, "review_id", "left")
        .join(language_list, "review_id", "left")
        .join(outcomes, "review_id", "left")
        .fillna(0, list(names))
    )
    return report.select(
        "review_id", "repo_id", "repo_url", "default_branch", "mode", "base_sha", "head_sha",
        "languages", "provider_used", "summary", "score", "issue_count",
        F.lit(0).alias("secrets_found"), F.col("warnings").alias("validation_warnings"),
        "lint_issues_found", "linter_runs", "changed_file_count",
        F.coalesce("ready", F.lit(False)).alias("pr_ready"), F.col("outcome").alias("pr_reason"),
        F.lit(generated_at).alias("generated_at"),
    )


def persisted_reviews(reports: DataFrame, previous_scores: DataFrame) -> DataFrame:
    """The stored subset of a report; a missing score takes the previous one, else zero."""
    previous = previous_scores.select("repo_id", "previous_score")
    return reports.join(previous, "repo_id", "left").select(
        "review_id", "repo_id", "mode", "base_sha", "head_sha",
        F.col("default_branch").alias("branch"),
        F.coalesce("score", "previous_score", F.lit(0)).alias("score"), "summary",
        F.col("pr_ready").alias("pr_created"),
        F.lit(None).cast("string").alias("pr_url"), F.lit(None).cast("int").alias("pr_number"),
        F.col("generated_at").cast("timestamp").alias("created_at"),
    )
