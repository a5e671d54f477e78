"""Operators over the findings table (lint findings or issues)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.functions.severity import severity_rank
from reviewloom.operators.ranking import top_k

# How much of a findings table reaches a prompt or a fix.
PROMPT_ISSUES = 60
PROMPT_FILES = 20
FIX_ISSUES = 10
FIX_FILES = 6


def union_findings(*tables: DataFrame) -> DataFrame:
    """All findings of several tools as one table."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def worst_first(table: DataFrame) -> list[Column]:
    """Stable severity order of a list.

    Lint findings are listed file by file (see :func:`findings_by_file`, which adds
    ``file_order``); merged lists by ``list_pos``; other issue lists by ``seq`` alone.
    """
    if "file_order" in table.columns:
        position = ["file_order", "file", "seq"]
    else:
        position = ["list_pos"] if "list_pos" in table.columns else ["seq", "file"]
    return [severity_rank(F.col("severity")), *[F.col(c) for c in position], F.col("message")]


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n"))


def total_findings(findings: DataFrame, *keys: str) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))


def top_findings(findings: DataFrame, limit: int = PROMPT_ISSUES) -> DataFrame:
    """Worst findings per review with their position in the list."""
    return top_k(findings, ["review_id"], worst_first(findings), limit, "rank")


def first_files(top: DataFrame, limit: int) -> DataFrame:
    """Rows of a top list whose file is among the first distinct files of that list.

    Adds ``file_rank``. A top list is bounded per review, so both windows are.
    """
    per_file = Window.partitionBy("review_id", "file")
    per_review = Window.partitionBy("review_id").orderBy("first_rank")
    return (
        top.withColumn("first_rank", F.min("rank").over(per_file))
        .withColumn("file_rank", F.dense_rank().over(per_review))
        .where(F.col("file_rank") <= limit)
        .drop("first_rank")
    )


def first_file_list(top: DataFrame, limit: int) -> DataFrame:
    """``review_id, file, file_rank``: the first distinct files of a top list, without its rows."""
    firsts = top.groupBy("review_id", "file").agg(F.min("rank").alias("first_rank"))
    return top_k(firsts, ["review_id"], [F.col("first_rank")], limit, "file_rank").drop("first_rank")


def prompt_findings(
    findings: DataFrame, issues: int = PROMPT_ISSUES, files: int = PROMPT_FILES
) -> DataFrame:
    """Worst lint findings of the first files; list order is file by file."""
    return first_files(top_findings(findings_by_file(findings), issues), files)


def fix_issues(issues: DataFrame, limit: int = FIX_ISSUES) -> DataFrame:
    """Issues handed to a fix pass, worst first."""
    return top_findings(issues, limit)


def fix_files(
    issues: DataFrame, limit: int = FIX_ISSUES, files: int = FIX_FILES
) -> DataFrame:
    """Distinct files of the fix list in order of appearance, capped before any content join."""
    return first_file_list(fix_issues(issues, limit), files)


def distinct_files(findings: DataFrame) -> DataFrame:
    """Distinct files of each list; ``file_order`` sorts them by first appearance."""
    return findings.groupBy("review_id", "file").agg(
        F.min("seq").alias("file_order"), F.count(F.lit(1)).alias("n")
    )


def findings_by_file(findings: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Findings with the columns that order them file by file.

    ``listed`` are their :func:`distinct_files` where a caller has them; findings of other
    files are left out then.

    Sorting by ``(review_id, file_order, file, rank of severity, seq)`` gives the grouped view;
    nothing is collected, so one file may own any share of the rows.
    """
    order = (distinct_files(findings) if listed is None else listed).select("review_id", "file", "file_order")
    return findings.join(order, ["review_id", "file"])


def files_with_findings(findings: DataFrame, *keys: str) -> DataFrame:
    """Number of distinct files with findings per key, in two combinable steps."""
    return (
        findings.select(*keys, "file").distinct().groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("files"))
    )
