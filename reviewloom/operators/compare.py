"""Changed files from compare payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.json_values import computed_once, one_value
from reviewloom.schemas import COMPARE_PAYLOAD


def _same(payload: Column) -> Column:
    return (F.col("base_sha") == F.col("head_sha")) | (
        F.coalesce(payload["status"], F.lit("")) == "identical"
    )


def _parsed(compares: DataFrame) -> DataFrame:
    """Payloads that are exactly one JSON value, parsed once; ``p`` is null for others."""
    return computed_once(compares, "p", one_value(F.col("payload"), COMPARE_PAYLOAD))


def changed_files(compares: DataFrame) -> DataFrame:
    """One row per changed file of ``repo_id, review_id, base_sha, head_sha, payload``.

    Equal shas and identical comparisons give no rows.
    """
    rows = _parsed(compares).where(~_same(F.col("p")))
    return rows.select(
        "repo_id", "review_id", F.posexplode("p.files").alias("file_no", "f")
    ).select("repo_id", "review_id", "file_no", "f.*")


def compare_summary(compares: DataFrame) -> DataFrame:
    """Commit counts of each comparison, zero where nothing differs."""
    p = F.col("p")

    def count(name: str) -> Column:
        return F.when(_same(p), 0).otherwise(F.coalesce(p[name], F.lit(0)))

    return _parsed(compares).select(
        "review_id",
        count("total_commits").alias("total_commits"),
        count("ahead_by").alias("ahead_by"),
        F.coalesce(p["behind_by"], F.lit(0)).alias("behind_by"),
    )


def change_totals(changes: DataFrame) -> DataFrame:
    """Files, added and deleted lines per review and change status."""
    return changes.groupBy("review_id", "status").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.col("additions").cast("bigint")).alias("additions"),
        F.sum(F.col("deletions").cast("bigint")).alias("deletions"),
    )
