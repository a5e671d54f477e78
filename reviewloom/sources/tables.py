"""Reading source trees, reports and compare payloads; appending reviews; exporting reports."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import schemas


def spread(frame: DataFrame) -> DataFrame:
    """Deals rows out to all cores when the input has fewer splits than the cluster has cores.

    For costly row-local work over a few unsplittable files; an input with enough splits
    is returned unchanged.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def _plain_path(root: str) -> str:
    """The path part of a folder name, without scheme, authority or a slash at the end."""
    path = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root)
    return (path if path != root or root.startswith("/") else os.path.abspath(root)).rstrip("/")


def _escaped(root: str) -> str:
    """A folder name whose characters are all meant literally, not as a file pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", root)


def _below(uri: Column, root: str) -> Column:
    """The decoded path of a file below ``root``, cut off as a plain prefix."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(decoded, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.substring(path, F.lit(len(_plain_path(root)) + 2), F.length(path))


def read_source_tree(spark: SparkSession, root: str, repo_depth: int = 1) -> DataFrame:
    """``repo_id, path, content`` of unpacked repositories below ``root``.

    The first ``repo_depth`` directories below the root name the repository. A file that
    cannot be read fails the job rather than being left out without a trace.
    """
    files = (
        spark.read.text(_escaped(root), wholetext=True, recursiveFileLookup=True)
        .select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("uri"))
    )
    inner = _below(F.col("uri"), root)
    repo = F.array_join(F.slice(F.split(inner, "/"), 1, repo_depth), "/")
    return files.select(
        repo.alias("repo_id"),
        F.substring(inner, F.length(repo) + 2, F.length(inner)).alias("path"),
        "content",
    )


def read_lint_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored lint reports (parquet, best partitioned by ``linter``)."""
    return spark.read.schema(schemas.LINT_REPORT).parquet(path)


def read_lint_report_files(spark: SparkSession, root: str, checkout_root: str) -> DataFrame:
    """Raw report files laid out as ``<root>/<linter>/<repo_id>.<suffix>``; the id may hold slashes."""
    rows = (
        spark.read.text(_escaped(root), wholetext=True, recursiveFileLookup=True)
        .select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("uri"))
    )
    inner = _below(F.col("uri"), root)
    name = F.substring(inner, F.length(F.substring_index(inner, "/", 1)) + 2, F.length(inner))
    repo = F.regexp_replace(name, r"\.[^./]*\z", "")
    return rows.select(
        repo.alias("repo_id"), F.substring_index(inner, "/", 1).alias("linter"),
        F.concat(F.lit(checkout_root.rstrip("/") + "/"), repo).alias("root"), "payload",
    )


def read_compares(spark: SparkSession, path: str) -> DataFrame:
    """Compare payloads stored as JSON lines."""
    return spark.read.schema(
        "repo_id string, review_id string, base_sha string, head_sha string, payload string"
    ).json(path)


def read_repositories(spark: SparkSession, path: str, user_id: str | None = None) -> DataFrame:
    """Repository registry; the user filter reaches the parquet scan."""
    table = spark.read.schema(schemas.REPOSITORY).parquet(path)
    return table if user_id is None else table.where(F.col("user_id") == user_id)


def append_reviews(reviews: DataFrame, path: str) -> None:
    """Append-only write, partitioned by the month of the review."""
    (
        reviews.withColumn("month", F.date_format("created_at", "yyyy-MM"))
        .write.mode("append").partitionBy("month").parquet(path)
    )


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REVIEW + ", month string").parquet(path).drop("month")


def append_repositories(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def report_json(reports: DataFrame) -> DataFrame:
    """Report headers as one JSON document per row."""
    return reports.select("review_id", F.to_json(F.struct(*reports.columns)).alias("json"))


def issue_json(issues: DataFrame, rows_per_part: int = 1000) -> DataFrame:
    """Issue lists as nested JSON, in parts of at most ``rows_per_part`` positions each.

    Positions are unique per review: ``list_pos`` of a merged list (see
    ``merge.with_list_position``), else ``seq``. So no collected list can exceed that size;
    the parts sorted by ``part`` are the whole list.
    """
    position = "list_pos" if "list_pos" in issues.columns else "seq"
    body = [c for c in issues.columns if c not in ("review_id", "repo_id", "origin", position)]
    part = F.floor(F.col(position) / rows_per_part).alias("part")
    return (
        issues.groupBy("review_id", part)
        .agg(F.sort_array(F.collect_list(F.struct(position, *body))).alias("issues"))
        .select("review_id", "part", F.to_json(F.struct("review_id", "part", "issues")).alias("json"))
    )


def export_json(reports: DataFrame, path: str) -> None:
    reports.write.mode("errorifexists").json(path)
