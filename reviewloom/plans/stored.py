"""The lint stage of a review job as written tables, with scans shared between files and jobs.

Scans look at content alone, so they are stored by the digest of the content and the version
of the rules: equal files are scanned once, and a later job scans only contents that no job
before it has met. A job reads its files twice, once to list them with their digests and once
for the contents that are new; everything later reads written tables.

The tables of one job are in a folder of their own below ``runs``. They are not bucketed by
repository: a hot repository would be one bucket, and so one task of every later read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.functions.paths import base_name
from reviewloom.operators import files as fl, scan
from reviewloom.plans.review import LintStage, staged_tables
from reviewloom.session import discard, exists

_CONTENTS = "digest string, version string, batch string"
_HITS = (
    _CONTENTS + ", kind string, line int, `column` int, seq bigint, severity string, message string, rule_id string, "
    "label string, match_preview string"
)
_TABLES = ("secrets", "gate", "detections", "plan", "runs", "findings")
_SECRET, _DATABASE = "secret", "database"


def rules_version() -> str:
    """Changes with any rule, so that contents are scanned again."""
    rules = (scan.SECRET_RULES, scan.MONGO_RULES, scan.MONGO_IMPORTS, scan.PREFER_LEAN, scan.LEAN_CALL, scan.LEAN_WINDOW)
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _hits(contents: DataFrame) -> DataFrame:
    """Everything the scans find in ``digest, content``, whatever the file is called."""
    files = contents.select(F.col("digest").alias("repo_id"), F.lit("content").alias("path"), "content")
    none = F.lit(None).cast("string")
    secrets = scan.scan_secrets(files).select(
        F.col("repo_id").alias("digest"), F.lit(_SECRET).alias("kind"), "line", F.lit(None).cast("int").alias("column"),
        F.lit(None).cast("bigint").alias("seq"), none.alias("severity"), none.alias("message"),
        F.col("pattern_id").alias("rule_id"), "label", "match_preview")
    usage = scan.analyze_database_usage(files).select(
        F.col("repo_id").alias("digest"), F.lit(_DATABASE).alias("kind"), "line", "column", "seq", "severity",
        "message", "rule_id", none.alias("label"), none.alias("match_preview"))
    return secrets.unionByName(usage)


def scan_new_contents(files: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """All stored hits of this version, after scanning the contents of ``listing`` that have none yet.

    ``path`` keeps two tables: ``hits``, and ``contents`` with the digests that were scanned.
    A batch counts once its digests are in ``contents``, which are written last, so a job that
    dies in between leaves hits that nobody reads. ``repo_id, path`` name one row of ``files``.
    """
    spark = files.sparkSession
    version, batch = rules_version(), uuid.uuid4().hex
    known = _stored(spark, f"{path}/contents", _CONTENTS).where(F.col("version") == version)
    new = listing.join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(
        F.min(F.struct("repo_id", "path")).alias("at"))
    work = f"{path}/work-{batch}"
    new.select("digest", "at.*").write.parquet(f"{work}/new")
    new = spark.read.parquet(f"{work}/new")
    if not new.isEmpty():
        digested = files.select("repo_id", "path", "content", _digest().alias("digest"))
        digested.join(new, ["repo_id", "path", "digest"], "left_semi").select("digest", "content").write.parquet(
            f"{work}/contents")
        marks = {"version": F.lit(version), "batch": F.lit(batch)}
        hits = _hits(spark.read.parquet(f"{work}/contents")).withColumns(marks)
        hits.write.mode("append").parquet(f"{path}/hits")
        new.select("digest").withColumns(marks).write.mode("append").parquet(f"{path}/contents")
    discard(spark, work)
    done = _stored(spark, f"{path}/contents", _CONTENTS).where(F.col("version") == version)
    found = _stored(spark, f"{path}/hits", _HITS).where(F.col("version") == version)
    # Two jobs at a time may scan the same content; one of the batches counts.
    counted = done.groupBy("digest").agg(F.min("batch").alias("batch"))
    return found.join(counted, ["digest", "batch"], "left_semi")


def _digest():
    return F.sha2(F.coalesce("content", F.lit("")), 256)


def stored_lint_stage(
    spark: SparkSession, files: DataFrame, reports: DataFrame, run_log: DataFrame, path: str, run: str | None = None,
) -> LintStage:
    """The same tables as ``review.lint_stage``, written below ``path`` and read back.

    ``path`` is shared by jobs that may reuse each other's scans; ``run`` names the folder of
    this one (see :func:`read_lint_stage`).
    """
    folder = f"{path}/runs/{run or uuid.uuid4().hex}"

    def keep(name: str, table: DataFrame) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    listing = keep("listing", files.select("repo_id", "path", _digest().alias("digest")))
    hits = scan_new_contents(files, listing, path)
    scanned = listing.where(~base_name(F.col("path")).isin(*scan.SECRET_SKIPPED_FILES))
    columns = ("repo_id", "path", "line", "pattern_id", "label", "match_preview")
    inside = scanned.join(hits.where(F.col("kind") == _SECRET), "digest").withColumnRenamed("rule_id", "pattern_id")
    # A committed env file is a finding by its name; its content was looked at above.
    by_name = scan.scan_secrets(scanned.withColumn("content", F.lit("")))

    def analyzed(open_files: DataFrame) -> DataFrame:
        code = fl.walkable(open_files, scan.MONGO_EXTENSIONS, None)
        return code.join(hits.where(F.col("kind") == _DATABASE), "digest").select(
            "repo_id", F.lit(scan.ANALYZER).alias("linter"), F.col("path").alias("file"), "seq", "line", "column",
            "severity", "message", "rule_id", F.lit(scan.ANALYZER).alias("source"))

    secrets = inside.select(*columns).unionByName(by_name.select(*columns))
    return staged_tables(spark, secrets, listing, analyzed, reports, run_log, keep)


def read_lint_stage(spark: SparkSession, path: str, run: str) -> LintStage:
    """The tables that an earlier job wrote."""
    return LintStage(**{name: spark.read.parquet(f"{path}/runs/{run}/{name}") for name in _TABLES})
