"""What steps leave on disk while a query goes on, and how often they move rows."""

import os

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import timeline
from reviewloom.operators.parts import byte_parts
from reviewloom.plans import prompts
from reviewloom.session import staged
from reviewloom.streaming import open_issues as stream

ROUND = "repo_id int, review_id bigint, created_at timestamp, mode string"
ISSUE = "review_id bigint, seq bigint, file string, line int, severity string, category string, message string"
CHANGE = "review_id bigint, filename string, previous_filename string, status string"


@pytest.fixture
def shuffled(spark):
    """Bytes of shuffle files on the disk since the test began."""

    def total():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        paths = [os.path.join(d, n) for top in dirs for d, _, names in os.walk(top.getPath()) for n in names]
        return {p: os.path.getsize(p) for p in paths if os.path.basename(p).startswith("shuffle_")}

    before = set(total())
    return lambda: sum(n for p, n in total().items() if p not in before)


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_written_step_leaves_no_shuffle(spark, shuffled):
    rows = spark.range(20_000).withColumn("k", F.col("id") % 977)
    kept = staged(rows.groupBy("k").agg(F.sum("id").alias("s")).repartition(4, "s"), "test")
    assert shuffled() == 0 and kept.count() == 977


def test_intervals_hold_one_shuffle_of_the_issues(spark, shuffled):
    rounds = spark.range(40).selectExpr(
        "0 AS repo_id", "id AS review_id", "timestamp_seconds(id * 86400) AS created_at",
        "IF(id % 9 = 0, 'full', 'incremental') AS mode")
    issues = spark.range(4000).selectExpr(
        "id % 40 AS review_id", "id AS seq", "concat('f', id % 7) AS file", "CAST(id % 3 AS INT) AS line",
        "'error' AS severity", "'lint' AS category", "concat('m', id % 5) AS message")
    changes = spark.range(200).selectExpr(
        "id % 40 AS review_id", "concat('f', id % 7) AS filename", "CAST(NULL AS STRING) AS previous_filename",
        "'modified' AS status").distinct()
    found = timeline.issue_intervals(rounds, issues, changes)
    assert shuffled() == 0
    assert exchanges(found) <= 2


def test_touches_of_a_batch_move_once(spark):
    batch = spark.createDataFrame([], stream.EVENT)
    known = stream.last_touches(spark.createDataFrame([], stream.EVENT)).where("repo_id > 0")
    names = [c for c in batch.columns]
    changed = stream.changed_by(batch, known.select("repo_id", "file", "slice", "touch"))
    assert changed.columns == names
    assert exchanges(stream.changed_by(batch, batch.selectExpr("repo_id", "file", "slice", "struct(at, review_id) AS touch"))) <= 4


def test_issue_key_does_not_move_with_its_issue(spark):
    rounds = spark.createDataFrame([], ROUND)
    issues = spark.createDataFrame([], ISSUE + ", suggestion string")
    events = stream.review_events(rounds, issues, spark.createDataFrame([], CHANGE))
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert "issue_key" not in plan


def test_texts_of_a_slice_move_as_one(spark, shuffled):
    rows = spark.range(3000).selectExpr("id % 3 AS k", "id AS place", "concat('line ', id, repeat('x', id % 50)) AS text")
    parts = byte_parts(rows, ["k"], ["place"], F.lit(0), "text", 4096, 500)
    assert shuffled() < 200 and exchanges(parts) == 1  # the count of the cuts is left
    whole = {k: "" for k in range(3)}
    for r in sorted(parts.collect(), key=lambda r: (r["k"], r["part"])):
        assert len(r["text"]) <= 4096
        whole[r["k"]] += r["text"]
    want = {k: "".join(f"line {i}{'x' * (i % 50)}" for i in range(k, 3000, 3)) for k in range(3)}
    assert whole == want


def test_changes_are_made_once_for_a_prompt(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(name):
        made.add(1)
        return name

    reviews = spark.createDataFrame([(1, "https://x/y")], "review_id bigint, repo_url string")
    changes = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "review_id bigint, file_no int, filename string").select(
        "review_id", "file_no", seen("filename").alias("filename"), F.lit(None).cast("string").alias("previous_filename"),
        F.lit("modified").alias("status"), F.lit("+x").alias("patch"))
    findings = spark.createDataFrame(
        [(1, 1, "a", 3, "error", "lint", "m", "r")],
        "review_id bigint, seq bigint, file string, line int, severity string, category string, message string, rule_id string")
    parts = prompts.incremental_prompt_parts(reviews, changes, findings).collect()
    assert len(parts) == 1 and "a:L3" in parts[0]["text"] and "### b (modified)" in parts[0]["text"]
    assert made.value == 2
