"""Streaming queries, run to completion over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.merging import ORACLES as _MERGE_ORACLES
from reviewloom.catalog.views import oracle
from reviewloom.operators import merge
from reviewloom.session import discard, scratch_dir, staged, written
from reviewloom.sources.samples import Samples
from reviewloom.streaming import append, compacted, open_issues as stream


# Batches of a whole history, however many files its events fill.
BATCHES = 4


def _streamed(spark, events, path):
    """The events as a stream that comes in ``BATCHES`` batches of whole files."""
    written(events, path)
    files = len(spark.read.parquet(path).inputFiles())
    return (
        spark.readStream.schema(stream.EVENT).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(path)
    )


def _parts(spark):
    """Ranges of time, some for every batch and as many as the session shuffles to."""
    return -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // BATCHES) * BATCHES


def stream_open_issues(spark, sf_dir):
    """Open issues per repository from the streamed state; equals the batch closed form."""
    s = Samples(spark, sf_dir)
    rounds = s.reviews().select("review_id", "repo_id", "created_at", "mode")
    folder = scratch_dir(spark, "open-issues")
    events = _streamed(spark, stream.review_events(rounds, s.issues(), s.changes()), f"{folder}/events")
    stream.open_issue_stream(events, f"{folder}/state", f"{folder}/check").awaitTermination()
    discard(spark, f"{folder}/events")
    # Written once, so that their shuffle is gone before the next ones.
    occurrences = staged(stream.current_occurrences(spark, f"{folder}/state"), "occurrences")
    opened = stream.open_issues(occurrences, rounds, s.changes())
    return merge.open_issue_totals(opened)


def stream_compacted_issues(spark, sf_dir):
    """Open issues from a stream whose log is compacted after every second batch."""
    s = Samples(spark, sf_dir)
    rounds = s.reviews().select("review_id", "repo_id", "created_at", "mode")
    folder = scratch_dir(spark, "compacted-issues")
    events = compacted.review_events(rounds, s.issues(), s.changes())
    source = _streamed(spark, events.repartitionByRange(_parts(spark), "at"), f"{folder}/events")
    compacted.compacted_stream(source, f"{folder}/log", f"{folder}/check", most=2).awaitTermination()
    discard(spark, f"{folder}/events")
    occurrences = compacted.current_occurrences(spark, f"{folder}/log")
    return stream.open_issues(occurrences, rounds, s.changes()).select(
        "repo_id", "review_id", "seq", "file", "severity", "message"
    )


def stream_append(spark, sf_dir):
    """Orders appended as reviews by a stream, counted per branch and month."""
    folder = scratch_dir(spark, "append")
    orders = Samples(spark, sf_dir).table("orders")
    rows = (
        spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet")
        .parquet(sf_dir)
        .selectExpr(
            "o_orderkey AS review_id", "o_custkey AS repo_id", "o_orderdate AS created_at",
            "CASE WHEN o_orderkey % 3 = 0 THEN 'main' ELSE 'develop' END AS branch",
        )
    )
    append.append_stream(rows, f"{folder}/reviews", f"{folder}/check").awaitTermination()
    stored = append.read_appended(
        spark, f"{folder}/reviews",
        "review_id bigint, repo_id bigint, created_at timestamp, branch string",
    )
    return stored.groupBy("branch", F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("review_id").alias("ids")
    )


QUERIES = {
    "stream_open_issues": stream_open_issues,
    "stream_compacted_issues": stream_compacted_issues,
    "stream_append": stream_append,
}

ORACLES = {
    "stream_open_issues": _MERGE_ORACLES["open_issues"],
    "stream_compacted_issues": _MERGE_ORACLES["open_issue_list"],
    "stream_append": oracle(
        "SELECT branch, strftime(created_at, '%Y-%m') AS month, count(*) AS n, CAST(sum(review_id) AS "
        "BIGINT) AS ids FROM fx_reviews GROUP BY ALL", "reviews"),
}
