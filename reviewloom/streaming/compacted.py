"""Open issues as a stream whose log stays about as large as the open issues.

The log is a snapshot and the deltas of the batches after it, each a folder of its own:
``snapshot-<through>`` holds everything up to a batch, ``delta-<batch>`` what one batch changed.
A folder counts once Spark's writer has left its success marker, so a generation appears at once
or not at all. A reader takes the newest snapshot and the deltas after it; these stay until the
next snapshot but one, so compaction does not take files from a reader that has just opened.

Batches are applied once: a batch that runs again after a failure finds its delta, or a
snapshot that has it already, and does nothing.

A full round is a touch of the whole repository, an event without a file, and so part of the
state too. In a snapshot touches of files are already applied; only the last full round of each
repository is kept beside the occurrences. The last touches, which hold back what is older than
them, lie beside it in ``_touches/<through>``, written before the snapshot that counts on them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators import merge
from reviewloom.session import discard, exists, folders, total_bytes, written
from reviewloom.streaming import open_issues as stream

_NAME = re.compile(r"(snapshot|delta)-(\d+)\Z")
_SLICE = stream.KEY
# A snapshot is due when the deltas hold this share of its bytes, or are this many.
SHARE, MOST_DELTAS = 0.5, 64


def review_events(
    rounds: DataFrame, issues: DataFrame, changes: DataFrame, slices: int = stream.SLICES
) -> DataFrame:
    """Events of complete rounds, with a touch of the whole repository for every full round."""
    events = stream.review_events(rounds, issues, changes, slices)
    resets = rounds.where(F.col("mode") == "full").select(
        "repo_id", F.lit(None).cast("string").alias("file"), F.lit(0).alias("slice"),
        F.lit("touch").alias("kind"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"),
        "review_id",
    )
    return events.unionByName(resets, allowMissingColumns=True)


def _written(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Batch numbers of the complete snapshots and deltas, ascending."""
    found = {"snapshot": [], "delta": []}
    for name in folders(spark, path):
        match = _NAME.match(name)
        if match and exists(spark, f"{path}/{name}/_SUCCESS"):
            found[match[1]].append(int(match[2]))
    return sorted(found["snapshot"]), sorted(found["delta"])


def _folder(path: str, kind: str, batch: int) -> str:
    return f"{path}/{kind}-{batch:09d}"


def _generation(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """Last batch of the newest snapshot, and the deltas after it."""
    snapshots, deltas = _written(spark, path)
    through = snapshots[-1] if snapshots else None
    return through, [d for d in deltas if through is None or d > through]


def _log(spark: SparkSession, path: str, schema: str, through: int | None, deltas: list[int]) -> DataFrame:
    parts = [_folder(path, "delta", d) for d in deltas]
    if through is not None:
        parts.append(_folder(path, "snapshot", through))
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*parts)


def _touch_folder(path: str, through: int) -> str:
    return f"{path}/_touches/{through:09d}"


def _touches(spark: SparkSession, path: str, schema: str, through: int | None, deltas: list[int]) -> DataFrame:
    """Last touches of everything in the log, those of batches before the snapshot too."""
    rows = _log(spark, path, schema, None, deltas)
    if through is not None and exists(spark, _touch_folder(path, through)):
        rows = rows.unionByName(spark.read.schema(schema).parquet(_touch_folder(path, through)))
    return stream.last_touches(rows)


def folded(log: DataFrame, lateness: int | None = None) -> DataFrame:
    """Log rows that still count: occurrences that no later touch made stale, and the last full
    round of every repository.

    With ``lateness``, in microseconds, events so much older than the newest one are taken to
    have all arrived. Of equal issues that old only those of the first round are kept: what
    comes later makes all of them stale or none.
    """
    place = F.struct("at", "review_id")
    touches = log.where(F.col("kind") == "touch")
    last = F.max(place).alias("touch")
    by_file = touches.where(F.col("file").isNotNull()).groupBy(*_SLICE).agg(last)
    resets = touches.where(F.col("file").isNull()).groupBy("repo_id").agg(F.max(place).alias("reset"))
    alive = (
        log.where(F.col("kind") == "issue").join(by_file, _SLICE, "left").join(resets, "repo_id", "left")
        .where(F.col("touch").isNull() | (place >= F.col("touch")))
        .where(F.col("reset").isNull() | (place >= F.col("reset"))).drop("touch", "reset")
    )
    if lateness is not None:
        newest = log.agg(F.max("at")).first()[0]
        settled = F.col("at") <= F.lit((newest or 0) - lateness)
        keyed = merge.with_issue_key(alive)
        first = keyed.where(settled).groupBy("repo_id", "issue_key").agg(F.min(place).alias("first"))
        alive = (
            keyed.join(first, ["repo_id", "issue_key"], "left")
            .where(~settled | F.col("first").isNull() | (place == F.col("first"))).drop("first", "issue_key")
        )
    kept = resets.select(
        "repo_id", F.lit(None).cast("string").alias("file"), F.lit(0).alias("slice"),
        F.lit("touch").alias("kind"), "reset.at", "reset.review_id",
    )
    return alive.select(*log.columns).unionByName(kept, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, schema: str = stream.EVENT, lateness: int | None = None) -> None:
    """Write a new snapshot of everything so far, then remove what no open reader can still use."""
    through, deltas = _generation(spark, path)
    if not deltas:
        return
    touches = _touches(spark, path, schema, through, deltas)
    rows = touches.select(*_SLICE, F.lit("touch").alias("kind"), "touch.at", "touch.review_id")
    written(rows, _touch_folder(path, deltas[-1]), mode="overwrite")
    log = folded(_log(spark, path, schema, through, deltas), lateness)
    written(log, _folder(path, "snapshot", deltas[-1]), mode="overwrite")
    snapshots, all_deltas = _written(spark, path)
    for old in snapshots[:-2]:
        discard(spark, _folder(path, "snapshot", old))
        discard(spark, _touch_folder(path, old))
    for old in all_deltas if through is not None else []:
        if old <= through:
            discard(spark, _folder(path, "delta", old))


def _due(spark: SparkSession, path: str, share: float, most: int) -> bool:
    through, deltas = _generation(spark, path)
    if len(deltas) >= most or through is None:
        return len(deltas) >= most
    new = sum(total_bytes(spark, _folder(path, "delta", d)) for d in deltas)
    return new >= share * total_bytes(spark, _folder(path, "snapshot", through))


def compacted_stream(
    events: DataFrame, path: str, checkpoint: str, repo_id: str = "bigint", review_id: str = "bigint",
    share: float = SHARE, most: int = MOST_DELTAS, lateness: int | None = None,
) -> StreamingQuery:
    """Folds the event stream (see ``review_events``) into the log at ``path``, compacting as it grows."""
    schema = stream.event_schema(repo_id, review_id)

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        snapshots, deltas = _written(spark, path)
        if number not in deltas and not (snapshots and number <= snapshots[-1]):
            known = _touches(spark, path, schema, *_generation(spark, path))
            written(stream.changed_by(batch, known), _folder(path, "delta", number), mode="overwrite")
        if _due(spark, path, share, most):
            compact(spark, path, schema, lateness)

    return (
        events.writeStream.outputMode("append").foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_occurrences(
    spark: SparkSession, path: str, repo_id: str = "bigint", review_id: str = "bigint"
) -> DataFrame:
    """Occurrences of the newest generation; ``open_issues.open_issues`` takes them from there."""
    schema = stream.event_schema(repo_id, review_id)
    log = folded(_log(spark, path, schema, *_generation(spark, path)))
    return log.where(F.col("kind") == "issue").drop("kind")
