"""Open-issue lists as a stream.

A stream of issue and touch events is folded per repository and file: the state is the last
touch alone, and only what a batch changes goes to the log, its new occurrences that are not
older than the touch and the touch itself. Reading the log drops the occurrences that a later
touch made stale, so it does not depend on arrival order: late events are simply applied.
Full rounds, which reset a whole repository, are applied when the log is read.

The log is one folder per batch, ``batch=<number>``, that counts once Spark's writer has left its
success marker. The state is what the touches of the log say, so it needs no store of its own: a
batch is aggregated and joined with it as a table, however many keys it has.

A file's issues are spread over a few slices by issue key; touches go to every slice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewloom.operators import merge
from reviewloom.session import exists, folders, written

SLICES = 4
KEY = ["repo_id", "file", "slice"]
_BATCH = re.compile(r"batch=(\d+)\Z")

_OCCURRENCE = (
    "at bigint, review_id {review}, seq bigint, line int, severity string, category string, "
    "message string, suggestion string"
)
_FIELDS = [part.split()[0] for part in _OCCURRENCE.split(", ")]


def event_schema(repo_id: str = "bigint", review_id: str = "bigint") -> str:
    """Columns of events, and of the log, for the id types of the reviews."""
    return f"repo_id {repo_id}, file string, slice int, kind string, " + _OCCURRENCE.replace("{review}", review_id)


EVENT = event_schema()


def _micros():
    return F.unix_micros(F.col("created_at").cast("timestamp"))


def review_events(
    rounds: DataFrame, issues: DataFrame, changes: DataFrame, slices: int = SLICES
) -> DataFrame:
    """Events of a set of complete rounds: issues that count, and touches of files."""
    changed = changes.select("review_id").distinct().withColumn("changed", F.lit(True))
    placed = rounds.withColumn("at", _micros()).join(changed, "review_id", "left")
    live = placed.where((F.col("mode") == "full") | F.coalesce("changed", F.lit(False)))
    # The slice moves instead of the key it comes from.
    sliced = merge.with_issue_key(issues).withColumn(
        "slice", F.pmod(F.xxhash64("issue_key"), F.lit(slices)).cast("int")).select(
        "file", "slice", *[c for c in _FIELDS if c != "at"])
    issue_events = sliced.join(live.select("review_id", "repo_id", "at"), "review_id").select(
        "repo_id", "file", "slice", F.lit("issue").alias("kind"), *_FIELDS,
    )
    touched = placed.where(F.col("mode") == "incremental").select("review_id", "repo_id", "at")
    every_slice = F.explode(F.array(*[F.lit(i) for i in range(slices)]))
    touch_events = (
        merge.dropped_paths(changes, "review_id").distinct().join(touched, "review_id")
        .select("repo_id", "file", every_slice.alias("slice"), F.lit("touch").alias("kind"),
                "at", "review_id")
    )
    return issue_events.unionByName(touch_events, allowMissingColumns=True)


def last_touches(log: DataFrame) -> DataFrame:
    """``touch``, the last one, of every file slice that has any."""
    touches = log.where(F.col("kind") == "touch")
    return touches.groupBy(*KEY).agg(F.max(F.struct("at", "review_id")).alias("touch"))


def _touches(log: DataFrame) -> DataFrame:
    """All touches of file slices in the log."""
    return log.where(F.col("kind") == "touch").select(*KEY, F.struct("at", "review_id").alias("touch"))


def changed_by(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Log rows by which a batch changes the open issues: occurrences that no touch so far made
    stale, and touches newer than the ``known`` ones (the last of every slice, others beside them)."""
    place = F.struct("at", "review_id")
    none = F.lit(None).cast(known.schema["touch"].dataType)
    touches = (
        _touches(batch).select(*KEY, F.col("touch").alias("fresh"), none.alias("known"))
        .unionByName(known.select(*KEY, none.alias("fresh"), F.col("touch").alias("known")))
        .groupBy(*KEY).agg(F.max("fresh").alias("fresh"), F.max("known").alias("known"))
    )
    newer = touches.where(F.col("fresh").isNotNull() & (F.col("known").isNull() | (F.col("fresh") > F.col("known"))))
    last = touches.select(*[F.col(c).alias(f"t_{c}") for c in KEY], F.greatest("fresh", "known").alias("touch"))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in KEY]
    issues = batch.where(F.col("kind") == "issue").join(last, same, "left")
    return issues.where(F.col("touch").isNull() | (place >= F.col("touch"))).select(*batch.columns).unionByName(
        newer.select(*KEY, F.lit("touch").alias("kind"), "fresh.at", "fresh.review_id"), allowMissingColumns=True)


def _log(spark: SparkSession, path: str, schema: str) -> tuple[list[int], DataFrame]:
    """Numbers of the batches in the log, and its rows."""
    found = [m for m in map(_BATCH.match, folders(spark, path)) if m and exists(spark, f"{path}/{m[0]}/_SUCCESS")]
    numbers = [int(m[1]) for m in found]
    if not found:
        return numbers, spark.createDataFrame([], schema)
    return numbers, spark.read.schema(schema).parquet(*[f"{path}/{m[0]}" for m in found])


def open_issue_stream(
    events: DataFrame, path: str, checkpoint: str, repo_id: str = "bigint", review_id: str = "bigint"
) -> StreamingQuery:
    """Folds the event stream and appends what each batch changes to ``path``, each batch once."""
    schema = event_schema(repo_id, review_id)

    def apply(batch: DataFrame, number: int) -> None:
        numbers, log = _log(batch.sparkSession, path, schema)
        if number not in numbers:
            written(changed_by(batch, _touches(log)), f"{path}/batch={number:09d}", mode="overwrite")

    return (
        events.writeStream.outputMode("append").foreachBatch(apply)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_occurrences(
    spark: SparkSession, path: str, repo_id: str = "bigint", review_id: str = "bigint"
) -> DataFrame:
    """Occurrences of the log that no later touch made stale."""
    _, log = _log(spark, path, event_schema(repo_id, review_id))
    issues = log.where(F.col("kind") == "issue").join(last_touches(log), KEY, "left")
    return issues.where(
        F.col("touch").isNull() | (F.struct("at", "review_id") >= F.col("touch"))
    ).drop("touch", "kind")


def open_issues(occurrences: DataFrame, rounds: DataFrame, changes: DataFrame) -> DataFrame:
    """Open issues from the streamed state: full-round reset and keep-first dedup."""
    position = F.struct(F.timestamp_micros("at").alias("created_at"), F.col("review_id"))
    kept = (
        occurrences.join(merge.round_facts(rounds, changes), "repo_id")
        .withColumn("pos", position)
        .where(merge.not_reset())
        .withColumn("dedup", merge.was_deduplicated())
    )
    return merge.first_of_equal(kept).select(
        "repo_id", "review_id", "seq", "file", "line", "severity", "category", "message",
        "suggestion",
    )
