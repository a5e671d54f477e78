"""The compacted log against the sequential fold, its size, and batches that run twice."""

import os

import pytest

from reviewloom.streaming import compacted, open_issues as stream
from tests.test_merge import _listed, _tables


def _parts(events, folder, n):
    """The events in arrival order unlike their own, as ``n`` files that come one after the other."""
    from pyspark.sql import functions as F

    part = F.pmod(F.xxhash64("review_id", "seq", "file", "slice"), F.lit(n))
    for k in range(n):
        events.where(part == k).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, tmp_path, **options):
    source = spark.readStream.schema(stream.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
    return compacted.compacted_stream(source, f"{tmp_path}/log", f"{tmp_path}/check", **options).awaitTermination()


@pytest.mark.parametrize("seed,lateness", [(99, None), (7, 1)])
def test_compacted_log_equals_fold(spark, tmp_path, seed, lateness):
    """In any order of arrival, or dropping settled repeats where events come by time."""
    rounds, issues, changes, final = _tables(spark, seed)
    events = compacted.review_events(rounds, issues, changes, slices=2)
    if lateness is None:
        _parts(events, f"{tmp_path}/events", 5)
    else:
        for (at,) in sorted(events.select("at").distinct().collect()):
            events.where(f"at = {at}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    _run(spark, tmp_path, most=2, lateness=lateness)
    occurrences = compacted.current_occurrences(spark, f"{tmp_path}/log")
    assert _listed(stream.open_issues(occurrences, rounds, changes), final) == final


def test_a_killed_stream_goes_on_with_the_same_rows(spark, tmp_path, monkeypatch):
    rounds, issues, changes, final = _tables(spark, 5)
    _parts(compacted.review_events(rounds, issues, changes, slices=2), f"{tmp_path}/events", 4)
    whole, calls = compacted.compact, []

    def dies(*args):
        whole(*args)
        calls.append(args)
        raise RuntimeError("killed after the snapshot, before the batch is committed")

    monkeypatch.setattr(compacted, "compact", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            _run(spark, tmp_path, most=2)
    monkeypatch.setattr(compacted, "compact", whole)
    _run(spark, tmp_path, most=2)
    assert len(calls) == 2
    occurrences = compacted.current_occurrences(spark, f"{tmp_path}/log")
    assert _listed(stream.open_issues(occurrences, rounds, changes), final) == final


def _event(kind, at, review_id, file="a.js", seq=None, message=None):
    return (1, file, 0, kind, at, review_id, seq, 1, "error", "logic", message, "")


def test_log_holds_open_issues_only(spark, tmp_path):
    """Each round touches the file and finds 20 issues; the log stays at those of few rounds."""
    sizes = []
    for n in range(1, 7):
        rows = [_event("touch", n, n)] + [_event("issue", n, n, seq=k, message=f"m{k}") for k in range(20)]
        spark.createDataFrame(rows, stream.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        _run(spark, tmp_path, most=1)
        through, deltas = compacted._generation(spark, f"{tmp_path}/log")
        log = compacted._log(spark, f"{tmp_path}/log", stream.EVENT, through, deltas)
        sizes.append((log.count(), len(os.listdir(f"{tmp_path}/log"))))
    assert [rows for rows, _ in sizes] == [20] * 6
    assert max(folders for _, folders in sizes) <= 4


def test_full_round_resets_and_lateness_keeps_the_first(spark):
    rows = [
        _event("issue", 1, 1, seq=0, message="old"), _event("touch", 2, 2, file=None),
        _event("issue", 2, 2, seq=0, message="m"), _event("issue", 2, 2, seq=1, message="m"),
        _event("issue", 3, 3, seq=0, message="m"), _event("issue", 9, 4, seq=0, message="m"),
    ]
    log = spark.createDataFrame(rows, stream.EVENT)

    def kept(lateness):
        return sorted((r["review_id"], r["seq"]) for r in compacted.folded(log, lateness).where("kind = 'issue'").collect())

    assert kept(None) == [(2, 0), (2, 1), (3, 0), (4, 0)]
    assert kept(5) == [(2, 0), (2, 1), (4, 0)]
    assert compacted.folded(log).where("kind = 'touch'").collect()[0]["at"] == 2


def test_an_open_reader_outlives_one_compaction(spark, tmp_path):
    path = f"{tmp_path}/log"
    for n in range(3):
        rows = [_event("issue", n, n, seq=0, message=f"m{n}")]
        spark.createDataFrame(rows, stream.EVENT).write.parquet(f"{path}/delta-{n:09d}")
        reader = compacted.current_occurrences(spark, path)
        compacted.compact(spark, path)
        assert reader.count() == n + 1
    assert compacted.current_occurrences(spark, path).count() == 3
    assert compacted.current_occurrences(spark, f"{tmp_path}/none").count() == 0


def test_a_batch_changes_only_what_is_newer_than_all_touches(spark):
    """Against touches of earlier batches and of its own, in files without a name too."""
    known = stream.last_touches(spark.createDataFrame(
        [_event("touch", 5, 5), _event("touch", 3, 3), _event("touch", 7, 7, file=None)], stream.EVENT))
    batch = spark.createDataFrame([
        _event("issue", 4, 4, seq=0), _event("issue", 5, 5, seq=1), _event("touch", 4, 4), _event("touch", 2, 2, file="b.js"),
        _event("issue", 1, 1, file="b.js", seq=2), _event("issue", 6, 6, file=None, seq=3), _event("issue", 1, 1, file="c.js", seq=4),
    ], stream.EVENT)
    rows = [(r["kind"], r["file"], r["at"]) for r in stream.changed_by(batch, known).collect()]
    assert sorted(rows) == [("issue", "a.js", 5), ("issue", "c.js", 1), ("touch", "b.js", 2)]


def test_late_occurrences_stay_out_after_compaction(spark, tmp_path):
    """Snapshots hold no touches of files, yet what is older than these is dropped in later batches."""
    for rows in ([_event("issue", 3, 3, seq=0), _event("touch", 5, 5)], [_event("issue", 6, 6, seq=1)], [_event("issue", 4, 4, seq=2)]):
        spark.createDataFrame(rows, stream.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        _run(spark, tmp_path, most=1)
    assert [r["at"] for r in compacted.current_occurrences(spark, f"{tmp_path}/log").collect()] == [6]


def test_batches_do_not_grow_with_the_files_of_a_history(spark, tmp_path):
    from reviewloom.catalog import streams

    rows = [_event("issue", n, n, seq=n) for n in range(40)]
    source = streams._streamed(spark, spark.createDataFrame(rows, stream.EVENT).repartition(24, "at"), f"{tmp_path}/events")
    stream.open_issue_stream(source, f"{tmp_path}/log", f"{tmp_path}/check").awaitTermination()
    assert len(os.listdir(f"{tmp_path}/log")) <= streams.BATCHES
    assert stream.current_occurrences(spark, f"{tmp_path}/log").count() == 40
