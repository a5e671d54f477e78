"""Per-key ranking against brute force, with one key holding a third of the rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reviewloom.operators import ranking


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [
        (0 if rng.random() < 0.34 else rng.randint(1, 200), i, rng.randint(0, 90),
         rng.choice([None, i % 7]))
        for i in range(6000)
    ]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, id int, day int, v int").repartition(16)


def by_key(rows):
    groups = defaultdict(list)
    for k, i, day, v in rows:
        groups[k].append((day, i, v))
    return {k: sorted(g) for k, g in groups.items()}


@pytest.mark.parametrize("k", [1, 3, 700])
def test_top_k(frame, rows, k):
    top = ranking.top_k(frame, ["k"], [F.col("day"), F.col("id")], k, "rank")
    want = {(key, i, n + 1) for key, g in by_key(rows).items() for n, (_, i, _) in enumerate(g[:k])}
    assert {(r["k"], r["id"], r["rank"]) for r in top.collect()} == want


def test_top_k_limits_before_the_shuffle(frame):
    plan = ranking.top_k(frame, ["k"], [F.col("day"), F.col("id")], 3, "rank")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("slice_rows", [None, 8, 10**6])
@pytest.mark.parametrize("bucket", ["day", "1"])
def test_numbered(frame, rows, bucket, slice_rows):
    got = ranking.numbered(
        frame, ["k"], ["day", "id"], F.expr(bucket), "n", {"id": "before", "v": "w"}, slice_rows)
    want = {
        (key, g[n][1], n + 1, g[n - 1][1] if n else None, g[n - 1][2] if n else None)
        for key, g in by_key(rows).items() for n in range(len(g))
    }
    assert {(r["k"], r["id"], r["n"], r["before"], r["w"]) for r in got.collect()} == want


@pytest.mark.parametrize("slice_rows", [None, 8])
@pytest.mark.parametrize("bucket", ["day", "1"])
def test_carried_forward(frame, rows, bucket, slice_rows):
    got = ranking.carried_forward(frame, ["k"], ["day", "id"], F.expr(bucket), "v", "c", slice_rows)
    want = set()
    for key, group in by_key(rows).items():
        last = None
        for _, i, v in group:
            last = v if v is not None else last
            want.add((key, i, last))
    assert {(r["k"], r["id"], r["c"]) for r in got.collect()} == want


def test_running_total(frame, rows):
    got = ranking.running_total(frame, ["k"], ["day", "id"], F.lit(1), "id", "before", 8)
    want = {
        (key, i, sum(j for _, j, _ in g[:n])) for key, g in by_key(rows).items() for n, (_, i, _) in enumerate(g)
    }
    assert {(r["k"], r["id"], r["before"]) for r in got.collect()} == want


def test_slices_of_one_hot_day_are_small_and_spread(spark):
    """A third of all rows lies in one bucket; no slice or task gets a fixed share of them."""
    rows = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k", "id", "1 AS day")
    sliced, parts = ranking._sliced(rows, ["k"], ["id"], F.col("day"), 50)
    sizes = [r["count"] for r in sliced.where("k = 0").groupBy(*parts).count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) > 128 and max(sizes) < 1000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in sliced.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(tasks) < 30_000 / 4


@pytest.mark.parametrize("most", [0, 10**6])
def test_long_slice_lists(spark, monkeypatch, most):
    """Thousands of cuts in one bucket, shipped or shuffled; shipped, the rows are not shuffled to look them up."""
    monkeypatch.setattr(ranking, "_BROADCAST_CUTS", most)
    frame = spark.range(30_000).selectExpr("id % 2 AS k", "id", "0 AS day").repartition(8)
    got = ranking.numbered(frame, ["k"], ["day", "id"], F.lit(1), "n", None, 4)
    assert got.where("n <> floor(id / 2) + 1").isEmpty() and got.count() == 30_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    shuffled = any("hashpartitioning" in line and "__salt" in line for line in plan.splitlines())
    assert not (most and shuffled)
