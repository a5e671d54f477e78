"""Review storage: plans without exchanges, pruned buckets, hot repositories, repeated appends."""

import pytest
from pyspark.sql import functions as F

from reviewloom.sources.review_store import ReviewStore

COLUMNS = "review_id bigint, repo_id string, created_at timestamp, score int"


def reviews(spark, low, high):
    """Repository ``hot`` has every third review, the others are of 50 repositories."""
    n = F.col("id")
    return spark.range(low, high).select(
        n.alias("review_id"), F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("r/"), n % 50)).alias("repo_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(n / 2)).alias("created_at"), (n % 100).cast("int").alias("score"))


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    made = ReviewStore(spark, str(tmp_path_factory.mktemp("store")), COLUMNS, buckets=16, slots=8)
    made.append(reviews(spark, 0, 3000))
    made.append(reviews(spark, 3000, 6000))
    return made


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _newest(rows):
    best = {}
    for r in rows:
        best[r["repo_id"]] = max(best.get(r["repo_id"], (r["created_at"], r["review_id"])), (r["created_at"], r["review_id"]))
    return {repo: review for repo, (_, review) in best.items()}


def test_latest_has_no_exchange(spark, store):
    assert "Exchange" not in _plan(store.latest())
    want = _newest(reviews(spark, 0, 6000).collect())
    assert {r["repo_id"]: r["review_id"] for r in store.latest().collect()} == want


def test_history_reads_its_buckets_only(spark, store):
    one = store.history("r/7")
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert "Exchange" not in _plan(one) and scan.optionalBucketSet().get().cardinality() <= 8
    all_rows = reviews(spark, 0, 6000)
    assert sorted(one.collect()) == sorted(all_rows.where("repo_id = 'r/7'").select(*one.columns).collect())
    two = store.histories(spark.createDataFrame([("hot",), ("r/7",), ("none",), ("hot",)], "repo_id string"))
    assert two.exceptAll(all_rows.where("repo_id IN ('hot', 'r/7')").select(*two.columns)).isEmpty()
    assert two.count() == all_rows.where("repo_id IN ('hot', 'r/7')").count()


def test_histories_move_the_requests_only(spark, store):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(store.histories(spark.createDataFrame([("hot",)], "repo_id string")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "FileScan" in line)
    above, depth = [], lines[scan].index("FileScan")
    for line in reversed(lines[:scan]):
        at = len(line) - len(line.lstrip(" :+-*"))
        if at < depth:
            above.append(line)
            depth = at
    assert "Bucketed: true" in lines[scan] and "Exchange" in plan
    assert not any("Exchange" in line for line in above)


def test_a_hot_repository_is_spread(store):
    sizes = [r["count"] for r in store.history("hot").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 2000 / 4


def test_a_repeated_append_adds_what_is_missing(spark, store, tmp_path):
    made = ReviewStore(spark, str(tmp_path), COLUMNS, buckets=4, slots=2)
    assert made.latest().count() == 0 and made.history("hot").count() == 0
    made.append(reviews(spark, 0, 100))
    made.append(reviews(spark, 50, 150), again=True)
    assert made.history("hot", *[f"r/{k}" for k in range(50)]).count() == 150
    assert {r["repo_id"]: r["review_id"] for r in made.latest().collect()} == _newest(reviews(spark, 0, 150).collect())
    with pytest.raises(ValueError, match="buckets"):
        ReviewStore(spark, str(tmp_path), COLUMNS, buckets=8, slots=2).latest()
