"""The capped list of a review's first files."""

import random

from pyspark.sql import functions as F

from reviewloom.operators import findings as fnd

ISSUE = "review_id int, seq bigint, file string, severity string, message string"


def test_same_files_as_by_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), i, rng.choice([None, *"abcdefgh"]), rng.choice(["error", "info"]), "m")
            for i in range(2000)]
    top = fnd.fix_issues(spark.createDataFrame(rows, ISSUE).repartition(8), 10)
    by_rows = fnd.first_files(top, 3).select("review_id", "file", "file_rank").distinct()
    got = [tuple(r) for r in fnd.first_file_list(top, 3).select("review_id", "file", "file_rank").collect()]
    assert len(got) == len(set(got)) > 80 and set(got) == {tuple(r) for r in by_rows.collect()}


def test_a_task_sorts_a_bounded_share(spark):
    """Shuffled bytes, not cores, say how many tasks there are: one of 16 MB, whatever the size."""
    small = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        text = F.sha2(F.col("id").cast("string"), 512)
        rows = spark.range(1_500_000).select(
            F.col("id").alias("review_id"), F.col("id").alias("seq"), text.alias("file"),
            F.lit("error").alias("severity"), F.reverse(text).alias("message")).repartition(8)
        # About 300 MB, of which eight cores made eight tasks.
        assert fnd.fix_files(rows).select("file", F.spark_partition_id().alias("p")).groupBy("p").agg(F.max("file")).count() >= 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", small)
