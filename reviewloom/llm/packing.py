"""Length buckets of least padding, and batches within a token budget.

Documents longer than ``longest`` are cut into full pieces and a rest, so no token is lost
and the global histogram has at most ``longest`` lengths. Dynamic programming over it finds
the bucket boundaries with the least padding overall. Within a bucket, pieces are numbered
and dealt to batches of ``budget // boundary`` rows.

Numbers within a bucket come from a hash of the piece: hash slices of about ``SLICE`` rows
are numbered on their own, and each starts where the slices before it end. So a bucket that
holds most documents is never in one task, and the numbers do not depend on the partitions.

Defined results: a document without tokens has the length 1 of its end token; repeated rows
are packed each; columns of the input are not returned, but for ``doc_id``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from reviewloom.llm.store import prepared, staged

LONGEST, BUCKETS, BUDGET = 2048, 8, 65_536
SLICE = 1024


def word_tokens(text: Column) -> Column:
    """Words between blanks, and one end token."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend; the last one is always an end. Fewer buckets if there are fewer lengths.
    """
    if not lengths:
        return []
    x, n = np.array(lengths, dtype=np.float64), np.array(counts, dtype=np.float64)
    rows, used = np.append(0.0, np.cumsum(n)), np.append(0.0, np.cumsum(n * x))
    k = min(buckets, len(x))
    # cost[j]: least padding of the first j lengths; one bucket more in each round.
    cost = np.append(0.0, x * rows[1:] - used[1:])
    back = []
    for _ in range(1, k):
        new, came = cost.copy(), np.zeros(len(cost), dtype=np.int64)
        for j in range(1, len(cost)):
            total = cost[:j] + x[j - 1] * (rows[j] - rows[:j]) - (used[j] - used[:j])
            came[j] = int(np.argmin(total))
            new[j] = total[came[j]]
        back.append(came)
        cost = new
    ends, j = [], len(x)
    for came in reversed(back):
        ends.append(int(x[j - 1]))
        j = int(came[j])
        if j == 0:
            break
    if j > 0:
        ends.append(int(x[j - 1]))
    return ends[::-1]


def pieces(documents: DataFrame, n_tokens: Column, longest: int) -> DataFrame:
    """``doc_id, piece, first_token, n_tokens`` of each piece of at most ``longest`` tokens."""
    whole = documents.select("doc_id", n_tokens.cast("bigint").alias("n"))
    last = F.floor((F.greatest("n", F.lit(1)) - 1) / longest).cast("bigint")
    return whole.select("doc_id", F.greatest("n", F.lit(1)).alias("n"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")
    ).select("doc_id", "piece", (F.col("piece") * longest).alias("first_token"),
             F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).cast("int").alias("n_tokens"))


def packed(
    documents: DataFrame, n_tokens: Column | None = None, longest: int = LONGEST, buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """Every piece with its bucket, padded length, batch within the bucket and place in the batch."""
    prepared(documents.sparkSession)
    n_tokens = word_tokens(F.col("text")) if n_tokens is None else n_tokens
    cut = staged(pieces(documents, n_tokens, longest), "pieces")
    histogram = sorted(tuple(r) for r in cut.groupBy("n_tokens").count().collect())  # at most `longest` rows
    ends = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets) or [longest]
    lows = [0, *ends[:-1]]
    sizes = [sum(n for x, n in histogram if low < x <= end) for low, end in zip(lows, ends)]

    def by_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1)

    slices = [max(1, -(-n // SLICE)) for n in sizes]
    placed = cut.withColumn(
        "bucket", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("n_tokens")))
    ).withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), by_bucket(slices)))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("bucket", "slice").count().select(
        "bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    order = Window.partitionBy("bucket", "slice").orderBy("doc_id", "piece", "n_tokens")
    number = F.col("before") + F.row_number().over(order) - 1
    rows = by_bucket([max(1, budget // e) for e in ends])
    return placed.join(starts, ["bucket", "slice"]).withColumn("number", number).select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", by_bucket(ends).alias("padded_to"),
        F.floor(F.col("number") / rows).cast("bigint").alias("batch"), F.pmod("number", rows).cast("int").alias("place"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    prepared(spark)
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
