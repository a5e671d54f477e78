"""Importance resampling towards a target distribution (Xie et al., 2023), without replacement.

1. Hashed word n-grams of all documents and of all target texts are counted per bucket, in
   numpy arrays inside the reading tasks; Spark adds the arrays of the tasks.
2. A bucket's gain is its log ratio of the two smoothed distributions. The weight of a
   document is the sum of the gains of its features, looked up in the gain array, which has
   one entry a bucket.
3. Weight plus Gumbel noise drawn from the document id gives the score; the highest scores
   are the sample. Ranks come from the distributed radix sort of ``radix``.

Defined results: null and empty texts have no features, weight 0, and are never drawn; a null
id is drawn like the text ``null`` and comes after all others of the same score; rows of one
id with equal scores are ranked by their number of features; repeated rows are ranked each; an empty
target or empty documents count 0 in each bucket; an empty table gives an empty table. Texts
are hashed about a megabyte at a time, so memory beyond a text's own size is bounded. Extra columns of
``documents`` are kept but for those that bear a name of the result in any case.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.llm.radix import ranked
from reviewloom.llm.store import prepared, set_aside, staged
from reviewloom.llm.text import ALNUM, LOWER, utf8, words

BUCKETS, NGRAM, SEED = 10_000, 1, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Bytes up to which CRCs are computed for many features at once.
_SHORT = 48
_SLICE = 200_000
_RESULT = {"n_features": "bigint", "weight": "bigint", "score": "bigint"}


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of many byte ranges: one step for the k-th byte of all ranges that have one."""
    sizes = ends - starts
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    open_ = np.flatnonzero(sizes <= _SHORT)
    for k in range(_SHORT):
        open_ = open_[sizes[open_] > k]
        if not len(open_):
            break
        now = state[open_]
        state[open_] = _CRC[(now ^ flat[starts[open_] + k]) & 0xFF] ^ (now >> 8)
    state = ~state
    for k in np.flatnonzero(sizes > _SHORT).tolist():
        state[k] = zlib.crc32(flat[starts[k] : ends[k]])
    return state


def features(column: pa.Array, ngram: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, bucket)`` of the features of a batch, in slices of bounded size.

    A feature is a run of 1 to ``ngram`` words joined by one blank.
    """
    flat, bounds = utf8(column)
    starts, ends, first = words(flat, bounds, ALNUM)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    for low in range(0, len(starts), _SLICE):
        high = min(len(starts), low + _SLICE)
        far = min(len(starts), high + ngram - 1)
        # The slice's words with one blank after each, lower-cased.
        sizes = ends[low:far] - starts[low:far]
        at = np.cumsum(sizes + 1) - (sizes + 1)
        spread = np.full(int((sizes + 1).sum()), ord(" "), dtype=np.uint8)
        within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        spread[np.repeat(at, sizes) + within] = LOWER[flat[np.repeat(starts[low:far], sizes) + within]]
        for n in range(1, ngram + 1):
            k = np.arange(min(high - low, far - low - n + 1))
            k = k[text[low + k] == text[low + k + n - 1]]
            last = k + n - 1
            yield text[low + k], crc32(spread, at[k], at[last] + sizes[last]) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> list[int]:
    """Features per bucket over all rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket in features(batch.column("text"), ngram, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], names=["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for row in summed.collect():  # at most `buckets` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(documents: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed distributions, per bucket."""
    size, of_documents, of_target = len(documents), sum(documents), sum(target)
    return np.array([
        math.floor(1000 * math.log((t + 1) * float(of_documents + size) / ((s + 1) * float(of_target + size))))
        for s, t in zip(documents, target)], dtype=np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, drawn from the id."""
    digits = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digits[:8], 16) + 0.5) / 4294967296)))


def scored(
    documents: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """``documents`` without their text, with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    prepared(documents.sparkSession)
    table = gains(bucket_counts(documents, ngram, buckets), bucket_counts(target, ngram, buckets))
    added = {"n_words": "bigint", **_RESULT}
    own = [F.col(f"`{c}`") for c in documents.columns if c.lower() not in (*added, "rank", "text", "doc_id")]
    source, rest = set_aside(documents.select("doc_id", "text", *own), "doc_id", "text")
    source = source.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = utf8(batch.column("text"))
            n_words = np.diff(words(flat, bounds, ALNUM)[2])
            n, weight = np.zeros((2, batch.num_rows), dtype=np.int64)
            for text, bucket in features(batch.column("text"), ngram, buckets):
                n += np.bincount(text, minlength=len(n))
                np.add.at(weight, text, table[bucket])
            score = weight + np.array([noise(i, seed) for i in batch.column("doc_id").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: -len(added)], *map(pa.array, (n_words, n, weight, score))], names=batch.schema.names)

    return source.mapInArrow(run, source.schema).select("doc_id", *rest, *added)


def resampled(
    documents: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """``scored`` documents with ``rank`` from 1 for those drawn, null for all others.

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred are drawn.
    """
    all_scored = staged(scored(documents, target, ngram, buckets, seed), "scored")
    enough = F.col("n_words") >= least_words
    order = [
        (F.col("score"), True),
        (F.col("doc_id").isNull().cast("bigint"), False),
        (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), False),
        (F.col("n_features"), False),
    ]
    sorted_rows = ranked(all_scored.where(enough), order, "rank")
    drawn = percent * all_scored.where(enough).count() // 100
    rank = F.when(F.col("rank") < drawn, F.col("rank") + 1).alias("rank")
    columns = [F.col(f"`{c}`") for c in all_scored.columns]
    rest = all_scored.where(~enough).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return sorted_rows.select(*columns, rank).unionByName(rest)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document, drawn towards the benchmark's words."""
    prepared(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resampled(documents, target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH step AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(i AS BIGINT))) AS crc
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM b GROUP BY ALL),
hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(length(hex(encode(w))) // 2),
      lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), step
), s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM dw), 0) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM bw), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8)
      AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (doc_id)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place,
    10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS drawn FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM r
"""
