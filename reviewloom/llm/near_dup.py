"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles, a 128-bit digest of the set and a
   MinHash signature. Documents with equal sets are linked at once and stand for one
   representative, the smallest id, so that copies never meet each other again.
2. Representatives that agree on a band of the signature are candidates. Each bucket first
   offers the pairs of its smallest member with all others. When their links are known, the
   buckets that still hold several components are cut into blocks of bounded size, and each
   pair of blocks is compared in one task, only where components differ. A task returns links
   between components, never its pairs.
3. Candidates are verified in sequence (after BayesLSH, Satuluri and Parthasarathy, 2012):
   signatures are compared batch by batch, and a pair is dropped as soon as the posterior
   probability that its similarity reaches the threshold is below ``miss``, a uniform prior
   assumed. All survivors are compared on their full sets.
4. Links are contracted to components.

A pair exactly at the threshold of 0.85 shares none of the 28 bands of 6 rows with
probability 2e-6, and less the more similar it is.

Defined results: texts without words, null texts and rows without a ``doc_id`` link with
nothing; repeated rows get the same component; ties go to the smallest ``doc_id``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from reviewloom.llm.components import components
from reviewloom.llm.store import prepared, staged
from reviewloom.llm.text import SPACED, mix, shingles, utf8, word_hashes, words

BANDS, ROWS = 28, 6
BATCH = 28
MISS = 1e-7
#: Members of a bucket that meet as one block.
BLOCK = 2048
_SIGNED = "doc_id bigint, n_shingles bigint, set_key binary, signature binary"


@lru_cache(maxsize=4)
def _hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    draws = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return draws[:size] | np.uint64(1), draws[size:]


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash signatures, one row for each set; no set is empty."""
    factors, terms = _hash_family(size)
    out = np.empty((len(sets), size), dtype=np.uint32)
    at = 0
    while at < len(sets):
        to, total = at + 1, len(sets[at])
        while to < len(sets) and total + len(sets[to]) <= 1 << 15:
            total += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        lengths = np.array([len(x) for x in sets[at:to]])
        starts = np.cumsum(lengths) - lengths
        work = np.empty_like(flat)
        for k in range(size):
            np.multiply(flat, factors[k], out=work)
            np.add(work, terms[k], out=work)
            out[at:to, k] = np.minimum.reduceat(work, starts) >> np.uint64(32)
        at = to
    return out


def _sets(column: pa.Array, words_per_shingle: int) -> list[np.ndarray]:
    flat, bounds = utf8(column)
    starts, ends, first = words(flat, bounds, SPACED)
    return shingles(word_hashes(flat, starts, ends), first, words_per_shingle)


def signed(documents: DataFrame, words_per_shingle: int, size: int) -> DataFrame:
    """Set size, set digest and signature of each document; the last two null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _sets(batch.column("text"), words_per_shingle)
            filled = [k for k, s in enumerate(sets) if len(s)]
            rows = signatures([sets[k] for k in filled], size)
            keys, coded = [None] * len(sets), [None] * len(sets)
            for k, row in zip(filled, rows):
                keys[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                coded[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.binary()), pa.array(coded, pa.binary()),
            ], names=["doc_id", "n_shingles", "set_key", "signature"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sign, _SIGNED)


def keys_of(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys of the bands of each signature."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def band_keys(representatives: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(band_key, doc_id)``; equal keys are equal bands, up to 64-bit collisions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32)
            key = keys_of(coded.reshape(batch.num_rows, -1), bands, rows)
            ids = np.repeat(batch.column("doc_id").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1)), pa.array(ids)], names=["band_key", "doc_id"])

    return representatives.select("doc_id", "signature").mapInArrow(cut, "band_key bigint, doc_id bigint")


@lru_cache(maxsize=16)
def least_matches(size: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """After how many hashes, how many must agree for a pair to stay.

    With a uniform prior the posterior of m agreements in n is Beta(m + 1, n - m + 1); the
    probability above the threshold is P(Bin(n + 1, threshold) <= m).
    """
    out = []
    for n in [*range(batch, size, batch), size]:
        below, m = 0.0, 0
        for m in range(n + 2):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
        out.append((n, m))
    return out


def _likely(pairs: DataFrame, representatives: DataFrame, size: int, batch: int, threshold: float, miss: float):
    """The pairs ``(a, b)`` that the signatures leave possible."""
    limits = least_matches(size, batch, threshold, miss)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32).reshape(rows.num_rows, size)
                for c in ("sig_a", "sig_b"))
            alive, same, at = np.arange(rows.num_rows), np.zeros(rows.num_rows, np.int64), 0
            for n, least in limits:
                same[alive] += (left[alive, at:n] == right[alive, at:n]).sum(axis=1)
                alive, at = alive[same[alive] >= least], n
            yield rows.select(["a", "b"]).take(pa.array(alive))

    a = representatives.select(F.col("doc_id").alias("a"), F.col("signature").alias("sig_a"))
    b = representatives.select(F.col("doc_id").alias("b"), F.col("signature").alias("sig_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(
        compare, "a bigint, b bigint")


def _linked(pairs: DataFrame, texts: DataFrame, words_per_shingle: int, percent: int) -> DataFrame:
    """The pairs whose full sets have ``100 * intersection >= percent * union``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            left, right = (_sets(rows.column(c), words_per_shingle) for c in ("text_a", "text_b"))
            kept = []
            for k, (x, y) in enumerate(zip(left, right)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(k)
            yield rows.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(
        compare, "a bigint, b bigint")


def _compare_tile(bands: int, rows: int, limits: list[tuple[int, int]], percent: int):
    """Links between different components of a bucket, for one pair of its blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        band, i, j = (table.column(c)[0].as_py() for c in ("band_key", "i", "j"))
        block = table.column("block").to_numpy()
        component = table.column("component").to_numpy()
        label = component.copy()
        coded = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(block), -1)
        keys = keys_of(coded, bands, rows)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        at_band = int(np.argmax(keys[0] == band))
        theirs = np.flatnonzero(block == j)
        links = set()
        for x in np.flatnonzero(block == i).tolist():
            others = theirs[theirs > x] if i == j else theirs
            others = others[label[others] != label[x]]
            at, same = 0, np.zeros(len(others), np.int64)
            for n, least in limits:
                same += (coded[others, at:n] == coded[x, at:n]).sum(axis=1)
                others, same, at = others[same >= least], same[same >= least], n
            # A pair is compared only in the first band that it shares.
            others = others[~(keys[others, :at_band] == keys[x, :at_band]).any(axis=1)]
            if not len(others):
                continue
            flat = np.concatenate([sets[o] for o in others])
            place = np.minimum(np.searchsorted(sets[x], flat), sizes[x] - 1)
            both = np.add.reduceat(sets[x][place] == flat, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
            for o in others[100 * both >= percent * (sizes[x] + sizes[others] - both)].tolist():
                if label[o] != label[x]:
                    links.add((int(component[x]), int(component[o])))
                    label[label == label[o]] = label[x]
        ends = sorted(links)
        return pa.table([pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64())],
                        schema=schema)

    return run


def _between(labelled: DataFrame, representatives: DataFrame, texts: DataFrame, words_per_shingle: int, compare):
    """Links between components that meet in a bucket, found tile by tile."""
    open_ = labelled.groupBy("band_key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")
    ).where("low < high").select("band_key", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = labelled.join(open_, "band_key").select(
        "band_key", "doc_id", "component", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"))
    used = rows.select("doc_id").distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in _sets(batch.column("text"), words_per_shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("signature"), pa.array(sets, pa.binary())],
                names=["doc_id", "signature", "hashes"])

    sets = staged(texts.join(
        representatives.select("doc_id", "signature").join(used, "doc_id", "left_semi"), "doc_id"
    ).select("doc_id", "signature", "text").mapInArrow(
        hashed, "doc_id bigint, signature binary, hashes binary"), "sets").dropDuplicates(["doc_id", "hashes"])
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(k, "block").cast("int").alias("i"), F.greatest(k, "block").cast("int").alias("j")))
    return rows.join(sets, "doc_id").select("*", F.explode(tiles).alias("tile")).select(
        "band_key", "tile.i", "tile.j", "block", "component", "signature", "hashes"
    ).groupBy("band_key", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame, words_per_shingle: int = 3, percent: int = 85, bands: int = BANDS,
    rows: int = ROWS, batch: int = BATCH, miss: float = MISS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``documents``."""
    prepared(documents.sparkSession)
    size, threshold = bands * rows, percent / 100
    marks = staged(signed(documents, words_per_shingle, size), "signed")
    sets = marks.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    first = sets.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))
    representatives = staged(
        sets.join(first, ["set_key", "doc_id"]).select("set_key", "doc_id", "signature").dropDuplicates(
            ["set_key", "doc_id"]), "representatives")
    keys = band_keys(representatives, bands, rows)
    several = keys.groupBy("band_key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"))
    members = staged(
        keys.join(several.where("hub < last").select("band_key", "hub"), "band_key"), "buckets")
    texts = documents.select(F.col("doc_id").cast("bigint"), "text")

    def links(pairs: DataFrame) -> DataFrame:
        likely = staged(_likely(pairs, representatives, size, batch, threshold, miss), "likely")
        used = likely.select(F.col("a").alias("doc_id")).unionByName(
            likely.select(F.col("b").alias("doc_id"))).distinct()
        ours = representatives.select("doc_id").join(used, "doc_id", "left_semi")
        return staged(_linked(
            likely, texts.join(ours, "doc_id", "left_semi"), words_per_shingle, percent), "links")

    stars = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = links(stars)
    joined = components(found, "a", "b").withColumnRenamed("node", "doc_id")
    labelled = staged(members.join(joined, "doc_id", "left").select(
        "band_key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "labelled")
    compare = _compare_tile(bands, rows, least_matches(size, batch, threshold, miss), percent)
    found = found.unionByName(staged(
        _between(labelled, representatives, texts, words_per_shingle, compare), "between"))
    final = components(found, "a", "b").select(F.col("node").alias("doc_id"), F.col("component"))
    roots = representatives.join(final, "doc_id", "left").select(
        "set_key", F.coalesce("component", "doc_id").alias("root"))
    named = marks.select("doc_id", "n_shingles", "set_key").join(roots, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that stay; of repeated rows with the kept id, one stays."""
    stays = near_duplicates(documents.select("doc_id", "text"), **options).where("kept").select("doc_id").distinct()
    some = documents.where(F.col("doc_id").isNotNull()).join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return some.select(*documents.columns).unionByName(documents.where(F.col("doc_id").isNull()))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of each document."""
    prepared(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM d
), e AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g) AS size FROM s),
rare AS (
  SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS r
  FROM e JOIN (SELECT x, count(*) AS f FROM e GROUP BY x) USING (x)
), prefix AS (
  SELECT doc_id, x FROM rare JOIN n USING (doc_id) WHERE 100 * (r - 1) <= 15 * size
), c AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.doc_id < b.doc_id
), link AS (
  SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
  WHERE 100 * len(list_intersect(sa.g, sb.g)) >= 85 * (len(sa.g) + len(sb.g) - len(list_intersect(sa.g, sb.g)))
), reach AS (
  SELECT doc_id, doc_id AS c FROM d
  UNION
  SELECT l.x, r.c FROM (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link) l
  JOIN reach r ON r.doc_id = l.y
)
SELECT doc_id, CAST(size AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM n JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""
