"""Near-duplicate embeddings by int8 tile products with quantisation error bounds.

1. Equal vectors are put together under their smallest id with the number of their copies.
2. Every distinct vector has a home cell, its nearest centre. The centres are fitted on a
   bounded sample (``SAMPLE`` vectors, the first in hash order) and only decide which vectors
   lie side by side; every vector is placed.
3. The vectors of one length, in the order of their cells, are packed into blocks of bounded
   size, so a cell that holds a third of all vectors fills several. Each pair of blocks is a
   tile; tiles are read from the packed files and nothing is shuffled for them.
4. In a tile, two cells are left out only if the angle between their means, less the angles of
   their farthest members, is above that of the threshold: none of their pairs can link.
5. All other pairs are compared. Vectors are rounded to int8; with ``x = q + r``, the product of
   two unit vectors differs from that of their rounded forms by at most
   ``|r_x| + (1 + |r_x|) |r_y|``; only pairs that may reach the threshold by this bound are
   computed in double precision. A tile returns a count and a local root for each vector that
   has a link, never its pairs.
6. Local roots are contracted to components over all tiles.

No pair is lost, so the work grows with the square of the distinct vectors wherever cells do not
set them apart.

Defined results: null or empty vectors, zero vectors, vectors with a null or non-finite
component and rows without an id link with nothing; vectors of different length never link;
repeated rows of one id count as one vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reviewloom.llm.components import components
from reviewloom.llm.store import prepared, staged
from reviewloom.session import scratch_dir

THRESHOLD = 0.95
SAMPLE = 16_384
CELL, MAX_CELLS = 256, 4096
# Rows of a block at most, and its bytes, which bound the rows of long vectors.
BLOCK, BLOCK_BYTES = 8192, 4 << 20
_SLACK = 1e-5
# What a component may lose in single precision, for each dimension.
_ROUNDING = 2.4e-7


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors as doubles; None where a vector is unusable."""
    lists, out = column.to_pylist(), []
    for values in lists:
        x = None if not values or None in values else np.array(values, dtype=np.float64)
        usable = x is not None and np.isfinite(x).all() and np.isfinite(n := x @ x) and n > 0
        out.append(x if usable else None)
    return out


def _keyed(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [None if x is None else x.tobytes() for x in _rows(batch.column("embedding"))]
            keys = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(coded, pa.binary())],
                names=["vec_id", "key", "vector"])

    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(
        run, "vec_id bigint, key binary, vector binary")


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Unit centres by spherical k-means; ``sample`` holds unit vectors in a fixed order."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _placed(distinct: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each vector with its home cell; all vectors of any other length than the centres' have one cell."""
    shared = distinct.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            raw = [np.frombuffer(x, np.float64) for x in batch.column("vector").to_pylist()]
            homes = np.zeros(len(raw), np.int64)
            fitting = [k for k, x in enumerate(raw) if len(centres) and len(x) == centres.shape[1]]
            if fitting:
                x = np.stack([raw[k] for k in fitting])
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                homes[fitting] = np.argmax(x @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(homes), batch.column("vec_id"), batch.column("copies"), batch.column("vector")],
                names=["home", "vec_id", "copies", "vector"])

    return distinct.select("vec_id", "copies", "vector").mapInArrow(
        run, "home bigint, vec_id bigint, copies bigint, vector binary")


def _packed(placed: DataFrame, block: int) -> DataFrame:
    """One row for each block of about ``block`` vectors of one length: their ids, copies, homes and components.

    A vector's place is that of its cell among the cells of its length, and a hash within the cell.
    """
    spark = placed.sparkSession
    placed = placed.withColumn("bytes", F.length("vector"))
    before = Window.partitionBy("bytes").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    cells = placed.groupBy("bytes", "home").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / F.col("bytes"))))
    place = F.col("before") + F.pmod(F.xxhash64("vec_id"), F.col("n"))
    dealt = placed.join(cells, ["bytes", "home"]).withColumn("block", F.floor(place / rows).cast("bigint"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("home", "ascending"), ("vec_id", "ascending")])
        joined = [b"".join(table.column("vector").to_pylist())]
        numbers = [[table.column(c).combine_chunks().to_numpy().tobytes()] for c in ("vec_id", "copies", "home")]
        return pa.table([
            table.column("bytes")[:1], table.column("block")[:1], *[pa.array(x, pa.binary()) for x in (*numbers, joined)]],
            names=["bytes", "block", "ids", "copies", "homes", "vectors"])

    schema = "bytes int, block bigint, ids binary, copies binary, homes binary, vectors binary"
    packed = dealt.select("bytes", "block", "home", "vec_id", "copies", "vector").groupBy("bytes", "block").applyInArrow(
        pack, schema)
    # A file for each block, as a task of the next step reads whole files.
    path = scratch_dir(spark, "blocks")
    packed.write.option("maxRecordsPerFile", 1).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _coded(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Norms, unit vectors as their int8 forms stand for them, and the length of what that leaves out."""
    norms = np.linalg.norm(raw, axis=1)
    unit = raw / norms[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    rounded = np.rint(unit / scale[:, None]).astype(np.int8)
    form = rounded * scale[:, None]
    # In single precision as long as its error is far below that of the rounding.
    kind = np.float32 if raw.shape[1] * _ROUNDING < 2.5e-4 else np.float64
    return norms, form.astype(kind), np.linalg.norm(unit - form, axis=1)


def _linked(raw: np.ndarray, coded: tuple, first: np.ndarray, second: np.ndarray, threshold: float):
    """Linked index pairs of bounded parts of ``first`` and ``second``, and how many were computed in double precision."""
    norms, form, error = coded
    slack = _SLACK + raw.shape[1] * _ROUNDING
    theirs, their_error = form[second].T, error[second]
    most = their_error.max(initial=0)
    for at in range(0, len(first), 256):
        ours = first[at : at + 256]
        e = error[ours]
        product = form[ours] @ theirs
        least = (threshold - slack - e - (1 + e) * most).astype(product.dtype)
        hits = np.flatnonzero(product >= least[:, None])
        for low in range(0, len(hits), 1 << 16):
            a, b = np.divmod(hits[low : low + (1 << 16)], len(second))
            near = product[a, b] + e[a] + (1 + e[a]) * their_error[b] + slack >= threshold
            x, y = ours[a[near]], second[b[near]]
            cosine = np.einsum("ij,ij->i", raw[x], raw[y]) / (norms[x] * norms[y])
            linked = cosine >= threshold
            yield x[linked], y[linked], len(x)


def tile_links(raw: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float):
    """Index pairs ``(a in first, b in second)`` with a cosine of at least ``threshold``.

    Also returns how many pairs were computed in double precision.
    """
    none = np.zeros(0, np.int64)
    found = [(none, none, 0), *_linked(raw, _coded(raw), first, second, threshold)]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), sum(x[2] for x in found)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links ``a, b``; a root is the smallest index of its component so far."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]


def _cells(unit: np.ndarray, homes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of each cell, the direction of its mean, and the angle of the member farthest from it."""
    cells = np.split(np.arange(len(homes)), np.flatnonzero(np.diff(homes)) + 1)
    means = np.stack([unit[rows].mean(axis=0) for rows in cells])
    norms = np.linalg.norm(means, axis=1, keepdims=True)
    # Without a direction any unit vector serves, as the angles are measured from it.
    means = np.where(norms > 1e-9, means / np.maximum(norms, 1e-9), unit[[rows[0] for rows in cells]])
    reach = [np.arccos(np.clip(unit[rows] @ mean, -1, 1)).max() for rows, mean in zip(cells, means)]
    return cells, means, np.array(reach)


def _compare(threshold: float):
    """Counts and local roots of the tiles ``a_*, b_*``, one tile at a time."""
    angle = np.arccos(np.clip(threshold, -1, 1)) + 1e-6

    def tile(row: dict) -> pa.RecordBatch:
        sides = "a" if row["a_block"] == row["b_block"] else "ab"
        numbers = {c: np.concatenate([np.frombuffer(row[f"{x}_{c}"], np.int64) for x in sides])
                   for c in ("ids", "copies", "homes")}
        dims = row["a_bytes"] // 8
        raw = np.concatenate([np.frombuffer(row[f"{x}_vectors"], np.float64).reshape(-1, dims) for x in sides])
        order = np.argsort(numbers["ids"], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # so that the smallest place has the smallest id
        coded = _coded(raw)
        unit = raw / coded[0][:, None]
        n = len(np.frombuffer(row["a_ids"], np.int64))
        ours = _cells(unit[:n], numbers["homes"][:n])
        theirs = ours if sides == "a" else _cells(unit[n:], numbers["homes"][n:])
        offset = 0 if sides == "a" else n
        counts, root = np.zeros(len(raw), np.int64), np.arange(len(raw))
        for k, (rows, mean, reach) in enumerate(zip(*ours)):
            apart = np.arccos(np.clip(theirs[1] @ mean, -1, 1)) - reach - theirs[2]
            close = [c for c in np.flatnonzero(apart <= angle).tolist() if sides == "ab" or c >= k]
            if not close:
                continue
            second = np.concatenate([theirs[0][c] for c in close]) + offset
            for a, b, _ in _linked(raw, coded, rows, second, threshold):
                if sides == "a":
                    a, b = a[a < b], b[a < b]
                np.add.at(counts, a, numbers["copies"][b])
                np.add.at(counts, b, numbers["copies"][a])
                root = _joined(root, place[a], place[b])
        some = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (numbers["ids"][some], counts[some], numbers["ids"][order][root[place[some]]])],
            names=["vec_id", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield tile(batch.slice(k, 1).to_pylist()[0])

    return run


def _tile_links(packed: DataFrame, threshold: float) -> DataFrame:
    """``vec_id, n, root`` of each tile that holds links of the vector."""
    spark = packed.sparkSession
    a, b = (packed.select([F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in "ab")
    tiles = a.hint("shuffle_replicate_nl").join(
        b, (F.col("a_bytes") == F.col("b_bytes")) & (F.col("a_block") <= F.col("b_block")))
    prepared(spark, rows=1)  # a tile holds two blocks
    part = staged(tiles.mapInArrow(_compare(threshold), "vec_id bigint, n bigint, root bigint"), "tile-links")
    prepared(spark)
    return part


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``."""
    prepared(vectors.sparkSession)
    keyed = staged(_keyed(vectors), "vectors")
    usable = keyed.where("vec_id IS NOT NULL AND key IS NOT NULL").dropDuplicates(["vec_id", "key"])
    copies = usable.groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    distinct = staged(usable.join(copies, ["key", "vec_id"]).select("key", "vec_id", "copies", "vector"), "distinct")
    dims = distinct.groupBy(F.length("vector").alias("bytes")).count().orderBy(F.desc("count"), "bytes").first()
    centres = np.zeros((0, 0), np.float32)
    if dims:
        drawn = distinct.where(F.length("vector") == dims["bytes"]).orderBy(
            F.xxhash64("key"), "key").select("vector").limit(sample).collect()
        x = np.stack([np.frombuffer(r["vector"], np.float64) for r in drawn])
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        centres = fit_centres(x, max(1, min(MAX_CELLS, dims["count"] // cell)))
    part = _tile_links(_packed(_placed(distinct, centres), block), threshold)
    found = components(part, "vec_id", "root").withColumnRenamed("node", "vec_id")
    counted = part.groupBy("vec_id").agg(F.sum("n").alias("n"))
    known = distinct.join(counted, "vec_id", "left").join(found, "vec_id", "left").select(
        "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    out = keyed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(
        known, "key", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each embedding."""
    prepared(spark)
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS c FROM embeddings
  UNION
  SELECT l.a, r.c FROM link l JOIN reach r ON r.vec_id = l.b
)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, m.component_id,
  e.vec_id = m.component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY vec_id) m
  ON m.vec_id = e.vec_id
"""
