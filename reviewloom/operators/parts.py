"""Long ordered text in parts of a bounded number of bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.operators.ranking import SLICE_ROWS, running_total
from reviewloom.session import discard, scratch_dir, staged, written

#: Largest part in bytes of UTF-8.
PART_BYTES = 1 << 20


def byte_parts(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    text: str,
    max_bytes: int = PART_BYTES,
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """``keys, part, text``: the texts of each key, run together in order and cut at a size.

    The parts of a key in the order of ``part`` are its whole text; numbers may have gaps. A
    part has at most ``max_bytes`` bytes. Texts longer than an eighth of that many code points
    are cut by position first, between code points. Every piece then goes to the part that its
    first byte falls into, counted by running totals over slices of the key, so neither the
    size of one text nor the number of texts of a key has to fit into a task. ``order`` must
    be unique within a key, ``bucket`` must rise with it. Null texts count as empty; empty
    texts leave no row.
    """
    if max_bytes < 8:
        raise ValueError("a part has at least 8 bytes")
    half = max_bytes // 2
    # A code point has up to four bytes.
    chars = half // 4
    last = F.floor((F.greatest(F.char_length(text), F.lit(1)) - 1) / chars).cast("int")
    pieces = (
        rows.where(F.coalesce(text, F.lit("")) != "")
        .select(*keys, *order, text, bucket.alias("__of"), F.explode(F.sequence(F.lit(0), last)).alias("__piece"))
        .withColumn(text, F.substring(F.col(text), F.col("__piece") * chars + 1, F.lit(chars)))
        .withColumn("__bytes", F.octet_length(text).cast("bigint"))
    )
    # Written once: the cuts, the sums and the rows themselves are passes over them. The text breaks ties of the order.
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession, "pieces")
    written(pieces, path)
    placed = running_total(
        spark.read.schema(pieces.schema).parquet(path), keys, [*order, "__piece", text], F.col("__of"), "__bytes",
        "__start", slice_rows, keep_parts=True)
    part = F.floor(F.col("__start") / half).alias("part")

    def run_together(rows: DataFrame, *by: str | Column) -> DataFrame:
        entries = F.sort_array(F.collect_list(F.struct("__start", text)))
        return rows.groupBy(*by).agg(F.min("__start").alias("__start"), F.array_join(entries.getField(text), "").alias(text))

    # A part's pieces lie side by side; those of one slice are run together where they are, so that few texts move on.
    within = staged(run_together(
        placed, *keys, *[c for c in placed.columns if c in ("__bucket", "__slice")], part
    ).select(*keys, "part", "__start", text), "texts")
    discard(spark, path)
    return run_together(within, *keys, "part").drop("__start")
