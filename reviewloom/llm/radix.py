"""Distributed LSD radix sort: exact ranks by composite integer keys.

Each key is cut into digits of at most ``RADIX_BITS`` bits. From the least significant digit
of the last key to the most significant of the first, one stable counting-sort pass moves
every row to its place by that digit:

1. Rows lie in chunks of at most ``2 ** CHUNK_BITS`` consecutive positions; count the rows
   of each (chunk, digit).
2. Global prefix offsets: where the rows of a (chunk, digit) begin is the number of rows with
   a smaller digit, and of those with the same digit in earlier chunks.
3. The new position of a row is that offset plus its place among the rows of its (chunk,
   digit), which keep their order.

After the last pass the position is the rank. No task ever holds more than one chunk's rows
of one digit at a time, however many rows share a key. Between two passes the rows are
written to the shared folder, so a lost executor repeats one pass at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reviewloom.llm.store import staged

RADIX_BITS = 11
CHUNK_BITS = 13
#: The counts of so many chunks (as a power of two) are added up together.
_GROUP_BITS = 10
_SIGN = -(1 << 63)


def _bits(value: Column, descending: bool, low: int, high: int) -> tuple[Column, int]:
    """A column whose bits, read as unsigned, are in the wanted order, and how many of them differ."""
    if high - low < 1 << 63:
        return (F.lit(high) - value if descending else value - F.lit(low)), (high - low).bit_length()
    flipped = value.bitwiseXOR(F.lit(_SIGN))
    return (F.bitwise_not(flipped) if descending else flipped), 64


def _digits(width: int) -> list[tuple[int, int]]:
    """``(shift, bits)`` of the digits of a key, least significant first, of about equal size."""
    passes = -(-width // RADIX_BITS)
    cuts = [width * k // passes for k in range(passes + 1)] if passes else []
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _offsets(counts: DataFrame) -> DataFrame:
    """First position of each ``(chunk, digit)``.

    Counts of the same digit are added up within groups of chunks and over the groups, so
    that no window covers all chunks. Totals of the digits are at most 2^RADIX_BITS rows.
    """
    grouped = counts.withColumn("part", F.shiftright("chunk", _GROUP_BITS))
    parts = grouped.groupBy("digit", "part").agg(F.sum("n").alias("n"))
    totals = sorted((r["digit"], r["n"]) for r in parts.groupBy("digit").agg(F.sum("n").alias("n")).collect())
    starts, at = [], 0
    for digit, n in totals:
        starts.append((digit, at))
        at += n
    smaller = F.broadcast(counts.sparkSession.createDataFrame(starts, "digit bigint, smaller bigint"))
    over = Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("digit", "part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("digit", "part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return (
        grouped.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(before, ["digit", "part"]).join(smaller, "digit")
        .select("chunk", "digit", (F.col("smaller") + F.col("earlier") + F.col("inside")).alias("start")))


def _sorted_by(rows: DataFrame, digit: Column) -> DataFrame:
    """One stable counting-sort pass: ``position`` becomes that of the order by one digit."""
    placed = rows.withColumns({"chunk": F.shiftright("position", CHUNK_BITS), "digit": digit.cast("bigint")})
    offsets = _offsets(placed.groupBy("chunk", "digit").agg(F.count(F.lit(1)).alias("n")))
    within = F.row_number().over(Window.partitionBy("chunk", "digit").orderBy("position")) - 1
    return placed.withColumn("within", within).join(offsets, ["chunk", "digit"]).withColumn(
        "position", F.col("start") + F.col("within")).drop("chunk", "digit", "within", "start")


def ranked(rows: DataFrame, keys: list[tuple[Column, bool]], into: str) -> DataFrame:
    """``rows`` with ``into``: 0 for the first row in the order of ``keys``, then 1, 2, ...

    Keys are integers without nulls, most significant first, each with whether it descends.
    Rows equal in all keys get neighbouring ranks, in the order in which they were first written.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns]
    start = rows.select(
        F.struct(*columns).alias("row"), *[value.cast("bigint").alias(f"key{i}") for i, (value, _) in enumerate(keys)])
    # Positions are written once: rows of one input partition follow each other without gaps.
    state = staged(start.withColumn("position", F.monotonically_increasing_id()), "radix")
    ends = state.agg(*[
        f(f"key{i}").alias(f"{name}{i}") for i in range(len(keys)) for name, f in (("low", F.min), ("high", F.max))]).first()
    digits = []
    if ends["low0"] is not None:
        for i in reversed(range(len(keys))):
            bits, width = _bits(F.col(f"key{i}"), keys[i][1], ends[f"low{i}"], ends[f"high{i}"])
            digits += [F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in _digits(width)]
    for digit in digits or [F.lit(0)]:
        state = staged(_sorted_by(state, digit), "radix")
    own = [F.col(f"row.`{c}`") for c in rows.columns if c.lower() != into.lower()]
    return state.select(*own, F.col("position").alias(into))
