"""Per-key ranking that stays distributed when one key owns a large share of the rows.

A plain window puts every row of a key into one task. The helpers here only ever
window over groups with a known bound: k rows per map task, k rows per salt, one
bucket of an ordered key, or one slice of such a bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewloom.session import staged

# Above this many rows per key a top-k is first taken within hash slices of the key.
_SLICED_FROM = 500
_SLICES = 128
# Expected rows of a slice of an ordered bucket, for keys that may put any share of their rows into one.
SLICE_ROWS = 65_536
# Copies of the few cuts, so that the rows of one bucket look them up in as many tasks.
_SALTS = 128
# Up to so many cuts in all, a few dozen bytes each, go to every executor and the rows stay where they are.
_BROADCAST_CUTS = 500_000
# Halving steps that find a place in a list; longer lists than 2 ** _STEPS do not occur, as they hold square roots.
_STEPS = 20


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str
) -> DataFrame:
    """Rows ranked 1..k per key.

    ``row_number() <= k`` is planned with a map-side group limit, so a hot key sends
    at most k rows per map task. For a large k the key is first cut into hash slices
    and each slice keeps its own k rows; the exact answer is always among them.
    """
    if k > _SLICED_FROM:
        slice_col = "__slice"
        sliced = df.withColumn(slice_col, F.pmod(F.xxhash64(*df.columns), F.lit(_SLICES)))
        window = Window.partitionBy(*keys, slice_col).orderBy(*order)
        df = (
            sliced.withColumn(rank_col, F.row_number().over(window))
            .where(F.col(rank_col) <= k)
            .drop(slice_col, rank_col)
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return top_k(df, keys, order, 1, "__first").drop("__first")


def _sliced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, slice_rows: int | None
) -> tuple[DataFrame, list[str]]:
    """Rows with the columns of their ordered group below the key, and the names of those columns.

    Without ``slice_rows`` the group is the bucket. With it a bucket is cut where a hash of the
    order columns says so, once in about ``slice_rows`` rows: every run finds the same cuts, a
    small bucket has none, and one of n rows has about n / slice_rows. Rows equal in all order
    columns stay in one slice. The cuts of a bucket are dealt to blocks, about as many as a block
    has cuts; a row finds its block first, then its place in it, so no row carries all of them.
    The rows are not yet dealt by these columns (see :func:`_dealt`).
    """
    tagged = df.withColumn("__bucket", bucket)
    if slice_rows is None:
        return tagged, ["__bucket"]
    group = [*keys, "__bucket"]
    place = F.struct(*order)
    drawn = F.pmod(F.xxhash64(*keys, *order), F.lit(slice_rows)) == 0
    # Written, as every run of the plan looks the same cuts up twice.
    found = staged(tagged.where(drawn).select(*group, place.alias("__cut")).distinct(), "cuts")
    n = found.count()
    if not n:
        return tagged, ["__bucket"]
    salts = 1 if n <= _BROADCAST_CUTS else _SALTS
    size = F.size("__cuts")
    lists = found.groupBy(*group).agg(F.sort_array(F.collect_list("__cut")).alias("__cuts")).withColumn(
        "__width", F.ceil(F.sqrt(size)).cast("int"))
    firsts = lists.select(
        *group, "__width", F.filter("__cuts", lambda _, i: i % F.col("__width") == 0).alias("__firsts"),
        F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("__salt"))
    blocks = lists.select(
        *group, "__width", "__cuts", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / F.col("__width")).cast("int"))).alias("__block")
    ).select(*group, "__block", F.slice("__cuts", F.col("__block") * F.col("__width") + 1, F.col("__width")).alias("__within"))
    if salts == 1:
        firsts, blocks = F.broadcast(firsts), F.broadcast(blocks)
    rows = (
        tagged.withColumn("__salt", F.pmod(F.xxhash64(*order, F.lit(1)), F.lit(salts)).cast("bigint"))
        .join(firsts, [*group, "__salt"], "left")
        .withColumn("__block", F.when(F.col("__firsts").isNotNull(), up_to("__firsts", place) - 1))
        .drop("__firsts", "__salt")
        .join(blocks, [*group, "__block"], "left")
        .withColumn("__slice", F.when(
            F.col("__within").isNotNull(), F.col("__block") * F.col("__width") + up_to("__within", place)).otherwise(0))
        .drop("__within", "__block", "__width")
    )
    return rows, ["__bucket", "__slice"]


def _dealt(tagged: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Rows by slice. Named in full: the partitioning by bucket that a join leaves would serve a window too."""
    return tagged.repartition(*keys, *parts) if "__slice" in parts else tagged


def up_to(cuts: str, place: Column, steps: int = _STEPS) -> Column:
    """Number of sorted ``cuts``, fewer than ``2 ** steps``, that are not after ``place``, by halving steps."""
    halves = F.array(*[F.lit(1 << bit) for bit in reversed(range(steps))])
    at = F.aggregate(halves, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(cuts)) & (F.get(cuts, at + step - 1) <= place), at + step).otherwise(at))
    return at


def _earlier(keys: Sequence[str], parts: Sequence[str]):
    return (
        Window.partitionBy(*keys).orderBy(*parts)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    into: str,
    previous: Mapping[str, str] | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Exact row number per key without windowing over the whole key.

    ``bucket`` must rise with ``order`` (for example the day of an ordered timestamp).
    Rows are numbered inside their bucket and shifted by the size of the earlier
    buckets; the shift is a window over one small row per bucket. ``previous`` maps
    columns to new columns that hold their value in the row before. ``slice_rows`` cuts
    buckets of more rows into slices, where one bucket may hold any share of a key.
    """
    previous = dict(previous or {})
    carried = F.struct(*[F.col(c).alias(name) for c, name in previous.items()]) if previous else None
    tagged, parts = _sliced(df, keys, order, bucket, slice_rows)
    summary = [F.count(F.lit(1)).alias("__n")]
    if previous:
        summary.append(F.max_by(carried, F.struct(*order)).alias("__last"))
    sizes = tagged.groupBy(*keys, *parts).agg(*summary)
    earlier = _earlier(keys, parts)
    offsets = sizes.withColumn("__shift", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    if previous:
        before = F.last("__last", ignorenulls=True).over(earlier)
        offsets = offsets.withColumn("__before", before).drop("__last")
    inside = Window.partitionBy(*keys, *parts).orderBy(*order)
    joined = _dealt(tagged, keys, parts).join(offsets.drop("__n"), [*keys, *parts])
    result = joined.withColumn(
        into, (F.row_number().over(inside) + F.col("__shift")).cast("bigint")
    )
    if previous:
        result = result.withColumn(
            "__row", F.coalesce(F.lag(carried).over(inside), F.col("__before"))
        )
        result = result.withColumns({name: F.col(f"__row.{name}") for name in previous.values()})
    return result.drop(*parts, "__shift", "__before", "__row")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    into: str,
    slice_rows: int | None = SLICE_ROWS,
    keep_parts: bool = False,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key, by the plan of :func:`numbered`.

    ``keep_parts`` leaves the columns that the rows are dealt by, so a grouping by them moves nothing.
    """
    tagged, parts = _sliced(df, keys, order, bucket, slice_rows)
    sums = tagged.groupBy(*keys, *parts).agg(F.sum(value).alias("__sum"))
    shifts = sums.select(
        *keys, *parts,
        F.coalesce(F.sum("__sum").over(_earlier(keys, parts)), F.lit(0)).alias("__shift"),
    )
    before = (
        Window.partitionBy(*keys, *parts).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    total = (
        _dealt(tagged, keys, parts).join(shifts, [*keys, *parts])
        .withColumn(into, F.coalesce(F.sum(value).over(before), F.lit(0)) + F.col("__shift"))
        .drop("__shift")
    )
    return total if keep_parts else total.drop(*parts)


def carried_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    value: str,
    into: str,
    slice_rows: int | None = None,
) -> DataFrame:
    """Last non-null ``value`` up to and including each row, per key.

    Same two-level plan as :func:`numbered`: the last value of each bucket comes from a
    map-side combined aggregate, only those summaries are windowed across the key.
    """
    tagged, parts = _sliced(df, keys, order, bucket, slice_rows)
    last_value = F.max_by(
        F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))
    ).alias("__last")
    summaries = tagged.groupBy(*keys, *parts).agg(last_value)
    before = summaries.select(
        *keys, *parts,
        F.last("__last", ignorenulls=True).over(_earlier(keys, parts)).alias("__before"),
    )
    inside = (
        Window.partitionBy(*keys, *parts).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _dealt(tagged, keys, parts).join(before, [*keys, *parts])
        .withColumn(
            into,
            F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("__before")),
        )
        .drop(*parts, "__before")
    )
