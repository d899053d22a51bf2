"""Ordered windows that survive a hot key.

A window `PARTITION BY key ORDER BY ts` puts all rows of one key in one task. When a single key
holds a third of a very large table, that task never ends. Here such keys, and only those, are
cut into consecutive time slices of about equal row count, the window runs per (key, slice), and
each slice starts with one extra *carry row* that holds the state the earlier slices left behind.
Keys of ordinary size keep the plain window and pay nothing.

The cut points are found the way a distributed sort finds its ranges: one pass over the key and
time columns before the main job. They end up as literals, so a retried task cuts its rows in
exactly the same places. Their number is bounded by `MAX_SLICES` whatever the size of the data,
which is what makes it safe to collect and broadcast them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

ROWS_PER_TASK = 4_000_000
"""A key with at most this many rows is handled by one task."""

MAX_SLICES = 16_384
"""Upper bound on the slices of all hot keys together (up to rounding)."""

AUTO: Any = object()
"""Default of the `cuts` arguments: look for hot keys before planning."""

SLICE = "_slice"
_CUTS, _CARRY = "_cuts", "_carry"
_ALL = "_all"


@dataclass(frozen=True)
class Cuts:
    """The hot keys and where their timelines are cut: one row per hot key.

    `longest` is the largest number of cut points that a key has.
    """

    table: DataFrame
    by: tuple[str, ...]
    longest: int


def find_cuts(
    frame: DataFrame,
    by: Sequence[str],
    ts: str,
    rows_per_task: int | None = None,
    max_slices: int | None = None,
) -> Cuts | None:
    """Find the keys with too many rows for one task, and cut points for each of them.

    Fewer than `max_slices` keys can exceed the target, because the target is never below
    `total / max_slices`; each contributes its row count over the target in cut points. So the
    driver sees at most about two times `max_slices` values.
    """
    rows_per_task = rows_per_task or ROWS_PER_TASK
    max_slices = max_slices or MAX_SLICES
    frame, by = _keyed(frame, by)
    thin = frame.select(*by, ts)
    total = thin.count()
    if total <= rows_per_task:
        return None
    target = max(rows_per_task, total // max_slices)
    hot = thin.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > target)
    sizes = hot.collect()
    if not sizes:
        return None

    spark = frame.sparkSession
    hot_table = spark.createDataFrame(sizes, hot.schema)
    grid = -(-max(r["_rows"] for r in sizes) // target)
    fractions = [i / grid for i in range(1, grid)]
    # Every hot key gets the grid of the largest one; the smaller ones keep each n-th point.
    quantiles = (
        _match(thin, F.broadcast(hot_table), by, "inner")
        .groupBy(*by)
        .agg(
            F.max("_rows").alias("_rows"),
            F.percentile_approx(ts, fractions, max(10_000, 20 * grid)).alias("_grid"),
        )
        .withColumn("_stride", F.ceil(F.lit(grid) / F.ceil(F.col("_rows") / target)))
        .select(
            *by,
            F.array_distinct(
                F.filter("_grid", lambda x, i: (i + 1) % F.col("_stride") == 0)
            ).alias(_CUTS),
        )
    )
    rows = quantiles.collect()
    table = spark.createDataFrame(rows, quantiles.schema)
    return Cuts(table, tuple(by), max(len(r[_CUTS]) for r in rows))


@dataclass(frozen=True)
class Sliced:
    """A frame ready for ordered windows; see `sliced`."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    split: bool

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def before(self) -> WindowSpec:
        """All rows before the current one."""
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def upto(self) -> WindowSpec:
        """All rows before the current one, and the current one."""
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def done(self, frame: DataFrame) -> DataFrame:
        """Drop the carry rows and the helper columns."""
        if self.split:
            frame = frame.where(~F.col(_CARRY)).drop(_CUTS, SLICE, _CARRY)
        return frame.drop(_ALL)


def sliced(
    frame: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    state: Sequence[str],
    cuts: Cuts | None = AUTO,
    reverse: bool = False,
) -> Sliced:
    """Prepare `frame` for windows over `by`, ordered by `order`.

    Args:
        frame: The rows. The first order column is the timeline that hot keys are cut along;
            together the order columns should order the rows of a key completely.
        by: Key columns; NULL is a key of its own, as in a window. Without any, all rows are one
            series.
        order: Order columns, NULLs first.
        state: Columns of which the last non-NULL value so far is what a later row may ask for.
            Carry rows hold these and the keys, everything else in them is NULL. To reach the
            previous row itself (`lag`), pass a struct column that is never NULL.
        cuts: Cut points from `find_cuts`, None for none, or AUTO to look for them.
        reverse: The exact opposite order, so that "before" means later rows.
    """
    (frame, by), order = _keyed(frame, by), list(order)
    if cuts is AUTO:
        cuts = find_cuts(frame, by, order[0])
    direction = F.desc_nulls_last if reverse else F.asc_nulls_first
    ordering = tuple(direction(c) for c in order)
    if cuts is None:
        return Sliced(frame, tuple(by), ordering, False)

    marked = with_slice(frame, cuts, by, order[0])
    spine = cuts.table.select(
        *by, F.explode(F.sequence(F.lit(0), F.size(_CUTS))).alias(SLICE)
    )
    # Only rows of hot keys are summarised, and the map side reduces them to one row per slice.
    rank = F.struct(*order)
    pick = F.min_by if reverse else F.max_by
    last = (
        marked.where(F.col(_CUTS).isNotNull())
        .groupBy(*by, SLICE)
        .agg(*[pick(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in state])
    )
    ends = _match(spine, last, [*by, SLICE], "left")
    slice_order = F.desc(SLICE) if reverse else F.asc(SLICE)
    earlier = (
        Window.partitionBy(*by)
        .orderBy(slice_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = ends.select(
        *by,
        SLICE,
        *[F.last(c, ignorenulls=True).over(earlier).alias(c) for c in state],
        F.lit(True).alias(_CARRY),
    ).where(" OR ".join(f"`{c}` IS NOT NULL" for c in state))
    rows = marked.withColumn(_CARRY, F.lit(False)).unionByName(carry, allowMissingColumns=True)
    first = F.desc(_CARRY)
    return Sliced(rows, (*by, SLICE), (first, *ordering), True)


def running_count(
    frame: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str,
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """`row_number() OVER (PARTITION BY by ORDER BY order)` as column `name`."""
    by, order = list(by), list(order)
    if cuts is AUTO:
        cuts = find_cuts(frame, by, order[0])
    if cuts is None:
        return frame.withColumn(
            name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        )
    marked = with_slice(frame, cuts, by, order[0])
    earlier = (
        Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per slice of a hot key: bounded like the cuts themselves.
    offsets = (
        marked.where(F.col(_CUTS).isNotNull())
        .groupBy(*by, SLICE)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*by, SLICE).orderBy(*order)
    numbered = marked.withColumn("_within", F.row_number().over(within))
    return (
        _match(numbered, F.broadcast(offsets), [*by, SLICE], "left")
        .withColumn(
            name, (F.col("_within") + F.coalesce("_offset", F.lit(0))).cast("int")
        )
        .drop(_CUTS, SLICE, "_within", "_offset")
    )


def running_sum(
    frame: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """`sum(value) OVER (PARTITION BY by ORDER BY order ROWS UNBOUNDED PRECEDING)` as column `name`."""
    by, order = list(by), list(order)
    if cuts is AUTO:
        cuts = find_cuts(frame, by, order[0])
    ordering = [F.asc_nulls_first(c) for c in order]
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, 0)
    if cuts is None:
        return frame.withColumn(name, F.sum(value).over(upto(*by)))
    marked = with_slice(frame, cuts, by, order[0])
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per slice of a hot key: bounded like the cuts themselves.
    offsets = (
        marked.where(F.col(_CUTS).isNotNull())
        .groupBy(*by, SLICE)
        .agg(F.sum(value).alias("_in_slice"))
        .select(*by, SLICE, F.coalesce(F.sum("_in_slice").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = marked.withColumn(name, F.sum(value).over(upto(*by, SLICE)))
    return (
        _match(within, F.broadcast(offsets), [*by, SLICE], "left")
        .withColumn(name, F.col(name) + F.coalesce("_offset", F.lit(0)))
        .drop(_CUTS, SLICE, "_offset")
    )


def _keyed(frame: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key for a frame without one, so that its one series can be cut like any other."""
    return (frame, list(by)) if by else (frame.withColumn(_ALL, F.lit(0)), [_ALL])


def with_slice(frame: DataFrame, cuts: Cuts, by: list[str], ts: str) -> DataFrame:
    """Add the slice number: how many cut points of the row's key are at or below its time."""
    joined = _match(frame, F.broadcast(cuts.table), by, "left")
    # Binary search, one step per projection: cheap for thousands of slices, and in codegen.
    found = joined.withColumn(SLICE, F.lit(0))
    for bit in reversed(range(max(cuts.longest.bit_length(), 1))):
        size = F.lit(1 << bit)
        probe = F.try_element_at(F.col(_CUTS), F.col(SLICE) + size)
        step = F.when(probe <= F.col(ts), size).otherwise(F.lit(0))
        found = found.withColumn(SLICE, F.col(SLICE) + step)
    return found


def _match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns, NULL matching NULL; keeps the left copy of the columns."""
    renamed = right
    for c in on:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
    condition = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in on]
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])
