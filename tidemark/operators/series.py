"""Counters and gauges: deltas, rates, fills, rollups and window totals.

A counter only grows, except that it falls back when its source restarts; a gauge is a value that
may be missing between probes. Every function takes the series key columns first, so that series
run in parallel; one very long series is cut in time by `tidemark.operators.slices`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clamped_delta, col, in_window, ratio, seconds_between
from tidemark.operators.slices import AUTO, Cuts, sliced
from tidemark.operators.sync import prune


def with_previous(
    frame: DataFrame,
    series: Sequence[str],
    ts: str,
    columns: Sequence[str],
    name: str = "previous",
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Add a struct of the series' previous row (`ts` and `columns`), NULL on the first."""
    here = frame.withColumn("_here", F.struct(ts, *columns))
    s = sliced(here, series, [ts], ["_here"], cuts)
    return s.done(s.rows.withColumn(name, F.lag("_here").over(s.window()))).drop("_here")


def counter_delta(
    frame: DataFrame,
    series: Sequence[str],
    ts: str,
    columns: Sequence[str],
    prefix: str = "d_",
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Growth since the previous sample. A reset, and a series' first sample, count as 0."""
    rows = with_previous(frame, series, ts, columns, "_previous", cuts)
    deltas = {prefix + c: clamped_delta(F.col(c), F.col("_previous")[c]) for c in columns}
    return rows.withColumns(deltas).drop("_previous")


def counter_rate(
    frame: DataFrame,
    series: Sequence[str],
    ts: str,
    columns: Sequence[str],
    scale: float = 1.0,
    prefix: str = "rate_",
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Growth per second over `scale`; NULL without a predecessor or without time passing.

    With a counter of busy microseconds and a scale of 1e6 this is the number of busy cores.
    """
    rows = with_previous(frame, series, ts, columns, "_previous", cuts)
    elapsed = seconds_between(ts, F.col("_previous")[ts]) * F.lit(float(scale))
    rates = {
        prefix + c: ratio(clamped_delta(F.col(c), F.col("_previous")[c]), elapsed)
        for c in columns
    }
    return rows.withColumns(rates).drop("_previous")


def forward_fill(
    frame: DataFrame,
    series: Sequence[str],
    ts: str,
    columns: Sequence[str],
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Replace each NULL by the column's last known value; NULL stays before the first."""
    s = sliced(frame, series, [ts], columns, cuts)
    filled = {c: F.last(c, ignorenulls=True).over(s.upto()) for c in columns}
    return s.done(s.rows.withColumns(filled)).select(*frame.columns)


@dataclass(frozen=True)
class Rollup:
    """What an hourly rollup computes; each entry is output name -> source column.

    `gauges` give `<name>_avg` and `<name>_max`, `peaks` only `<name>_max`, `counters` the growth
    `<name>_sum`, and `rates` (column, scale) give `<name>_avg` and `<name>_max` of the rate.
    """

    gauges: Mapping[str, str] = field(default_factory=dict)
    peaks: Mapping[str, str] = field(default_factory=dict)
    counters: Mapping[str, str] = field(default_factory=dict)
    rates: Mapping[str, tuple[str, float]] = field(default_factory=dict)

    def sources(self) -> list[str]:
        monotonic = [*self.counters.values(), *[c for c, _ in self.rates.values()]]
        return list(dict.fromkeys(monotonic))


def hourly_rollup(
    frame: DataFrame,
    series: Sequence[str],
    ts: str,
    rollup: Rollup,
    unit: str = "hour",
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """One row per series and hour: sample count, averages, peaks and counter growth.

    A delta belongs to the hour of its later sample, also when it spans the edge. `anchored`
    tells whether the hour's first sample had a predecessor, i.e. whether its growth is whole.
    """
    rows = with_previous(frame, series, ts, rollup.sources(), "_previous", cuts)
    previous = F.col("_previous")
    elapsed = seconds_between(ts, previous[ts])
    measured = {"_anchored": previous.isNotNull()}
    for name, c in rollup.counters.items():
        measured[f"_c_{name}"] = clamped_delta(F.col(c), previous[c])
    for name, (c, scale) in rollup.rates.items():
        measured[f"_r_{name}"] = ratio(
            clamped_delta(F.col(c), previous[c]), elapsed * F.lit(float(scale))
        )
    out = [F.count(F.lit(1)).alias("samples")]
    for name in rollup.rates:
        out += [F.avg(f"_r_{name}").alias(f"{name}_avg"), F.max(f"_r_{name}").alias(f"{name}_max")]
    for name, c in rollup.gauges.items():
        out += [F.avg(c).alias(f"{name}_avg"), F.max(c).alias(f"{name}_max")]
    for name, c in rollup.peaks.items():
        out.append(F.max(c).alias(f"{name}_max"))
    for name in rollup.counters:
        out.append(F.sum(f"_c_{name}").alias(f"{name}_sum"))
    out.append(F.bool_and("_anchored").alias("anchored"))
    bucket = F.date_trunc(unit, F.col(ts)).alias("bucket")
    return rows.withColumns(measured).groupBy(*series, bucket).agg(*out)


def rollup_and_prune(
    raw: DataFrame,
    hourly: DataFrame,
    series: Sequence[str],
    ts: str,
    rollup: Rollup,
    as_of: Column,
    raw_retention: Column,
    hourly_retention: Column,
) -> tuple[DataFrame, DataFrame]:
    """Fold the raw samples into the hourly table, then drop what is past its retention.

    Returns (raw rows to keep, hourly rows to keep). An hour that the retention edge cuts through
    keeps the value it had when it was whole, and so does an hour whose predecessor sample is gone;
    running this any number of times therefore gives the same table.
    """
    edge = as_of - raw_retention
    keys, columns = [*series, "bucket"], hourly.columns
    old = hourly.select(*keys, F.struct(*columns).alias("_old"))
    new = hourly_rollup(raw, series, ts, rollup).select(*keys, F.struct(*columns).alias("_new"))
    both = old.join(new, keys, "full_outer")
    whole = (F.col("bucket") >= edge) & F.col("_new")["anchored"]
    row = F.when(whole | F.col("_old").isNull(), F.coalesce("_new", "_old")).otherwise(F.col("_old"))
    merged = both.select(row.alias("_row")).select(*[F.col("_row")[c].alias(c) for c in columns])
    return prune(raw, ts, as_of, raw_retention), prune(merged, "bucket", as_of, hourly_retention)


def window_total(
    frame: DataFrame,
    series: Sequence[str],
    ts: str,
    column: str,
    t_from: Column,
    t_to: Column,
    lookback: Column,
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Counter growth inside [t_from, t_to] per series, as `total`.

    Reads from `lookback` before the window, so that its first sample has a predecessor, and clips
    after the deltas are known. A gap longer than the lookback loses that one delta.
    """
    reach = frame.where(in_window(ts, t_from - lookback, t_to)).select(*series, ts, column)
    deltas = counter_delta(reach, series, ts, [column], "_d_", cuts)
    return (
        deltas.where(in_window(ts, t_from, t_to))
        .groupBy(*series)
        .agg(F.sum(f"_d_{column}").alias("total"))
    )


def growth_per_day(
    frame: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    t_from: Column,
    t_to: Column,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """`<c>_growth` (max - min) and `<c>_per_day` of counters inside a window, per key.

    The rate divides by the observed span in days, but by no less than one day. A reset inside
    the window makes max - min too large; `window_total` is the form that survives resets.
    `extra` are further aggregates to compute along with them.
    """
    growths = [(F.max(c) - F.min(c)).alias(f"{c}_growth") for c in columns]
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(86_400e6)
    grown = (
        frame.where(in_window(ts, t_from, t_to))
        .groupBy(*keys)
        .agg(*growths, *extra, F.greatest(span, F.lit(1.0)).alias("days"))
    )
    return grown.withColumns(
        {f"{c}_per_day": F.col(f"{c}_growth") / F.col("days") for c in columns}
    )


def latest_non_null(frame: DataFrame, series: Sequence[str], ts: str, column: str) -> DataFrame:
    """The last known value of a column per series."""
    known = frame.where(F.col(column).isNotNull())
    return known.groupBy(*series).agg(F.max_by(column, ts).alias(column))


def top_k(frame: DataFrame, order: str | Column, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows with the largest `order`, NULLs last, `tie` making the choice unique."""
    return frame.orderBy(col(order).desc_nulls_last(), *[F.asc(c) for c in tie]).limit(k)


def sum_devices(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Add up the devices (or interfaces) of a host per sample."""
    return frame.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns])


def total_by(frame: DataFrame, series: Sequence[str], ts: str, unit: str, columns: Sequence[str]):
    """Sums of already differenced columns per `unit`: monthly totals from hourly growth."""
    period = F.date_trunc(unit, F.col(ts)).alias(unit)
    return frame.groupBy(*series, period).agg(*[F.sum(c).alias(c) for c in columns])


def collapse(
    frame: DataFrame, key: str, text: str, sums: Sequence[str], length: int = 2000
) -> DataFrame:
    """One row per id: the smallest text, cut to `length`, and summed measures; NULL ids go."""
    return (
        frame.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min(F.substring(text, 1, length)).alias(text), *[F.sum(c).alias(c) for c in sums]
        )
    )
