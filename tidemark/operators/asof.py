"""As-of join: for every left row the latest right row at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import all_of, any_of
from tidemark.operators.slices import AUTO, Cuts, find_cuts, sliced


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    by: Sequence[str | tuple[str, str]],
    how: str = "left",
    prefix: str = "",
    strict: bool = False,
    forward: bool = False,
    unique_left: bool = False,
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Join each left row to one right row of the same key, the nearest in time.

    The plan is a union and one window, so the work is linear in both inputs; no pair of rows is
    ever compared. Unless the left rows are declared unique, the lookup runs on the distinct
    (key, time) points and its answer is joined back: many left rows at one time then cost one
    lookup, and a hot point is an ordinary skewed equi-join, which adaptive execution splits.

    Args:
        left: Rows to look up for. A NULL key or time finds nothing. Read more than once, so a
            costly derived table should be stored first (`tidemark.session.written`).
        right: Rows to find, unique on (key, time).
        left_ts: Time column of the left rows.
        right_ts: Time column of the right rows.
        by: Key columns, as a name that both sides share or as (left name, right name).
        how: `left` keeps left rows that find nothing, `inner` drops them.
        prefix: Put before the names of the right columns.
        strict: The right row must be strictly before (or after) the left one.
        forward: Take the earliest right row at or after instead.
        unique_left: The caller vouches that left is unique on (key, time).
        cuts: Cut points for hot keys over both inputs, named like the left keys.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', got {how!r}")
    pairs = [(c, c) if isinstance(c, str) else c for c in by]
    left_by = [a for a, _ in pairs]
    right_by = [b for _, b in pairs]
    found = [c for c in right.columns if c not in right_by]
    taken = set(left.columns) & {prefix + c for c in found}
    if taken:
        raise ValueError(f"both sides have {sorted(taken)}; pass a prefix")
    point = [*left_by, left_ts]
    aimable = all_of(F.col(c).isNotNull() for c in point)

    seen = right.where(all_of(F.col(c).isNotNull() for c in [*right_by, right_ts])).select(
        *[F.col(b).alias(a) for a, b in pairs],
        F.col(right_ts).alias(left_ts),
        F.struct(*found).alias("_right"),
    )
    if cuts is AUTO:
        both = left.where(aimable).select(*point).unionByName(seen.select(*point))
        cuts = find_cuts(both, left_by, left_ts)

    if unique_left:
        aims = left.where(aimable).select(*point, F.struct(*left.columns).alias("_left"))
    else:
        aims = left.where(aimable).select(*point).distinct().withColumn("_left", F.lit(True))
    # At equal times the right row has to come first to be found, or last not to be.
    right_side, left_side = (1, 0) if strict != forward else (0, 1)
    rows = aims.withColumn("_side", F.lit(left_side)).unionByName(
        seen.withColumn("_side", F.lit(right_side)), allowMissingColumns=True
    )
    s = sliced(rows, left_by, [left_ts, "_side"], ["_right"], cuts, reverse=forward)
    looked = s.done(
        s.rows.withColumn("_right", F.last("_right", ignorenulls=True).over(s.upto()))
    ).where(F.col("_left").isNotNull())
    if how == "inner":
        looked = looked.where(F.col("_right").isNotNull())
    answer = [F.col("_right")[c].alias(prefix + c) for c in found]

    if not unique_left:
        return left.join(looked.select(*point, "_right"), point, how).select(
            *[F.col(c) for c in left.columns], *answer
        )
    joined = looked.select(*[F.col("_left")[c].alias(c) for c in left.columns], *answer)
    if how == "inner":
        return joined
    # Rows without a key skip the window, where they would all be one partition.
    unaimed = left.where(any_of(F.col(c).isNull() for c in point))
    return joined.unionByName(unaimed, allowMissingColumns=True)
