"""Join two change histories that move on different timelines; derive periods from a history."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import all_of, any_of, distinct_from
from tidemark.operators import slices
from tidemark.operators.slices import AUTO, Cuts, find_cuts, running_sum, sliced
from tidemark.session import discard, stored, written


NEWS_PER_BLOCK = 64


def temporal_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    key: str | Sequence[str],
    on: Sequence[tuple[str, str]],
    rows_per_task: int | None = None,
) -> DataFrame:
    """Follow an item's own history and that of whatever it points to, as one history.

    Returns one row per item and time at which either side really changed: the key columns, `ts`,
    `lhs` (the left row in effect, as a struct) and `rhs` (the right row in effect for that left
    row, NULL if there is none). Times before an item's first left row are left out. "Changed"
    means that some column of either source, timestamps aside, is distinct from what was in effect
    just before, so a return to an earlier state is kept.

    How it is computed. A left row holds from its time to the item's next one. A row of the result
    starts either at a left row or at a right row:

    * a left row starts one if it differs from the item's previous left row, or if a changed right
      row bears the same time.
    * a right row starts one for each left row that points at it and holds then, if and only if it
      differs from the right row before it. That is a property of the right history alone, so
      repeats there go before they meet any item, and the changed ones (news) are numbered.

    One window over the links answers all look-ups: at the distinct points at which a left row begins
    or ends, which right row is in effect and how many news there were. So each left row meets just
    the news between its two numbers. No version row is joined with another history's version rows.

    Each step is written before the next one, so that a step's shuffle is all that the disks hold beside the tables at hand, and
    tables go when the last step that reads them has ended. The result reads what is written here, not left or right.

    Args:
        left: The items' history, unique on (key, left_ts).
        right: The history pointed to, unique on (right columns of `on`, right_ts).
        left_ts: Time column of left.
        right_ts: Time column of right, of the same type.
        key: Column(s) of left that identify the item.
        on: (left column, right column) pairs; a NULL on the left points to nothing.
        rows_per_task: Keys with more rows than this are cut into time slices.
    """
    keys = [key] if isinstance(key, str) else list(key)
    _check(left, right, left_ts, right_ts, keys, on)
    links = [f"_link{i}" for i in range(len(on))]

    # Left rows go through the shuffles as plain columns, each once: a struct beside its own columns would double them.
    names = _named(left, left_ts, on, links)
    lefts = left.select(
        *[F.col(c).alias(n) for c, n in names.items()],
        *[F.col(a).alias(link) for (a, _), link in zip(on, links) if names[a] != link],
    )
    items = [names[c] for c in keys]
    lefts = lefts.where(all_of(F.col(c).isNotNull() for c in [*items, "ts"]))
    rights = right.select(
        *[F.col(b).alias(link) for (_, b), link in zip(on, links)],
        F.col(right_ts).alias("ts"),
        F.struct(*right.columns).alias("rhs"),
    ).where(all_of(F.col(c).isNotNull() for c in [*links, "ts"]))
    linked = all_of(F.col(link).isNotNull() for link in links)

    # No key of either history can have more rows than both together.
    limit = rows_per_task or slices.ROWS_PER_TASK
    link_cuts = left_cuts = None
    if lefts.select("ts").unionAll(rights.select("ts")).count() > limit:
        points = lefts.where(linked).select(*links, "ts").unionByName(rights.select(*links, "ts"))
        link_cuts = find_cuts(points, links, "ts", limit)
        left_cuts = find_cuts(lefts, items, "ts", limit)

    spark = left.sparkSession
    held, held_path = stored(_held(lefts, items, [n for n in names.values() if n != "ts"], left_cuts), "held")
    differs = lambda now, was: ~(was.isNotNull() & _unchanged(now, was, right, right_ts))
    points, points_path = stored(_points(held.where(linked), links), "points")
    # Read for each kind of look-up from here on, and no larger than the two histories' points in time.
    answered, answered_path = stored(_numbered(rights, points, links, "rhs", differs, link_cuts), "answered")
    discard(spark, points_path)
    at_points = answered.where(F.col("_side") == 1)
    news = answered.where((F.col("_side") == 0) & F.col("_new"))
    news = written(news.select(*links, "ts", "_n", F.col("_in")["row"].alias("rhs")), "news")

    now = F.col("_in")["new"] & (F.col("_in")["since"] == F.col("ts"))
    starts = at_points.where(_BEGINS).select(*links, "ts", F.col("_in")["row"].alias("rhs"), now.alias("_now"), "_n")
    looked = held.join(_large(starts), [*links, "ts"], "left").select(
        *lefts.columns, "_end", (F.col("_own") | F.coalesce("_now", F.lit(False))).alias("_own"), "rhs", F.col("_n").alias("_after")
    )
    looked = written(looked, "looked")
    discard(spark, held_path)

    starting = looked.where(linked).drop("_own", "rhs").withColumnRenamed("ts", "_since")
    holding = _until_end(starting, at_points, news, links).where(F.col("_upto") > F.col("_after"))
    holding = written(holding.select(*starting.drop("_end").columns, "_upto"), "holding")
    discard(spark, answered_path)
    met = _meet(holding, news, links)

    def shown(frame: DataFrame, since: str) -> DataFrame:
        lhs = F.struct(*[F.col(since if c == left_ts else names[c]).alias(c) for c in left.columns])
        return frame.select(*[F.col(names[c]).alias(c) for c in keys], "ts", lhs.alias("lhs"), "rhs")

    return shown(looked.where("_own"), "ts").unionByName(shown(met, "_since"))


def temporal_join_theta(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    key: str | Sequence[str],
    on: Sequence[tuple[str, str]],
    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    uses: Sequence[str],
    rows_per_task: int | None = None,
) -> DataFrame:
    """`temporal_join` with a further condition beside the equalities.

    Which right rows an item sees then depends on some more of its columns than the link. It
    depends on nothing else, so the right rows are matched with the distinct values of those
    columns, whoever holds them, and the matches are a history to join on those values. At least
    one equality is required: it is what partitions the matching.

    The right rows of a link are numbered and cut into blocks. A value is compared with the blocks of
    the time in which some item holds it, however many items do, and before that with earlier blocks
    until one has a match: first with the one before, then with twice as many each round.

    Args:
        condition: Called with two functions that give a left and a right column by name, returns
            the condition; `lambda l, r: r("grade") >= l("minimum")`.
        uses: The left columns that `condition` reads.
    """
    keys = [key] if isinstance(key, str) else list(key)
    _check(left, right, left_ts, right_ts, keys, on)
    own = [c for c in dict.fromkeys(uses) if c not in {a for a, _ in on}]
    # NULL can satisfy the condition, so it becomes a value to join on: text, or '' for NULL.
    texts = {f"_use_{c}": _text(c) for c in own}
    reachable = left.withColumns(texts) if texts else left

    matched, path = _matched(left, right, left_ts, right_ts, keys, on, own, condition, rows_per_task)
    joined = temporal_join(
        reachable, matched, left_ts, right_ts, keys, [*on, *[(t, t) for t in texts]], rows_per_task
    )
    discard(left.sparkSession, path)
    if not texts:
        return joined
    return joined.withColumns(
        {side: F.col(side).dropFields(*texts) for side in ("lhs", "rhs")}
    )


def changes_only(
    frame: DataFrame,
    key: str | Sequence[str],
    ts: str,
    payload: Sequence[str],
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Drop rows that repeat their predecessor's payload.

    For a projection that folds two source values into one, which `temporal_join` cannot know of.
    """
    keys = [key] if isinstance(key, str) else list(key)
    s = sliced(frame.withColumn("_now", F.struct(*payload)), keys, [ts], ["_now"], cuts)
    was = F.lag("_now").over(s.window())
    return (
        s.done(s.rows.withColumn("_new", was.isNull() | distinct_from("_now", was)))
        .where("_new")
        .drop("_new", "_now")
    )


def periods(
    frame: DataFrame,
    key: str | Sequence[str],
    ts: str,
    as_of: Column | None = None,
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Add `valid_to` (start of the item's next row) and `days` (length of the period).

    The last period of an item is open: `valid_to` stays NULL, and its length runs to `as_of`
    or is NULL without one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    s = sliced(frame.withColumn("_start", F.col(ts)), keys, [ts], ["_start"], cuts, reverse=True)
    following = s.done(s.rows.withColumn("valid_to", F.lag("_start").over(s.window())))
    end = F.col("valid_to") if as_of is None else F.coalesce("valid_to", as_of)
    return following.withColumn("days", F.datediff(end, F.col(ts))).drop("_start")


def _named(left: DataFrame, left_ts: str, on: Sequence[tuple[str, str]], links: list[str]) -> dict[str, str]:
    """A name for each column of left: its time, its links and the others by their place."""
    names = {left_ts: "ts"}
    for (a, _), link in zip(on, links):
        names.setdefault(a, link)
    for i, c in enumerate(left.columns):
        names.setdefault(c, f"_l{i}")
    return names


def _text(c: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _held(lefts: DataFrame, keys: list[str], compared: list[str], cuts: Cuts | None) -> DataFrame:
    """Adds `_own`, whether the item's row before differs in `compared` or there is none, and `_end`, the time of its next row."""
    # Only a carry row needs the row before as one value.
    rows = lefts.withColumn("_row", F.struct("ts", *compared)) if cuts else lefts
    s = sliced(rows, keys, ["ts"], ["_row"], cuts)
    was = lambda c: F.lag("_row").over(s.window())[c] if s.split else F.lag(c).over(s.window())
    own = was("ts").isNull() | any_of(distinct_from(c, was(c)) for c in compared)
    rows = s.rows.withColumn("_own", own)
    if not s.split:
        return s.done(rows.withColumn("_end", F.lead("ts").over(s.window())))
    s = sliced(s.done(rows).drop("_row").withColumn("_start", F.col("ts")), keys, ["ts"], ["_start"], cuts, reverse=True)
    return s.done(s.rows.withColumn("_end", F.lag("_start").over(s.window()))).drop("_start")


# Bits of a point's `_kind`: some row begins to hold there, some row ends.
_BEGINS, _ENDS = "_kind & 1 > 0", "_kind & 2 > 0"


def _points(held: DataFrame, links: list[str]) -> DataFrame:
    """The different (link, time) at which a row begins or ends to hold."""
    kinds = F.array(*[F.struct(F.col(c).alias("ts"), F.lit(bit).alias("_kind")) for c, bit in (("ts", 1), ("_end", 2))])
    both = held.select(*links, F.inline(kinds))
    return both.where(F.col("ts").isNotNull()).groupBy(*links, "ts").agg(F.bit_or("_kind").alias("_kind"))


def _numbered(
    rights: DataFrame,
    points: DataFrame,
    links: list[str],
    row: str,
    is_new: Callable[[Column, Column], Column],
    cuts: Cuts | None,
) -> DataFrame:
    """Right rows (`_side` 0) and points (1) of each link, in order of time.

    `_in` is the right row in effect, with its time `since` and whether it is `new`; `_n` is how many new
    right rows there were up to then. `_new` marks the new rows themselves. `is_new` compares a row with
    the one before it.
    """
    order = ["ts", "_side"]
    rows = rights.select(*links, "ts", row, F.lit(0).alias("_side")).unionByName(
        points.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    s = sliced(rows, links, order, [row], cuts)
    was = F.last(row, ignorenulls=True).over(s.before())
    marked = s.done(s.rows.withColumn("_new", (F.col("_side") == 0) & is_new(F.col(row), was)))
    own = F.struct(F.col("ts").alias("since"), F.col(row).alias("row"), F.col("_new").alias("new"))
    marked = marked.withColumn("_in", F.when(F.col("_side") == 0, own)).drop(row)
    s = sliced(marked, links, order, ["_in"], cuts)
    answered = s.done(s.rows.withColumn("_in", F.last("_in", ignorenulls=True).over(s.upto())))
    return running_sum(answered, links, order, F.col("_new").cast("long"), "_n", cuts)


def _until_end(starting: DataFrame, at_points: DataFrame, news: DataFrame, links: list[str]) -> DataFrame:
    """Adds `_upto`, the number of news before `_end`; a row without an end holds to the link's last one."""
    at_end = F.col("_in")["new"] & (F.col("_in")["since"] == F.col("ts"))
    ends = at_points.where(_ENDS).select(
        *links, "ts", (F.col("_n") - F.coalesce(at_end.cast("long"), F.lit(0))).alias("_upto")
    ).unionByName(
        news.groupBy(*links).agg(F.max("_n").alias("_upto")), allowMissingColumns=True
    )
    ends = ends.select(*[F.col(c).alias(f"_e{c}") for c in links], F.col("ts").alias("_at"), "_upto")
    same = [F.col(c) == F.col(f"_e{c}") for c in links]
    return starting.join(_large(ends), all_of([*same, F.col("_end").eqNullSafe(F.col("_at"))]))


def _large(frame: DataFrame) -> DataFrame:
    """For the side of a join that grows with the histories: joined by a sort, never sent to all tasks.

    Spark takes a table's size from its Parquet files, which can hold links, times and numbers in a tenth of the memory that
    the rows take, and would send tables of millions of rows through the driver.
    """
    return frame.hint("merge")


def _each_block(frame: DataFrame, first: Column, last: Column) -> DataFrame:
    """A row for each `_block` from `first` to `last`.

    In one step: Spark 4.1 loses a struct's fields when columns are pruned through two.
    """
    return frame.withColumn("_block", F.explode(F.sequence(first, last)))


def _block_of(n: Column) -> Column:
    """The block of number `n`; numbers begin with 1, blocks with 0."""
    return F.floor((n - 1) / NEWS_PER_BLOCK)


def _meet(holding: DataFrame, news: DataFrame, links: list[str]) -> DataFrame:
    """Each row with the news numbered `_after` < `_n` <= `_upto` of its link.

    The row meets only the blocks of news in between: the work is linear in the rows and in what the
    result needs, however many of either share a link.
    """
    some = holding.where(F.col("_upto") > F.col("_after"))
    reaching = _each_block(some, _block_of(F.col("_after") + 1), _block_of(F.col("_upto")))
    dealt = news.withColumn("_block", _block_of(F.col("_n")))
    met = reaching.join(_large(dealt), [*links, "_block"])
    return met.where((F.col("_n") > F.col("_after")) & (F.col("_n") <= F.col("_upto")))


def _matched(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    keys: list[str],
    on: Sequence[tuple[str, str]],
    own: list[str],
    condition: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    rows_per_task: int | None,
) -> tuple[DataFrame, str]:
    """Right rows with the values (as `_use_` texts) that they satisfy the condition for; all that an item can see. And their path.

    Rows outside the time in which a value is held are left out, but for the last match before it.
    """
    limit = rows_per_task or slices.ROWS_PER_TASK
    links = [f"_link{i}" for i in range(len(on))]
    items = [f"_key{i}" for i in range(len(keys))]
    # What the condition reads of a left row: links, and columns of its own.
    names = {a: link for (a, _), link in reversed([*zip(on, links)])} | {c: f"_left_{c}" for c in own}
    read = [names[c] for c in own]
    value = [*links, *[f"_use_{c}" for c in own]]
    lefts = left.select(
        *[F.col(c).alias(n) for c, n in zip(keys, items)],
        F.col(left_ts).alias("ts"),
        *[F.col(a).alias(link) for (a, _), link in zip(on, links)],
        *[F.col(c).alias(names[c]) for c in own],
    ).where(all_of(F.col(c).isNotNull() for c in [*items, "ts"]))
    linked = all_of(F.col(c).isNotNull() for c in links)
    rights = right.select(
        *[F.col(b).alias(link) for (_, b), link in zip(on, links)],
        F.col(right_ts).alias("ts"),
        F.struct(*right.columns).alias("rhs"),
    ).where(all_of(F.col(c).isNotNull() for c in [*links, "ts"]))
    link_cuts = left_cuts = None
    if lefts.select("ts").unionAll(rights.select("ts")).count() > limit:
        points = lefts.where(linked).select(*links, "ts").unionByName(rights.select(*links, "ts"))
        link_cuts = find_cuts(points, links, "ts", limit)
        left_cuts = find_cuts(lefts, items, "ts", limit)

    # Numbers of all right rows, and at the points where a value is taken up or given up.
    spark = left.sparkSession
    held, held_path = stored(_held(lefts, items, [], left_cuts).where(linked).select(*links, *read, "ts", "_end"), "held")
    points, points_path = stored(_points(held, links), "points")
    # Read several times from here on.
    numbered, numbered_path = stored(_numbered(rights, points, links, "rhs", lambda now, was: F.lit(True), link_cuts), "numbered")
    discard(spark, points_path)
    at_points, seen = numbered.where("_side = 1"), numbered.where("_side = 0")
    blocks = seen.select(*links, _block_of(F.col("_n")).alias("_block"), "_n", F.col("_in")["row"].alias("rhs"))
    starts = at_points.where(_BEGINS).select(*links, "ts", F.col("_n").alias("_after"))
    starting, starting_path = stored(held.join(_large(starts), [*links, "ts"]).drop("ts"), "starting")
    discard(spark, held_path)
    rows = seen.select(*links, "ts", "_n")
    holding = _until_end(starting, at_points, rows, links).withColumns({f"_use_{c}": _text(names[c]) for c in own})
    # The blocks that a value is held in, whoever holds it: one more from where a hold begins, one less after it.
    first, last = _block_of(F.greatest(F.col("_after"), F.lit(1))), _block_of(F.greatest(F.col("_upto"), F.col("_after"), F.lit(1)))
    edges = F.array(F.struct(first.alias("_block"), F.lit(1).alias("_d")), F.struct((last + 1).alias("_block"), F.lit(-1).alias("_d")))
    one_of = [F.any_value(c).alias(c) for c in read]
    steps = (
        holding.select(*value, *read, F.explode(edges).alias("_edge"))
        .groupBy(*value, F.col("_edge")["_block"].alias("_block"))
        .agg(F.sum(F.col("_edge")["_d"]).alias("_d"), *one_of)
        .where("_d <> 0")
    )
    cuts = find_cuts(steps, value, "_block", limit) if link_cuts else None
    cover = running_sum(steps, value, ["_block"], F.col("_d"), "_open", cuts)
    s = sliced(cover.withColumn("_here", F.struct("_block", "_open")), value, ["_block"], ["_here"], cuts)
    before = F.lag("_here").over(s.window())
    # Each run of blocks ends where the next step is; the run before this step was covered if some hold was open.
    runs = s.done(s.rows.withColumn("_run", before)).where(F.col("_run").isNotNull())
    run_from, run_to = F.col("_run")["_block"], F.col("_block") - 1
    runs = written(
        runs.select(*value, *read, run_from.alias("_from"), run_to.alias("_to"), (F.col("_run")["_open"] > 0).alias("_covered"))
        .unionByName(
            cover.groupBy(*value).agg(*one_of, F.min("_block").alias("_to")).select(
                *value, *read, F.lit(0).cast("long").alias("_from"), (F.col("_to") - 1).alias("_to"), F.lit(False).alias("_covered")
            )
        )
        .where("_from <= _to"),
        "runs",
    )
    discard(spark, starting_path)
    holds = condition(lambda c: F.col(names[c]), lambda c: F.col("rhs")[c])
    meet = lambda some, low, high: _each_block(some, low, high).join(_large(blocks), [*links, "_block"]).where(holds)
    shown = [*[F.col("rhs")[c].alias(c) for c in right.columns], *value[len(links):]]
    matched = meet(runs.where("_covered"), F.col("_from"), F.col("_to")).select(*shown)
    # Before a run that is covered lies one that isn't, or another that is: its last match is what holds when the run begins.
    gaps = runs.where("NOT _covered").select(*value, *read, "_from", "_to", F.col("_to").alias("_upto"))
    width = 1
    while not gaps.isEmpty():
        low = F.greatest(F.col("_from"), F.col("_upto") - (width - 1))
        last_match = (
            meet(gaps, low, F.col("_upto"))
            .groupBy(*value, "_to")
            .agg(F.max_by("rhs", "_n").alias("rhs"))
        )
        last_match = written(last_match, "last")
        matched = matched.unionByName(last_match.select(*shown))
        gaps = written(
            gaps.where(low > F.col("_from")).withColumn("_upto", low - 1).join(_large(last_match), [*value, "_to"], "left_anti"), "gaps"
        )
        width *= 2
    matched = stored(matched, "matched")
    discard(spark, numbered_path)
    return matched


def _check(left, right, left_ts, right_ts, keys, on) -> None:
    if not on:
        raise ValueError("on must name at least one (left column, right column) pair")
    for frame, side, columns in (
        (left, "left", [left_ts, *keys, *[a for a, _ in on]]),
        (right, "right", [right_ts, *[b for _, b in on]]),
    ):
        missing = [c for c in columns if c not in frame.columns]
        if missing:
            raise ValueError(f"{side} has no column {missing}")
    if {"ts", "lhs", "rhs"} & set(keys):
        raise ValueError("a key must not be called ts, lhs or rhs")
    types = left.schema[left_ts].dataType, right.schema[right_ts].dataType
    if types[0] != types[1]:
        raise ValueError(f"the time columns differ in type: {types[0]} and {types[1]}")


def _unchanged(now: Column, was: Column, source: DataFrame, ts: str) -> Column:
    """Every column of the source row, its time aside, is as before."""
    return ~any_of(distinct_from(now[c], was[c]) for c in source.columns if c != ts)
