"""Validity periods of uploads: derive them, close replaced ones, look up what holds at a time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import covers, iso_timestamp
from tidemark.operators.slices import AUTO, Cuts, find_cuts, running_sum
from tidemark.session import written

BRANCH = 64
"""Uploads in a block, and blocks in a block of blocks, when a replacement is looked for."""

# The validity modes of an upload.
ALWAYS, UNTIL_REPLACED, PERIOD = "always", "until_replaced", "period"


def validity(
    frame: DataFrame,
    mode: str,
    arrived: str,
    v_from: str,
    v_until: str,
    default: str | None = None,
) -> DataFrame:
    """Replace the two texts by the period they mean, and add `reject_reason`.

    `always` has no bounds, `until_replaced` starts on arrival and is open, `period` starts at the
    given time or on arrival and ends at the given time or is open. An unknown mode, a text that is
    no ISO 8601 date-time, or an end that is not after the start rejects the upload.
    """
    chosen = F.coalesce(F.nullif(F.col(mode), F.lit("")), F.lit(default))
    blanks = r"\A\s+|\s+\z"
    texts = {v: F.coalesce(F.regexp_replace(v, blanks, ""), F.lit("")) for v in (v_from, v_until)}
    parsed = {v: F.when(t != "", iso_timestamp(t)) for v, t in texts.items()}
    start = F.coalesce(parsed[v_from], F.col(arrived))
    period = chosen == PERIOD
    reason = F.when(
        chosen.isNull() | ~chosen.isin(ALWAYS, UNTIL_REPLACED, PERIOD), "unknown validity"
    )
    for v in (v_from, v_until):
        reason = reason.when(
            period & (texts[v] != "") & parsed[v].isNull(), f"{v} is not a date-time"
        )
    reason = reason.when(period & (parsed[v_until] <= start), "the end is not after the start")
    return (
        frame.withColumn("reject_reason", reason)
        .withColumn("_from", F.when(chosen == UNTIL_REPLACED, F.col(arrived)).when(period, start))
        .withColumn("_until", F.when(period, parsed[v_until]))
        .withColumn(v_from, F.when(F.col("reject_reason").isNull(), F.col("_from")))
        .withColumn(v_until, F.when(F.col("reject_reason").isNull(), F.col("_until")))
        .drop("_from", "_until")
    )


def clip_replaced(
    uploads: DataFrame,
    zone: str,
    seq: str,
    v_from: str,
    v_until: str,
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Close every open upload at the start of the upload that replaces it.

    Uploads come in the order of `seq`. A new one with a start closes each upload of its zone that
    has an earlier start and no end; closed once, an upload stays so. Hence an open upload ends at
    the start of the first later upload that starts strictly after it, which need not be the next
    one. Uploads without a start neither close others nor get closed.

    The uploads of a zone are numbered and put in blocks of `BRANCH`; blocks of blocks keep the latest
    start of each part, up to one block per zone. An upload looks for its closer in its own block
    first. What is left goes up, level by level, until a later part has a start above its own, and
    down again to the first upload there. A level is a join with at most `BRANCH` maxima per row, so
    the work grows with the rows and the logarithm of the largest zone, whatever the order of starts.

    `cuts` are the cut points for hot zones. Uploads of one zone and `seq` come in any order.
    """
    takes_part = F.col(v_from).isNotNull() & F.col(zone).isNotNull()
    started = uploads.where(takes_part)
    if cuts is AUTO:
        cuts = find_cuts(started, [zone], seq)
    places = running_sum(started, [zone], [seq], F.lit(1).cast("long"), "_p", cuts)
    # Read several times from here on; the numbers stay as they are.
    numbered = written(places.withColumn("_p", F.col("_p") - 1), "numbered")
    later = _first_later_above(
        numbered.select(F.col(zone).alias("_zone"), "_p", F.col(v_from).alias("_s"), F.col(v_until).isNull().alias("_open"))
    ).withColumnsRenamed({"_zone": zone})
    closed = numbered.join(later, [zone, "_p"], "left").withColumn(v_until, F.coalesce(v_until, "_above"))
    return closed.select(*uploads.columns).unionByName(uploads.where(~takes_part))


def clip_incremental(
    stored: DataFrame, new: DataFrame, zone: str, seq: str, v_from: str, v_until: str
) -> tuple[DataFrame, DataFrame]:
    """A batch of new uploads against the stored ones: (stored rows to rewrite, new rows).

    Only the open uploads of the zones in the batch are read; the rest cannot change.
    """
    touched = new.where(F.col(v_from).isNotNull()).select(zone).distinct()
    still_open = stored.where(F.col(v_from).isNotNull() & F.col(v_until).isNull())
    affected = still_open.join(touched, zone, "left_semi")
    both = affected.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    clipped = clip_replaced(both, zone, seq, v_from, v_until)
    rewritten = clipped.where(~F.col("_new") & F.col(v_until).isNotNull()).drop("_new")
    return rewritten, clipped.where("_new").drop("_new")


def valid_at(uploads: DataFrame, v_from: str, v_until: str, ts: Column) -> DataFrame:
    """The uploads whose period covers `ts`: start included, end not, NULL bounds open."""
    return uploads.where(covers(v_from, v_until, ts))


def newest_valid_at(
    uploads: DataFrame,
    zone: str,
    uploaded_at: Sequence[str],
    v_from: str,
    v_until: str,
    ts: datetime | Sequence[datetime],
) -> DataFrame:
    """The newest valid upload of each zone at each of the given times, with the time as `at`.

    `uploaded_at` are the columns that order uploads by age. The times are parameters of a report,
    so there are few; each upload is weighed against each of them, and the map side keeps one
    upload per zone and time. To look up a time per row use `asof_join` on the clipped periods.
    """
    times = [ts] if isinstance(ts, datetime) else list(ts)
    asked = uploads.withColumn(
        "at", F.explode(F.array(*[F.lit(t).cast("timestamp") for t in times]))
    )
    row = F.struct(*uploads.columns)
    return (
        valid_at(asked, v_from, v_until, F.col("at"))
        .groupBy(zone, "at")
        .agg(F.max_by(row, F.struct(*uploaded_at)).alias("_row"))
        .select("at", *[F.col("_row")[c].alias(c) for c in uploads.columns])
    )


def stored_files(
    uploads: DataFrame, files: DataFrame, zones: DataFrame, name: str, ts: Column
) -> DataFrame:
    """Files of the sets valid at `ts` in the zone called `name`, newest set first.

    uploads(id, dropzone_id, uploaded_at, valid_from, valid_until), files(upload_id, file),
    zones(id, name).
    """
    zone = zones.where(F.col("name") == name).select(F.col("id").alias("dropzone_id"))
    valid = valid_at(uploads, "valid_from", "valid_until", ts)
    sets = valid.join(zone, "dropzone_id").select(F.col("id").alias("upload_id"), "uploaded_at")
    return files.join(sets, "upload_id").orderBy(F.desc("uploaded_at"), "upload_id", "file")


def _first_later_above(rows: DataFrame) -> DataFrame:
    """(_zone, _p, _above): for the open rows of (_zone, _p, _s, _open) the first `_s` above theirs at a later `_p`.

    `_p` numbers the rows of a zone from 0; rows without a later one above are left out.
    """
    parent = lambda node: F.floor(node / BRANCH)
    leaves = rows.groupBy("_zone", parent(F.col("_p")).alias("_node")).agg(
        F.sort_array(F.collect_list(F.struct("_p", "_s", "_open"))).alias("_parts"), F.max("_s").alias("_top")
    )
    # Rows in the largest zone; each level divides them by `BRANCH`.
    largest = 1 + (rows.agg(F.max("_p")).first()[0] or 0)
    levels = 0
    while largest > BRANCH:
        largest, levels = -(-largest // BRANCH), levels + 1
    if levels:
        leaves = written(leaves, "leaves")

    def first_above(parts: Column, s: Column) -> Column:
        return F.try_element_at(F.filter(parts, lambda x: x["_s"] > s), F.lit(1))

    def own_block(x: Column, i: Column) -> Column:
        rest = F.slice(F.col("_parts"), i + 2, F.lit(BRANCH))
        above = F.when(x["_open"], first_above(rest, x["_s"])["_s"])
        return F.struct(x["_p"].alias("_p"), x["_s"].alias("_s"), x["_open"].alias("_open"), above.alias("_above"))

    looked = leaves.select("_zone", "_node", F.explode(F.transform("_parts", own_block)).alias("x"))
    looked = looked.select("_zone", "_node", "x.*").where("_open")
    found = looked.where("_above IS NOT NULL").select("_zone", "_p", "_above")
    if not levels:
        return found

    tree, below = [], leaves.select("_zone", "_node", "_top")
    for _ in range(levels):
        below = written(
            below.groupBy("_zone", parent(F.col("_node")).alias("_node")).agg(
                F.sort_array(F.collect_list(F.struct(F.col("_node").alias("_p"), F.col("_top").alias("_s")))).alias("_parts"),
                F.max("_top").alias("_top"),
            ),
            "level",
        )
        tree.append(below.select("_zone", F.col("_node").alias("_up"), "_parts"))
        below = below.select("_zone", "_node", "_top")

    waiting = looked.where("_above IS NULL").select("_zone", "_p", "_s", "_node")
    higher = []
    for level in tree:
        met = waiting.withColumn("_up", parent(F.col("_node"))).join(level, ["_zone", "_up"])
        after = F.filter("_parts", lambda x: x["_p"] > F.col("_node"))
        met = written(met.withColumn("_down", first_above(after, F.col("_s"))["_p"]).drop("_parts"), "ascent")
        higher.append(met.where("_down IS NOT NULL").select("_zone", "_p", "_s", F.col("_down").alias("_up")))
        waiting = met.where("_down IS NULL").select("_zone", "_p", "_s", F.col("_up").alias("_node"))
    falling = higher.pop()
    for level in reversed(tree[:-1]):
        lower = falling.join(level, ["_zone", "_up"])
        lower = lower.select("_zone", "_p", "_s", first_above(F.col("_parts"), F.col("_s"))["_p"].alias("_up"))
        falling = lower.unionByName(higher.pop())
    parts = leaves.select("_zone", F.col("_node").alias("_up"), "_parts")
    last = falling.join(parts, ["_zone", "_up"])
    return found.unionByName(last.select("_zone", "_p", first_above(F.col("_parts"), F.col("_s"))["_s"].alias("_above")))
