"""Change histories: parts and the supplier they come from; suppliers and their class per quarter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import value_map
from tidemark.operators.asof import asof_join
from tidemark.operators.audits import audit_every_row_is_a_change, audit_unique, publish
from tidemark.operators.slices import sliced
from tidemark.operators.temporal import (
    changes_only,
    periods,
    temporal_join,
    temporal_join_theta,
)
from tidemark.plans.risk import PAYLOAD, project_a_risk_history, project_b_risk_history, risk_audits, silver_risk_history
from tidemark.plans.synthetic.registry import query
from tidemark.session import discard, load, stored, work_path, written

LHS_SQL = """
SELECT l_partkey, l_shipdate AS shipped, CASE WHEN min(l_linenumber) <= 2 THEN 'A'
  WHEN min(l_linenumber) <= 5 THEN 'N' ELSE 'R' END AS flag, min(l_suppkey) AS link
FROM lineitem GROUP BY l_partkey, l_shipdate"""
RHS_SQL = """
SELECT l_suppkey, date_trunc('quarter', l_shipdate) AS since,
  CASE WHEN sum(l_quantity) < 500 THEN 'A' WHEN sum(l_quantity) < 600 THEN 'B' ELSE 'C' END AS class
FROM lineitem GROUP BY 1, 2"""
JOIN_SQL = f"""
WITH lhs AS ({LHS_SQL}), rhs AS (SELECT l_suppkey, CAST(since AS TIMESTAMP) AS since, class FROM ({RHS_SQL})),
tck AS (SELECT l_partkey, shipped AS ts FROM lhs UNION
  SELECT p.l_partkey, rhs.since FROM (SELECT DISTINCT l_partkey, link FROM lhs) p
  JOIN rhs ON rhs.l_suppkey = p.link),
l AS (SELECT tck.l_partkey, tck.ts, lhs.flag, lhs.link, lhs.shipped FROM tck
  ASOF LEFT JOIN lhs ON lhs.l_partkey = tck.l_partkey AND lhs.shipped <= tck.ts),
r AS (SELECT l.*, rhs.l_suppkey AS found, rhs.class FROM l
  ASOF LEFT JOIN rhs ON rhs.l_suppkey = l.link AND rhs.since <= l.ts WHERE l.shipped IS NOT NULL),
c AS (SELECT *, lag(shipped) OVER w IS NULL OR flag IS DISTINCT FROM lag(flag) OVER w
    OR link IS DISTINCT FROM lag(link) OVER w OR found IS DISTINCT FROM lag(found) OVER w
    OR class IS DISTINCT FROM lag(class) OVER w AS changed
  FROM r WINDOW w AS (PARTITION BY l_partkey ORDER BY ts))
SELECT l_partkey, ts, flag, link, class FROM c WHERE changed"""


# Histories are tables that several steps read, so they are written before they are joined.


def part_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per part and ship date: a flag and the supplier linked to."""
    line = F.min("l_linenumber")
    return (
        load(spark, sf, "lineitem")
        .groupBy("l_partkey", F.col("l_shipdate").alias("shipped"))
        .agg(
            F.when(line <= 2, "A").when(line <= 5, "N").otherwise("R").alias("flag"),
            F.min("l_suppkey").alias("link"),
        )
    )


def supplier_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per supplier and quarter: a class by the quantity shipped."""
    quantity = F.sum("l_quantity")
    band = F.when(quantity < 500, "A").when(quantity < 600, "B").otherwise("C")
    return (
        load(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.date_trunc("quarter", "l_shipdate").alias("since"))
        .agg(band.alias("class"))
    )


def part_history(spark: SparkSession, sf: str) -> DataFrame:
    return written(part_rows(spark, sf), "part_history")


def supplier_history(spark: SparkSession, sf: str) -> DataFrame:
    return written(supplier_rows(spark, sf), "supplier_history")


def from_histories(spark: SparkSession, sf: str, join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What `join` makes of the parts' and the suppliers' history, which go afterwards: a join reads what it has written itself."""
    parts, parts_path = stored(part_rows(spark, sf), "part_history")
    suppliers, suppliers_path = stored(supplier_rows(spark, sf), "supplier_history")
    made = join(parts, suppliers)
    discard(spark, parts_path, suppliers_path)
    return made


def joined(spark: SparkSession, sf: str) -> DataFrame:
    return from_histories(spark, sf, lambda parts, suppliers: temporal_join(
        parts, suppliers, "shipped", "since", "l_partkey", [("link", "l_suppkey")],
    )).select("l_partkey", "ts", "lhs.flag", "lhs.link", "rhs.class")


query("j1_temporal_join", JOIN_SQL)(joined)

# With a flag of N a part is concerned by class C only.
THETA_SQL = JOIN_SQL.replace(
    "(SELECT DISTINCT l_partkey, link FROM lhs) p\n  JOIN rhs ON rhs.l_suppkey = p.link",
    "(SELECT DISTINCT l_partkey, link, flag FROM lhs) p\n  JOIN rhs ON rhs.l_suppkey = p.link"
    " AND (p.flag <> 'N' OR rhs.class = 'C')",
).replace(
    "FROM l\n  ASOF LEFT JOIN rhs ON rhs.l_suppkey = l.link AND rhs.since <= l.ts WHERE",
    "FROM l\n  LEFT JOIN LATERAL (SELECT rhs.* FROM rhs WHERE rhs.l_suppkey = l.link"
    " AND (l.flag <> 'N' OR rhs.class = 'C') AND rhs.since <= l.ts ORDER BY rhs.since DESC LIMIT 1)"
    " rhs ON TRUE WHERE",
)


@query("j6_temporal_join_theta", THETA_SQL)
def theta(spark, sf):
    return from_histories(spark, sf, lambda parts, suppliers: temporal_join_theta(
        parts, suppliers, "shipped", "since", "l_partkey",
        [("link", "l_suppkey")],
        lambda l, r: (l("flag") != "N") | (r("class") == "C"),
        ["flag"],
    )).select("l_partkey", "ts", "lhs.flag", "lhs.link", "rhs.class")


BY_TYPE_SQL = "SELECT user_id, ts, event_id FROM events WHERE event_type = '{}'"


def events_of(spark, sf, kind, prefix) -> DataFrame:
    return load(spark, sf, "events").where(F.col("event_type") == kind).select(
        "user_id", F.col("ts").alias(f"{prefix}_ts"), F.col("event_id").alias(f"{prefix}_id")
    )


@query(
    "j2_asof_join",
    f"""SELECT p.user_id, p.event_id AS purchase_id, p.ts AS purchase_ts, c.event_id AS click_id,
        c.ts AS click_ts FROM ({BY_TYPE_SQL.format('purchase')}) p
        ASOF LEFT JOIN ({BY_TYPE_SQL.format('click')}) c ON c.user_id = p.user_id AND c.ts <= p.ts""",
)
def last_click(spark, sf):
    return asof_join(
        events_of(spark, sf, "purchase", "purchase"), events_of(spark, sf, "click", "click"),
        "purchase_ts", "click_ts", ["user_id"],
    )


@query(
    "j3_latest_row_inner_strict",
    f"""SELECT p.user_id, p.event_id AS purchase_id, p.ts AS purchase_ts, c.event_id AS click_id,
        c.ts AS click_ts FROM ({BY_TYPE_SQL.format('purchase')}) p
        ASOF JOIN ({BY_TYPE_SQL.format('click')}) c ON c.user_id = p.user_id AND c.ts < p.ts""",
)
def last_click_before(spark, sf):
    return asof_join(
        events_of(spark, sf, "purchase", "purchase"), events_of(spark, sf, "click", "click"),
        "purchase_ts", "click_ts", ["user_id"], how="inner", strict=True, unique_left=True,
    )


@query(
    "j4_chained_asof",
    f"""WITH lhs AS ({LHS_SQL}), rhs AS ({RHS_SQL})
        SELECT o_orderkey, p_partkey, lhs.link, rhs.class FROM
          (SELECT o_orderkey, o_orderdate, o_custkey AS p_partkey FROM orders) o
        ASOF LEFT JOIN lhs ON lhs.l_partkey = o.p_partkey AND lhs.shipped <= o.o_orderdate
        ASOF LEFT JOIN rhs ON rhs.l_suppkey = lhs.link AND rhs.since <= o.o_orderdate""",
)
def chained(spark, sf):
    orders = load(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_custkey").alias("p_partkey")
    )
    # The second lookup hangs off the row that the first one found.
    first = written(
        asof_join(
            orders, part_history(spark, sf), "o_orderdate", "shipped", [("p_partkey", "l_partkey")]
        ),
        "first_lookup",
    )
    second = asof_join(
        first, supplier_history(spark, sf), "o_orderdate", "since", [("link", "l_suppkey")]
    )
    return second.select("o_orderkey", "p_partkey", "link", "class")


@query(
    "a1_every_row_is_a_change",
    f"""SELECT l_partkey, shipped, previous FROM (
          SELECT l_partkey, shipped, lag(shipped) OVER w AS previous,
            flag IS DISTINCT FROM lag(flag) OVER w AS changed
          FROM ({LHS_SQL}) WINDOW w AS (PARTITION BY l_partkey ORDER BY shipped))
        WHERE NOT changed AND previous IS NOT NULL""",
)
def repeats(spark, sf):
    return audit_every_row_is_a_change(part_history(spark, sf), "l_partkey", "shipped", ["flag"])


@query(
    "a1_a3_audits_of_the_join",
    f"""SELECT l_partkey, ts, count(*) AS rows FROM ({JOIN_SQL}) GROUP BY l_partkey, ts
        HAVING count(*) > 1""",
)
def audited_join(spark, sf):
    history = written(joined(spark, sf), "joined")
    # One audit after the other, so that the disks hold the shuffle of one.
    twice = written(audit_unique(history, ["l_partkey", "ts"]), "twice")
    still = audit_every_row_is_a_change(history, "l_partkey", "ts", ["flag", "link", "class"])
    return twice.unionByName(still.select("l_partkey", "ts", F.lit(0).cast("long").alias("rows")))


@query(
    "b9_changes_only",
    f"""SELECT l_partkey, shipped, flag FROM (SELECT *, lag(shipped) OVER w AS previous,
          lag(flag) OVER w AS before FROM ({LHS_SQL}) WINDOW w AS (PARTITION BY l_partkey ORDER BY shipped))
        WHERE previous IS NULL OR flag IS DISTINCT FROM before""",
)
def changes(spark, sf):
    history = part_history(spark, sf).select("l_partkey", "shipped", "flag")
    return changes_only(history, "l_partkey", "shipped", ["flag"])


@query(
    "q17_time_in_state",
    f"""SELECT class, count(*) AS periods, CAST(sum(days) AS BIGINT) AS days FROM (
          SELECT class, date_diff('day', CAST(ts AS DATE), CAST(coalesce(lead(ts) OVER
            (PARTITION BY l_partkey ORDER BY ts), TIMESTAMP '2002-01-01') AS DATE)) AS days
          FROM ({JOIN_SQL})) GROUP BY class""",
)
def time_in_state(spark, sf):
    lasting = periods(
        written(joined(spark, sf), "joined"), "l_partkey", "ts", F.lit("2002-01-01").cast("timestamp")
    )
    return lasting.groupBy("class").agg(
        F.count(F.lit(1)).alias("periods"), F.sum("days").alias("days")
    )


@query(
    "w1_lag",
    """SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events""",
)
def previous_value(spark, sf):
    events = load(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.struct("value").alias("now")
    )
    s = sliced(events, ["user_id"], ["ts"], ["now"])
    before = F.lag("now").over(s.window())["value"]
    return s.done(s.rows.withColumn("before", before)).select("event_id", "before")


@query(
    "w2_lag_by_item",
    f"""SELECT l_partkey, shipped, lag(flag) OVER w AS flag_before, lag(link) OVER w AS link_before
        FROM ({LHS_SQL}) WINDOW w AS (PARTITION BY l_partkey ORDER BY shipped)""",
)
def previous_row(spark, sf):
    rows = part_history(spark, sf).withColumn("now", F.struct("flag", "link"))
    s = sliced(rows, ["l_partkey"], ["shipped"], ["now"])
    before = s.done(s.rows.withColumn("before", F.lag("now").over(s.window())))
    return before.select(
        "l_partkey", "shipped", F.col("before.flag").alias("flag_before"),
        F.col("before.link").alias("link_before"),
    )


# Parts as issues and suppliers as components: every further column depends on one that is there.
STATES = {"A": "Done", "N": "In Progress", "R": "To Do"}
RISK_COLUMNS = """CAST(l_partkey AS VARCHAR) AS issue_id, CAST(ts AS DATE) AS valid_from, {state} AS state, {effort} AS effort,
    CAST(link AS VARCHAR) AS component_id, class AS safety_class,
    CASE WHEN class IS NOT NULL THEN 'team ' || (link % 3) END AS owner"""
A_RISK_SQL = "SELECT 'project_a' AS tenant_id, " + RISK_COLUMNS.format(
    state="CASE flag WHEN 'A' THEN 'closed' WHEN 'N' THEN 'in_progress' ELSE 'todo' END", effort="CAST(l_partkey % 9 AS INTEGER)"
) + f" FROM ({JOIN_SQL})"
B_RISK_SQL = "SELECT 'project_b' AS tenant_id, " + RISK_COLUMNS.format(
    state="CASE WHEN flag = 'N' THEN 'todo' ELSE 'closed' END", effort="CASE l_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 5 ELSE 2 END"
) + f" FROM ({JOIN_SQL})"


def components(suppliers: DataFrame, key: str, ts: str, level: str, team: str) -> DataFrame:
    owner = F.concat(F.lit("team "), (F.col("l_suppkey") % 3).cast("string"))
    return suppliers.select(
        F.col("l_suppkey").cast("string").alias(key), F.to_date("since").alias(ts), F.col("class").alias(level), owner.alias(team)
    )


def project_a(spark: SparkSession, sf: str) -> DataFrame:
    issues = lambda parts: parts.select(
        F.col("l_partkey").cast("string").alias("issue_key"), F.to_date("shipped").alias("changed_at"),
        value_map("flag", STATES).alias("status"), (F.col("l_partkey") % 9).cast("int").alias("story_points"),
        F.col("link").cast("string").alias("component_key"),
    )
    return from_histories(spark, sf, lambda parts, suppliers: project_a_risk_history(
        issues(parts), components(suppliers, "component_key", "changed_at", "safety_class", "owner_team")
    ))


def project_b(spark: SparkSession, sf: str) -> DataFrame:
    third = F.col("l_partkey") % 3
    issues = lambda parts: parts.select(
        F.col("l_partkey").cast("int").alias("id"), F.to_date("shipped").alias("updated"),
        value_map("flag", {"A": "closed", "N": "open", "R": "merged"}).alias("state"),
        F.when(third == 0, "high").when(third == 1, "medium").otherwise("low").alias("priority"),
        F.col("link").cast("string").alias("area"),
    )
    return from_histories(spark, sf, lambda parts, suppliers: project_b_risk_history(
        issues(parts), components(suppliers, "area", "updated", "classification", "team")
    ))


@query("q6_a5_risk_history_published", A_RISK_SQL)
def risk_a(spark, sf):
    return publish(project_a(spark, sf), risk_audits(), work_path(spark, "risk"))


query("q7_risk_history", B_RISK_SQL)(project_b)


@query("q8_f2_silver_risk_history", f"{A_RISK_SQL} UNION ALL {B_RISK_SQL}")
def risk(spark, sf):
    # Each model has to have the declared columns and types.
    return silver_risk_history(project_a(spark, sf), project_b(spark, sf))


@query(
    "q8_repeats_after_folding",
    f"""SELECT issue_id, valid_from FROM (SELECT *, row(state, effort, component_id, safety_class, owner) AS now,
          lag(row(state, effort, component_id, safety_class, owner)) OVER (PARTITION BY issue_id ORDER BY valid_from) AS was
        FROM ({B_RISK_SQL})) WHERE was IS NOT NULL AND now IS NOT DISTINCT FROM was""",
)
def folded_repeats(spark, sf):
    # Two states that count as closed make rows that the audit finds. It looks for hot keys first, and so reads the history several times.
    history = written(project_b(spark, sf), "folded")
    found = audit_every_row_is_a_change(history, "issue_id", "valid_from", PAYLOAD)
    return found.select("issue_id", "valid_from")
