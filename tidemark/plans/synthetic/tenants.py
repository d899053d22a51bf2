"""Harmonising tenants: market segments are tenants, their orders are the issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import any_of, distinct_from, slug, value_map
from tidemark.operators.audits import audit_known_tenant, audit_not_null, audit_unique
from tidemark.plans.harmonize import canonical, issue_metrics, union_tenants
from tidemark.plans.synthetic.registry import query
from tidemark.session import load
from tidemark.sources.files import tenant_view

EFFORT = {"1-URGENT": 8, "2-HIGH": 5, "3-MEDIUM": 3}


def segment(spark, sf, name) -> DataFrame:
    """One tenant's raw table: the orders of the customers in a segment."""
    customers = load(spark, sf, "customer").where(F.col("c_mktsegment") == name)
    return load(spark, sf, "orders").join(
        customers.select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")
    )


def building(spark, sf) -> DataFrame:
    return canonical(
        segment(spark, sf, "BUILDING"), "building", F.col("o_orderkey").cast("string"),
        F.col("c_name"), F.col("o_orderstatus") == "F", F.to_date("o_orderdate"),
        F.length("o_orderpriority"),
    )


def machinery(spark, sf) -> DataFrame:
    return canonical(
        segment(spark, sf, "MACHINERY"), "machinery", F.col("o_orderkey").cast("string"),
        F.col("c_name"), F.col("o_orderstatus").isin("F", "P"), F.to_date("o_orderdate"),
        value_map("o_orderpriority", EFFORT, 2),
    )


def household(spark, sf) -> DataFrame:
    # This tenant delivers text only.
    raw = segment(spark, sf, "HOUSEHOLD").select(
        F.col("o_orderkey").cast("string").alias("ticket"),
        F.col("c_name").alias("headline"),
        F.col("o_orderstatus").alias("phase"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("logged"),
        F.col("o_custkey").cast("string").alias("weight"),
    )
    return canonical(
        raw, "household", F.col("ticket"), F.col("headline"), F.col("phase") == "O",
        F.to_date("logged"), F.col("weight").cast("int"),
    )


def all_issues(spark, sf) -> DataFrame:
    return union_tenants([m(spark, sf) for m in (building, machinery, household)])


A_SQL = """
SELECT 'building' AS tenant_id, CAST(o_orderkey AS VARCHAR) AS issue_id, c_name AS title,
       CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
       CAST(o_orderdate AS DATE) AS created_on, CAST(length(o_orderpriority) AS INTEGER) AS effort
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"""
B_SQL = """
SELECT 'machinery' AS tenant_id, CAST(o_orderkey AS VARCHAR) AS issue_id, c_name AS title,
       CASE WHEN o_orderstatus IN ('F', 'P') THEN 'closed' ELSE 'open' END AS state,
       CAST(o_orderdate AS DATE) AS created_on,
       CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 5 WHEN '3-MEDIUM' THEN 3
            ELSE 2 END AS effort
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'"""
C_SQL = """
SELECT 'household' AS tenant_id, CAST(o_orderkey AS VARCHAR) AS issue_id, c_name AS title,
       CASE WHEN o_orderstatus = 'O' THEN 'closed' ELSE 'open' END AS state,
       CAST(o_orderdate AS DATE) AS created_on, CAST(o_custkey AS INTEGER) AS effort
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'HOUSEHOLD'"""
ALL_SQL = f"{A_SQL} UNION ALL {B_SQL} UNION ALL {C_SQL}"


query("q1_searched_case_tenant", A_SQL)(building)
query("q2_simple_case_tenant", B_SQL)(machinery)
query("q3_text_tenant", C_SQL)(household)
query("q4_u1_union_of_tenants", ALL_SQL)(all_issues)


@query(
    "q5_g1_issue_metrics",
    f"""SELECT tenant_id, count(*) AS total_issues,
        count(*) FILTER (WHERE state = 'open') AS open_issues,
        count(*) FILTER (WHERE state = 'closed') AS closed_issues,
        CAST(sum(effort) AS BIGINT) AS total_effort FROM ({ALL_SQL}) GROUP BY tenant_id""",
)
def metrics(spark, sf):
    return issue_metrics(all_issues(spark, sf))


@query(
    "s3_tenant_view",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE o_orderpriority = '1-URGENT'""",
)
def scoped(spark, sf):
    return tenant_view(
        load(spark, sf, "orders"),
        ["o_orderkey", "o_orderstatus", "o_totalprice"],
        F.col("o_orderpriority") == "1-URGENT",
        "urgent_orders",
    )


@query(
    "p1_p2_p7_project_rename_tag_cast",
    """SELECT 'parts' AS tenant_id, CAST(p_partkey AS VARCHAR) AS issue_id, p_name AS title,
       p_size AS effort FROM part""",
)
def renamed(spark, sf):
    return load(spark, sf, "part").select(
        F.lit("parts").alias("tenant_id"),
        F.col("p_partkey").cast("string").alias("issue_id"),
        F.col("p_name").alias("title"),
        F.col("p_size").alias("effort"),
    )


@query(
    "p3_p4_p5_p6_conditionals",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000
         THEN 'medium' ELSE 'small' END AS size,
       CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'in_progress' ELSE 'todo' END AS state,
       o_orderpriority IN ('1-URGENT', '2-HIGH') AS pressing FROM orders""",
)
def conditionals(spark, sf):
    price = F.col("o_totalprice")
    return load(spark, sf, "orders").select(
        "o_orderkey",
        F.when(price > 300000, "large").when(price > 100000, "medium").otherwise("small").alias("size"),
        value_map("o_orderstatus", {"F": "closed", "P": "in_progress"}, "todo").alias("state"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("pressing"),
    )


MAYBE_SQL = "SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS paid, CASE WHEN value > 10 THEN event_type END AS kind FROM events"


def maybe(spark, sf) -> DataFrame:
    """Events with two columns that are NULL in places."""
    return load(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"),
        F.when(F.col("value") > 10, F.col("event_type")).alias("kind"),
    )


@query(
    "p8_null_tests",
    f"SELECT event_id FROM ({MAYBE_SQL}) WHERE paid IS NULL AND NOT (kind IS NULL) OR paid > 50",
)
def null_tests(spark, sf):
    paid, kind = F.col("paid"), F.col("kind")
    return maybe(spark, sf).where(paid.isNull() & ~kind.isNull() | (paid > 50)).select("event_id")


@query(
    "p9_g11_distinct_from",
    f"""SELECT event_id, (kind IS DISTINCT FROM 'purchase') AS other,
        (paid IS DISTINCT FROM NULL) OR (kind IS DISTINCT FROM 'view') AS changed FROM ({MAYBE_SQL})""",
)
def null_safe(spark, sf):
    return maybe(spark, sf).select(
        "event_id",
        distinct_from("kind", F.lit("purchase")).alias("other"),
        any_of(
            [distinct_from("paid", F.lit(None)), distinct_from("kind", F.lit("view"))]
        ).alias("changed"),
    )


@query(
    "a2_known_tenant",
    f"""SELECT * FROM (SELECT kind AS tenant_id, CAST(event_id AS VARCHAR) AS issue_id
        FROM ({MAYBE_SQL})) WHERE tenant_id IS NULL OR issue_id IS NULL""",
)
def unattributed(spark, sf):
    return audit_known_tenant(
        maybe(spark, sf).select(
            F.col("kind").alias("tenant_id"), F.col("event_id").cast("string").alias("issue_id")
        )
    )


@query(
    "a3_unique_combination",
    """SELECT o_custkey, o_orderdate, count(*) AS rows FROM orders
       GROUP BY o_custkey, o_orderdate HAVING count(*) > 1""",
)
def repeated_days(spark, sf):
    return audit_unique(load(spark, sf, "orders"), ["o_custkey", "o_orderdate"])


@query("a4_not_null", f"SELECT * FROM ({MAYBE_SQL}) WHERE paid IS NULL OR kind IS NULL")
def missing_values(spark, sf):
    return audit_not_null(maybe(spark, sf), ["paid", "kind"])


@query("g8_u3_distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_values(spark, sf):
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query(
    "u2_union_distinct",
    """SELECT o_custkey AS key, o_orderdate AS at FROM orders
       UNION SELECT l_suppkey, l_shipdate FROM lineitem""",
)
def union_distinct(spark, sf):
    orders = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at")
    )
    lines = load(spark, sf, "lineitem").select("l_suppkey", "l_shipdate").toDF("key", "at")
    return orders.union(lines).distinct()


@query(
    "j5_equi_join_of_distinct_keys",
    """SELECT l_partkey, l_suppkey, s_name FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
       JOIN supplier ON l_suppkey = s_suppkey""",
)
def reachable(spark, sf):
    pairs = load(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return pairs.join(
        load(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")
    ).select("l_partkey", "l_suppkey", "s_name")


@query(
    "j7_left_join_statistics",
    """SELECT s_suppkey, s_name, coalesce(n, 0) AS lines, coalesce(qty, 0) AS quantity FROM supplier
       LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem
                  WHERE l_quantity > 49 AND l_returnflag = 'R' GROUP BY l_suppkey)
       ON s_suppkey = l_suppkey""",
)
def statistics(spark, sf):
    lines = (
        load(spark, sf, "lineitem")
        .where((F.col("l_quantity") > 49) & (F.col("l_returnflag") == "R"))
        .groupBy("l_suppkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    )
    return (
        load(spark, sf, "supplier")
        .join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select(
            "s_suppkey", "s_name", F.coalesce("n", F.lit(0)).alias("lines"),
            F.coalesce("qty", F.lit(0.0)).alias("quantity"),
        )
    )


@query(
    "f_slug_split_concat_left",
    r"""SELECT s_suppkey, CASE WHEN regexp_matches(b, '^[0-9]') THEN 't_' || b ELSE b END AS slug,
        split_part(s_name, '#', 2) AS number, 's.' || left(s_name, 4) AS short
        FROM (SELECT *, trim(regexp_replace(lower(trim(split_part(s_name, '#', 2) || ' ' || s_name)),
              '[^a-z0-9]+', '_', 'g'), '_') AS b FROM supplier)""",
)
def slugs(spark, sf):
    number = F.split_part("s_name", F.lit("#"), F.lit(2))
    return load(spark, sf, "supplier").select(
        "s_suppkey",
        slug(F.concat(number, F.lit(" "), F.col("s_name"))).alias("slug"),
        number.alias("number"),
        F.concat(F.lit("s."), F.left("s_name", F.lit(4))).alias("short"),
    )


@query(
    "f_numbers_and_times",
    """SELECT event_id, greatest(value - 20, 0) AS above, nullif(event_type, 'error') AS kind,
       coalesce(nullif(event_type, 'error'), 'none') AS kind_or_none,
       date_trunc('hour', ts) AS hour, round(value / 7, 3) AS seventh,
       CAST(epoch_us(ts) AS BIGINT) - CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS into_hour,
       ts + INTERVAL 14 DAY AS later, md5(event_type) AS hash, sha256(props) AS digest,
       TRY_CAST(props->>'k' AS INTEGER) AS k FROM events""",
)
def scalars(spark, sf):
    from tidemark.functions import json_text, sha256

    kind = F.nullif(F.col("event_type"), F.lit("error"))
    hour = F.date_trunc("hour", F.col("ts"))
    return load(spark, sf, "events").select(
        "event_id",
        F.greatest(F.col("value") - 20, F.lit(0.0)).alias("above"),
        kind.alias("kind"),
        F.coalesce(kind, F.lit("none")).alias("kind_or_none"),
        hour.alias("hour"),
        F.round(F.col("value") / 7, 3).alias("seventh"),
        (F.unix_micros("ts") - F.unix_micros(hour)).alias("into_hour"),
        (F.col("ts") + F.expr("INTERVAL 14 DAYS")).alias("later"),
        F.md5("event_type").alias("hash"),
        sha256("props").alias("digest"),
        json_text("props", "k").try_cast("int").alias("k"),
    )
