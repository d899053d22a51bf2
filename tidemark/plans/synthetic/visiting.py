"""Visits: events rendered as log lines, page addresses as requests and readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import first_match
from tidemark.operators.visits import (
    PathRules,
    distinct_sessions,
    page_views,
    parse_visits,
    sessions_dwell,
    valid_json,
    visits_by,
)
from tidemark.plans.synthetic.registry import query
from tidemark.session import load, written
from tidemark.sources.files import parse_readings


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as visit log lines. Errors carry a stray brace, signups have no proper status or time, purchases give
    their app twice."""
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    no_time = (kind == "signup") & (F.col("value") > 20)
    path = (
        F.when(kind == "view", F.concat(F.lit("/dashboards/d/u"), user, F.lit("/name")))
        .when(kind == "click", F.concat(F.lit("/dashboards/d-solo/u"), user, F.lit("/name")))
        .otherwise("/admin/orders")
    )
    admin = kind == "purchase"
    record = F.struct(
        F.when(no_time, "2026").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).alias("ts"),
        F.when(admin, "admin").otherwise("dashboards").alias("app"),
        path.alias("path"),
        F.when((kind == "signup") & ~no_time, "none").otherwise("200").alias("status"),
        F.concat(F.lit("10.0.0."), user).alias("ip"),
        F.when(kind == "view", F.concat(F.lit("1.2.3."), user, F.lit(", 5.6.7.8"))).otherwise("").alias("xff"),
        F.col("props").alias("ua"),
        F.when(admin, "").otherwise(user).alias("dashboard_session"),
        F.when(F.col("value") > 20, user).otherwise("").alias("admin_session"),
    )
    whole = F.to_json(record)
    twice = F.concat(F.lit('{"app":"first",'), F.substring("whole", 2, 1_000_000))
    line = F.when(kind == "error", F.concat("whole", F.lit("}"))).when(admin, twice).otherwise(F.col("whole"))
    rendered = load(spark, sf, "events").withColumn("whole", whole).select(line.alias("value"))
    # Lines come from files; parsing must not render them again for each use.
    return written(rendered, "lines")


@query(
    "v1_v2_v3_v4_parse_visits",
    """SELECT ts AS visited_at, CASE WHEN event_type = 'purchase' THEN 'admin' ELSE 'dashboards' END AS app,
       CASE event_type WHEN 'view' THEN '/dashboards/d/u' || user_id || '/name' WHEN 'click' THEN
         '/dashboards/d-solo/u' || user_id || '/name' ELSE '/admin/orders' END AS url_path,
       CASE WHEN event_type <> 'purchase' THEN 'u' || user_id END AS dashboard_uid,
       CASE WHEN event_type = 'view' THEN '1.2.3.' ELSE '10.0.0.' END || user_id AS client_ip,
       md5(CASE WHEN event_type <> 'purchase' OR value > 20 THEN CAST(user_id AS VARCHAR) ELSE '' END)
         AS session_hash, 200 AS status, props AS user_agent
       FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
)
def visits(spark, sf):
    return parse_visits(log_lines(spark, sf))[0]


@query(
    "v1_quarantine",
    """SELECT CASE WHEN event_type = 'error' THEN 'not JSON' WHEN value > 20 THEN 'bad ts' ELSE 'bad status' END AS reason,
       count(*) AS lines FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1""",
)
def quarantine(spark, sf):
    bad = parse_visits(log_lines(spark, sf))[1]
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "p13_parseable_lines",
    """SELECT event_id FROM events WHERE event_type NOT IN ('error', 'signup')""",
)
def parseable(spark, sf):
    line = (
        F.when(F.col("event_type") == "error", F.concat("props", F.lit("}")))
        .when(F.col("event_type") == "signup", "")
        # A key twice, within another value as well.
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"k":1,"k":[{"v":1,"v":"'), "event_id", F.lit('"}]}')))
        .otherwise(F.col("props"))
    )
    events = load(spark, sf, "events").withColumn("line", line)
    return valid_json(events, "line").select("event_id")


LANGUAGES = PathRules(
    ((r"^/en/[0-9]+\.html", ""), (r"^/en/", "english"), (r"^/(fr|de)/", "continental"))
)


@query(
    "p14_p15_v5_page_views",
    r"""SELECT page_id, path, CASE WHEN regexp_matches(path, '^/en/') THEN 'english' ELSE 'continental' END AS app
        FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
        WHERE url LIKE 'https:%' AND regexp_matches(path, '^/(en|fr|de)/')
          AND NOT regexp_matches(path, '^/en/[0-9]+\.html')""",
)
def views(spark, sf):
    requests = load(spark, sf, "pages").select(
        "page_id",
        F.when(F.col("url").startswith("https:"), "GET").otherwise("POST").alias("method"),
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"),
    )
    return page_views(requests, "method", "path", LANGUAGES).select("page_id", "path", "app")


@query(
    "s7_parse_readings",
    r"""SELECT page_id, CASE WHEN q = '' THEN 'no parameters' END AS reject_reason,
        nullif(array_to_string(list_sort([split_part(p, '=', 1) FOR p IN string_split(q, '&') IF p <> '']), ','), '') AS names,
        nullif(array_to_string([split_part(p, '=', 2) FOR p IN list_sort(string_split(q, '&')) IF p <> ''], ','), '') AS vals
        FROM (SELECT page_id, split_part(split_part(url, '#', 1), '?', 2) AS q FROM pages)""",
)
def readings(spark, sf):
    pages = load(spark, sf, "pages").select(
        "page_id",
        F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2)).alias("q"),
    )
    parsed = parse_readings(pages, "q")
    values = F.transform("names", lambda n: F.col("readings")[n])
    return parsed.select(
        "page_id", "reject_reason", F.concat_ws(",", "names").alias("names"),
        F.concat_ws(",", values).alias("vals"),
    ).select(
        "page_id", "reject_reason", F.nullif("names", F.lit("")).alias("names"),
        F.nullif("vals", F.lit("")).alias("vals"),
    )


@query(
    "f_first_regex_match",
    """SELECT page_id, nullif(regexp_extract(url, 'utm_source=([a-z]+)', 1), '') AS utm FROM pages""",
)
def campaign(spark, sf):
    return load(spark, sf, "pages").select(
        "page_id", first_match("url", "utm_source=([a-z]+)").alias("utm")
    )


@query(
    "v7_visits_by_hour_and_weekday",
    """SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday,
       count(*) AS visits FROM events GROUP BY 1, 2, 3""",
)
def by_time(spark, sf):
    return visits_by(
        load(spark, sf, "events"), F.col("event_type"), F.hour("ts").alias("hour"),
        F.dayofweek("ts").alias("weekday"),
    )


@query(
    "v8_distinct_sessions",
    "SELECT event_type, count(DISTINCT user_id) AS sessions FROM events GROUP BY event_type",
)
def sessions(spark, sf):
    events = load(spark, sf, "events").withColumn("session", F.md5(F.col("user_id").cast("string")))
    return distinct_sessions(events, ["event_type"], "session")


# Within three times the standard error that the approximation is given for.
@query(
    "v8_distinct_sessions_approximate",
    "SELECT event_type, count(DISTINCT user_id) AS sessions, true AS near FROM events GROUP BY event_type",
)
def sessions_roughly(spark, sf):
    events = load(spark, sf, "events").withColumn("session", F.md5(F.col("user_id").cast("string")))
    roughly = distinct_sessions(events, ["event_type"], "session", approximate=True).withColumnRenamed("sessions", "roughly")
    both = distinct_sessions(events, ["event_type"], "session").join(roughly, "event_type")
    near = F.abs(F.col("roughly") - F.col("sessions")) <= 3 * 0.05 * F.col("sessions")
    return both.select("event_type", "sessions", near.alias("near"))


@query(
    "v9_session_dwell",
    """SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6
       AS dwell FROM events""",
)
def dwell(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "ts")
    return sessions_dwell(events, "user_id", "ts").select("event_id", "dwell")
