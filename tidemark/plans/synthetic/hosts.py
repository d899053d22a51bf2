"""Counters and gauges: each user is a host, its events are the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import in_window
from tidemark.operators.series import (
    collapse,
    counter_delta,
    counter_rate,
    forward_fill,
    growth_per_day,
    hourly_rollup,
    latest_non_null,
    rollup_and_prune,
    sum_devices,
    top_k,
    total_by,
    window_total,
)
from tidemark.operators.slices import sliced
from tidemark.plans import host
from tidemark.plans.synthetic.registry import query
from tidemark.session import load

SERIES = ["host"]
FROM, TO, REACH = "2024-01-10 00:00:00", "2024-01-20 00:00:00", "INTERVAL 2 DAYS"

# A counter grows with the event number and falls back at each signup. A gauge is known on events
# of one type and NULL on the others.
SAMPLES_SQL = """
SELECT user_id AS host, ts AS sampled_at, event_id,
  CASE WHEN event_type = 'signup' THEN c ELSE event_id * 1000000 + c END AS cpu_usage_usec,
  CASE WHEN event_type = 'view' THEN CAST(round(value) AS INTEGER) END AS host_nproc,
  c * 1024 AS mem_current_bytes,
  CASE WHEN event_type = 'view' THEN c * 4096 END AS host_mem_total_bytes,
  CASE WHEN event_type = 'signup' THEN 0 ELSE event_id * 512 END AS io_read_bytes,
  CASE WHEN event_type = 'signup' THEN 0 ELSE event_id * 256 + c END AS io_write_bytes,
  CASE WHEN event_type = 'signup' THEN 0 ELSE event_id END AS io_read_ios,
  CASE WHEN event_type <> 'error' THEN event_id * 2 END AS io_write_ios,
  CASE WHEN event_type = 'signup' THEN c ELSE event_id * 100 + c END AS net_tx_bytes,
  CASE WHEN event_type = 'signup' THEN 0 ELSE event_id * 300 + c END AS net_rx_bytes,
  CASE WHEN event_type = 'purchase' THEN c END AS db_size_bytes,
  CASE WHEN event_type = 'view' THEN c + 7 END AS temp_size_bytes,
  CASE WHEN event_type = 'click' THEN c * 3 END AS volume_size_bytes
FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    c, n, kind = F.round(F.col("value") * 100).cast("long"), F.col("event_id"), F.col("event_type")
    signup = kind == "signup"
    return load(spark, sf, "events").select(
        F.col("user_id").alias("host"),
        F.col("ts").alias("sampled_at"),
        "event_id",
        F.when(signup, c).otherwise(n * 1000000 + c).alias("cpu_usage_usec"),
        F.when(kind == "view", F.round("value").cast("int")).alias("host_nproc"),
        (c * 1024).alias("mem_current_bytes"),
        F.when(kind == "view", c * 4096).alias("host_mem_total_bytes"),
        F.when(signup, 0).otherwise(n * 512).alias("io_read_bytes"),
        F.when(signup, 0).otherwise(n * 256 + c).alias("io_write_bytes"),
        F.when(signup, 0).otherwise(n).alias("io_read_ios"),
        F.when(kind != "error", n * 2).alias("io_write_ios"),
        F.when(signup, c).otherwise(n * 100 + c).alias("net_tx_bytes"),
        F.when(signup, 0).otherwise(n * 300 + c).alias("net_rx_bytes"),
        F.when(kind == "purchase", c).alias("db_size_bytes"),
        F.when(kind == "view", c + 7).alias("temp_size_bytes"),
        F.when(kind == "click", c * 3).alias("volume_size_bytes"),
    )


def at(text: str):
    return F.lit(text).cast("timestamp")


def window():
    return at(FROM), at(TO)


def reach():
    return F.expr(REACH)


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


W = "WINDOW w AS (PARTITION BY host ORDER BY sampled_at)"
IN = f"BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'"
NEAR_SQL = f"""SELECT * FROM ({SAMPLES_SQL}) WHERE sampled_at
  BETWEEN TIMESTAMP '{FROM}' - INTERVAL 2 DAY AND TIMESTAMP '{TO}'"""
SECONDS = "((epoch_us(sampled_at) - epoch_us(lag(sampled_at) OVER w)) / 1e6)"


def delta_sql(c: str) -> str:
    return f"greatest({c} - lag({c}) OVER w, 0)"


def rate_sql(c: str, scale: str = "") -> str:
    return f"round({delta_sql(c)} / nullif({SECONDS}{scale}, 0), 6)"


@query(
    "c1_counter_delta",
    f"""SELECT event_id, {delta_sql('io_read_bytes')} AS d_io_read_bytes,
        {delta_sql('io_write_ios')} AS d_io_write_ios, {delta_sql('net_tx_bytes')} AS d_net_tx_bytes
        FROM ({SAMPLES_SQL}) {W}""",
)
def deltas(spark, sf):
    columns = ["io_read_bytes", "io_write_ios", "net_tx_bytes"]
    rows = counter_delta(samples(spark, sf), SERIES, "sampled_at", columns)
    return rows.select("event_id", *[f"d_{c}" for c in columns])


@query(
    "c2_counter_rate",
    f"""SELECT event_id, {rate_sql('io_read_bytes')} AS rate_io_read_bytes,
        {rate_sql('net_rx_bytes')} AS rate_net_rx_bytes FROM ({SAMPLES_SQL}) {W}""",
)
def rates(spark, sf):
    columns = ["io_read_bytes", "net_rx_bytes"]
    rows = counter_rate(samples(spark, sf), SERIES, "sampled_at", columns)
    return rounded(rows.select("event_id", *[f"rate_{c}" for c in columns]), *[f"rate_{c}" for c in columns])


@query(
    "c3_busy_cores",
    f"""SELECT event_id, {rate_sql('cpu_usage_usec', ' * 1e6')} AS busy FROM ({SAMPLES_SQL}) {W}""",
)
def busy(spark, sf):
    rows = counter_rate(samples(spark, sf), SERIES, "sampled_at", ["cpu_usage_usec"], 1e6)
    return rounded(rows.select("event_id", F.col("rate_cpu_usage_usec").alias("busy")), "busy")


FLOWS = list(host.HOST_ROLLUP.counters)
ROLLUP_SQL = f"""
SELECT host, date_trunc('hour', sampled_at) AS bucket, count(*) AS samples,
  avg(cpu) AS cpu_cores_avg, max(cpu) AS cpu_cores_max,
  avg(mem_current_bytes) AS mem_bytes_avg, max(mem_current_bytes) AS mem_bytes_max,
  max(db_size_bytes) AS db_size_bytes_max, max(temp_size_bytes) AS temp_size_bytes_max,
  max(volume_size_bytes) AS volume_size_bytes_max,
  {", ".join(f"CAST(sum(d_{c}) AS BIGINT) AS {c}_sum" for c in FLOWS)},
  bool_and(before IS NOT NULL) AS anchored
FROM (SELECT *, lag(sampled_at) OVER w AS before,
  {delta_sql('cpu_usage_usec')} / nullif({SECONDS} * 1e6, 0) AS cpu,
  {", ".join(f"{delta_sql(c)} AS d_{c}" for c in FLOWS)} FROM ({SAMPLES_SQL}) {W})
GROUP BY 1, 2"""
ROUNDED = ["cpu_cores_avg", "cpu_cores_max", "mem_bytes_avg"]
REPLACE = ", ".join(f"round({c}, 6) AS {c}" for c in ROUNDED)


def hourly(spark, sf) -> DataFrame:
    return hourly_rollup(samples(spark, sf), SERIES, "sampled_at", host.HOST_ROLLUP)


@query("c4_g3_hourly_rollup", f"SELECT * REPLACE ({REPLACE}) FROM ({ROLLUP_SQL})")
def rollup(spark, sf):
    return rounded(hourly(spark, sf), *ROUNDED)


@query(
    "c5_rollup_and_prune",
    f"""SELECT * REPLACE ({REPLACE}) FROM (
        SELECT * EXCLUDE (whole)
          REPLACE (CASE WHEN whole AND anchored THEN samples ELSE -1 END AS samples)
        FROM (SELECT *, bucket >= TIMESTAMP '2024-01-31 00:30:00' - INTERVAL 14 DAY AS whole
              FROM ({ROLLUP_SQL}))
        WHERE bucket >= TIMESTAMP '2024-01-31 00:30:00' - INTERVAL 20 DAY)""",
)
def rolled_and_pruned(spark, sf):
    # The stored table knows every hour but carries a mark in place of the sample count, so that
    # an hour that was wrongly rolled up again would show.
    raw = samples(spark, sf)
    stored = hourly(spark, sf).withColumn("samples", F.lit(-1).cast("long"))
    _, kept = rollup_and_prune(
        raw, stored, SERIES, "sampled_at", host.HOST_ROLLUP, at("2024-01-31 00:30:00"),
        F.expr("INTERVAL 14 DAYS"), F.expr("INTERVAL 20 DAYS"),
    )
    return rounded(kept, *ROUNDED)


@query(
    "k8_retention_prune",
    f"""SELECT event_id FROM ({SAMPLES_SQL})
        WHERE sampled_at >= TIMESTAMP '2024-01-31 00:30:00' - INTERVAL 14 DAY""",
)
def pruned(spark, sf):
    from tidemark.operators.sync import prune

    kept = prune(
        samples(spark, sf), "sampled_at", at("2024-01-31 00:30:00"), F.expr("INTERVAL 14 DAYS")
    )
    return kept.select("event_id")


@query(
    "c6_sum_devices",
    """SELECT l_shipdate AS sampled_at, sum(l_quantity) AS read_bytes, CAST(sum(l_linenumber) AS BIGINT)
       AS ios FROM lineitem GROUP BY l_shipdate""",
)
def devices(spark, sf):
    lines = load(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("sampled_at"), F.col("l_quantity").alias("read_bytes"),
        F.col("l_linenumber").alias("ios"),
    )
    return sum_devices(lines, ["sampled_at"], ["read_bytes", "ios"])


@query(
    "c7_monthly_total",
    f"""SELECT host, date_trunc('month', bucket) AS month, CAST(sum(net_tx_bytes_sum) AS BIGINT)
        AS net_tx_bytes_sum FROM ({ROLLUP_SQL}) GROUP BY 1, 2""",
)
def monthly(spark, sf):
    return total_by(hourly(spark, sf), SERIES, "bucket", "month", ["net_tx_bytes_sum"])


@query(
    "w3_w4_w5_forward_fill",
    f"""SELECT event_id, last_value(db_size_bytes IGNORE NULLS) OVER w AS db_size_bytes,
        last_value(temp_size_bytes IGNORE NULLS) OVER w AS temp_size_bytes
        FROM ({SAMPLES_SQL}) {W}""",
)
def filled(spark, sf):
    columns = ["db_size_bytes", "temp_size_bytes"]
    rows = samples(spark, sf).select("event_id", "host", "sampled_at", *columns)
    return forward_fill(rows, SERIES, "sampled_at", columns).select("event_id", *columns)


@query(
    "w3_running_count",
    f"SELECT event_id, count(db_size_bytes) OVER w AS run FROM ({SAMPLES_SQL}) {W}",
)
def run_ids(spark, sf):
    # The number of known values so far is the rank of the last known one.
    from tidemark.operators.slices import running_count

    rows = samples(spark, sf).select("event_id", "host", "sampled_at", "db_size_bytes")
    known = running_count(rows.where("db_size_bytes IS NOT NULL"), SERIES, ["sampled_at"], "run")
    ranked = known.unionByName(rows.where("db_size_bytes IS NULL"), allowMissingColumns=True)
    s = sliced(ranked, SERIES, ["sampled_at"], ["run"])
    run = F.coalesce(F.last("run", ignorenulls=True).over(s.upto()), F.lit(0)).cast("long")
    return s.done(s.rows.withColumn("run", run)).select("event_id", "run")


@query(
    "g2_collapse_duplicates",
    """SELECT l_suppkey, min(left(l_returnflag || l_linestatus, 2000)) AS text, sum(l_quantity) AS l_quantity,
       CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem WHERE l_suppkey IS NOT NULL
       GROUP BY l_suppkey""",
)
def collapsed(spark, sf):
    lines = load(spark, sf, "lineitem").withColumn("text", F.concat("l_returnflag", "l_linestatus"))
    return collapse(lines, "l_suppkey", "text", ["l_quantity", "l_linenumber"])


@query(
    "g4_g6_growth_per_day",
    f"""SELECT host, max(io_read_bytes) - min(io_read_bytes) AS io_read_bytes_growth,
        max(net_tx_bytes) - min(net_tx_bytes) AS net_tx_bytes_growth,
        round((max(net_tx_bytes) - min(net_tx_bytes)) / greatest((epoch_us(max(sampled_at))
          - epoch_us(min(sampled_at))) / 86400e6, 1), 6) AS net_tx_bytes_per_day
        FROM ({SAMPLES_SQL}) WHERE sampled_at {IN} GROUP BY host""",
)
def growth(spark, sf):
    grown = growth_per_day(
        samples(spark, sf), SERIES, "sampled_at", ["io_read_bytes", "net_tx_bytes"], *window()
    )
    return rounded(grown, "net_tx_bytes_per_day").select(
        "host", "io_read_bytes_growth", "net_tx_bytes_growth", "net_tx_bytes_per_day"
    )


def total_sql(c: str, name: str) -> str:
    return f"""SELECT host, CAST(sum(d) AS BIGINT) AS "{name}" FROM (
      SELECT host, sampled_at, {delta_sql(c)} AS d FROM ({NEAR_SQL}) {W})
      WHERE sampled_at {IN} GROUP BY host"""


@query("g5_p12_window_total", total_sql("io_write_bytes", "total"))
def total(spark, sf):
    return window_total(
        samples(spark, sf), SERIES, "sampled_at", "io_write_bytes", *window(), reach()
    )


@query(
    "g7_guarded_ratio",
    """SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN
       round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) FILTER (WHERE o_orderstatus = 'F'), 3)
       END AS per_closed FROM orders GROUP BY o_custkey""",
)
def guarded(spark, sf):
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    closed = F.count_if(F.col("o_orderstatus") == "F")
    ratio = F.when(closed > 0, F.round(cents / closed, 3))
    return load(spark, sf, "orders").groupBy("o_custkey").agg(ratio.alias("per_closed"))


@query(
    "o1_latest_non_null",
    f"""SELECT host, arg_max(db_size_bytes, sampled_at) AS db_size_bytes FROM ({SAMPLES_SQL})
        WHERE db_size_bytes IS NOT NULL GROUP BY host""",
)
def latest(spark, sf):
    return latest_non_null(samples(spark, sf), SERIES, "sampled_at", "db_size_bytes")


@query(
    "o2_top_k",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events
       ORDER BY paid DESC NULLS LAST, event_id LIMIT 20""",
)
def largest(spark, sf):
    paid = F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid")
    return top_k(load(spark, sf, "events").select("event_id", paid), "paid", 20, ["event_id"])


@query(
    "o3_o4_order_by_time",
    "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id",
)
def newest_first(spark, sf):
    return load(spark, sf, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id")


@query("p11_time_filter", f"SELECT event_id FROM events WHERE ts {IN}")
def time_filter(spark, sf):
    return load(spark, sf, "events").where(in_window("ts", *window())).select("event_id")


LATEST_SQL = """SELECT host, arg_max({c}, sampled_at) AS "{label}" FROM ({s}) WHERE {c} IS NOT NULL
  GROUP BY host"""


@query("q9_available_cores", LATEST_SQL.format(c="host_nproc", label="Cores", s=SAMPLES_SQL))
def cores(spark, sf):
    return host.available_cores(samples(spark, sf), SERIES)


@query(
    "q9_available_memory",
    LATEST_SQL.format(c="host_mem_total_bytes", label="Memory", s=SAMPLES_SQL),
)
def memory(spark, sf):
    return host.available_memory(samples(spark, sf), SERIES)


@query("q10_traffic_sent", total_sql("net_tx_bytes", "Sent"))
def sent(spark, sf):
    return host.traffic_sent(samples(spark, sf), SERIES, *window(), reach())


@query("q10_traffic_received", total_sql("net_rx_bytes", "Received"))
def received(spark, sf):
    return host.traffic_received(samples(spark, sf), SERIES, *window(), reach())


def panel_sql(**columns: str) -> str:
    chosen = ", ".join(f'{sql} AS "{label}"' for label, sql in columns.items())
    return f"""SELECT * FROM (SELECT host, sampled_at AS time, {chosen} FROM ({NEAR_SQL}) {W})
      WHERE time {IN} ORDER BY time, host"""


@query(
    "q11_cpu_cores_used", panel_sql(**{"CPU cores busy": rate_sql("cpu_usage_usec", " * 1e6")})
)
def cpu(spark, sf):
    shown = host.cpu_cores_used(samples(spark, sf), SERIES, *window(), reach())
    return rounded(shown, "CPU cores busy")


@query(
    "q12_memory_used",
    f"""SELECT host, sampled_at AS time, mem_current_bytes AS "Memory used" FROM ({SAMPLES_SQL})
        WHERE sampled_at {IN} ORDER BY time, host""",
)
def memory_used(spark, sf):
    return host.memory_used(samples(spark, sf), SERIES, *window())


@query(
    "q13_disk_throughput",
    panel_sql(Read=rate_sql("io_read_bytes"), Write=rate_sql("io_write_bytes")),
)
def disk(spark, sf):
    shown = host.disk_throughput(samples(spark, sf), SERIES, *window(), reach())
    return rounded(shown, "Read", "Write")


@query(
    "q13_network_throughput",
    panel_sql(Sent=rate_sql("net_tx_bytes"), Received=rate_sql("net_rx_bytes")),
)
def network(spark, sf):
    shown = host.network_throughput(samples(spark, sf), SERIES, *window(), reach())
    return rounded(shown, "Sent", "Received")


def filled_sql(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER w"


@query(
    "q14_storage_used",
    panel_sql(
        **{
            "Database": filled_sql("db_size_bytes"),
            "All volumes": filled_sql("volume_size_bytes"),
            "Temp/spill": filled_sql("temp_size_bytes"),
        }
    ),
)
def storage(spark, sf):
    return host.storage_used(samples(spark, sf), SERIES, *window(), reach())


DAYS_SQL = "greatest((epoch_us(max(sampled_at)) - epoch_us(min(sampled_at))) / 86400e6, 1)"


@query(
    "q15_top_tables",
    f"""SELECT schemaname || '.' || relname AS "Table", max(s) - min(s) AS "Seq scans",
        max(i) - min(i) AS "Index scans", max(s) - min(s) + max(i) - min(i) AS "Total scans",
        round((max(s) - min(s) + max(i) - min(i)) / {DAYS_SQL}, 3) AS "Scans/day",
        max(n) AS "Live rows", max(h) - min(h) AS "Heap blocks read", max(x) - min(x) AS "Index blocks read"
        FROM (SELECT l_shipdate AS sampled_at, l_returnflag AS schemaname, CAST(l_partkey AS VARCHAR)
                AS relname, l_orderkey AS s, l_suppkey AS i, l_partkey + l_linenumber AS n,
                l_orderkey * 8 AS h, l_suppkey * 2 AS x FROM lineitem)
        WHERE sampled_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'
        GROUP BY schemaname, relname ORDER BY "Total scans" DESC NULLS LAST, schemaname, relname LIMIT 20""",
)
def tables(spark, sf):
    lines = load(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("sampled_at"),
        F.col("l_returnflag").alias("schemaname"),
        F.col("l_partkey").cast("string").alias("relname"),
        F.col("l_orderkey").alias("seq_scan"),
        F.col("l_suppkey").alias("idx_scan"),
        (F.col("l_partkey") + F.col("l_linenumber")).alias("n_live_tup"),
        (F.col("l_orderkey") * 8).alias("heap_blks_read"),
        (F.col("l_suppkey") * 2).alias("idx_blks_read"),
    )
    return host.top_tables(lines, at("1997-01-01"), at("1999-12-31"))


@query(
    "q16_top_queries",
    f"""SELECT left(query, 2000) AS "Query", max(calls) - min(calls) AS "Runs",
        round((max(t) - min(t)) / 1000, 3) AS "Time sec",
        round((max(calls) - min(calls)) / {DAYS_SQL}, 3) AS "Runs/day",
        round((max(t) - min(t)) / 1000 / {DAYS_SQL}, 3) AS "Time sec/day",
        CASE WHEN max(calls) - min(calls) > 0 THEN
          round((max(t) - min(t)) / 1000 / (max(calls) - min(calls)), 3) END AS "Avg sec"
        FROM (SELECT l_shipdate AS sampled_at, l_partkey AS queryid, 'select ' || l_partkey AS query,
                l_orderkey AS calls, l_extendedprice AS t FROM lineitem)
        WHERE sampled_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'
        GROUP BY queryid, query ORDER BY "Runs" DESC NULLS LAST, queryid, query LIMIT 20""",
)
def queries_run(spark, sf):
    lines = load(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("sampled_at"),
        F.col("l_partkey").alias("queryid"),
        F.concat(F.lit("select "), F.col("l_partkey").cast("string")).alias("query"),
        F.col("l_orderkey").alias("calls"),
        F.col("l_extendedprice").alias("total_exec_time"),
    )
    return host.top_queries(lines, at("1997-01-01"), at("1999-12-31"))
