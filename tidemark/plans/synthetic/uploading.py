"""Upload sets: an order is an upload of its customer's dropzone, its lines are the files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import covers
from tidemark.operators.uploads import (
    accepted,
    check_has_files,
    check_not_empty,
    complete_sets,
    part_counts,
    safe_names,
    set_digest,
    settle,
)
from tidemark.operators.validity import (
    clip_incremental,
    clip_replaced,
    newest_valid_at,
    stored_files,
    valid_at,
    validity,
)
from tidemark.plans.synthetic.registry import query
from tidemark.session import load

PERIOD = ("valid_from", "valid_until")

UPLOADS_SQL = """
SELECT o_orderkey AS id, o_custkey AS zone, o_orderdate AS uploaded_at, o_orderstatus AS status,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS valid_from,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate + INTERVAL 30 DAY END AS valid_until
FROM orders"""


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Low priority is always valid, urgent for thirty days, the rest until replaced."""
    date, priority = F.col("o_orderdate"), F.col("o_orderpriority")
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("zone"),
        date.alias("uploaded_at"),
        F.col("o_orderstatus").alias("status"),
        F.when(priority != "5-LOW", date).alias("valid_from"),
        F.when(priority == "1-URGENT", date + F.expr("INTERVAL 30 DAYS")).alias("valid_until"),
    )


def clipped(spark, sf) -> DataFrame:
    return clip_replaced(uploads(spark, sf), "zone", "id", *PERIOD)


CLIPPED_SQL = f"""
WITH u AS ({UPLOADS_SQL}),
closer AS (SELECT a.id, arg_min(b.valid_from, b.id) AS ends FROM u a JOIN u b ON a.zone = b.zone
  AND b.id > a.id AND b.valid_from > a.valid_from WHERE a.valid_until IS NULL GROUP BY a.id)
SELECT u.id, zone, uploaded_at, status, valid_from, coalesce(valid_until, ends) AS valid_until
FROM u LEFT JOIN closer ON u.id = closer.id"""


query("d7_clip_replaced", CLIPPED_SQL)(clipped)

# The open orders are the batch that arrives after all others.
LATER = 1_000_000_000_000
BATCH_SQL = f"""
WITH u AS (SELECT * REPLACE (CASE WHEN status = 'O' THEN id + {LATER} ELSE id END AS id) FROM ({UPLOADS_SQL})),
closer AS (SELECT a.id, arg_min(b.valid_from, b.id) AS ends,
    arg_min(b.valid_from, b.id) FILTER (WHERE b.status <> 'O') AS ended FROM u a JOIN u b
  ON a.zone = b.zone AND b.id > a.id AND b.valid_from > a.valid_from
  WHERE a.valid_until IS NULL GROUP BY a.id)
SELECT u.id, valid_from, coalesce(valid_until, ends) AS valid_until
FROM u LEFT JOIN closer ON u.id = closer.id
WHERE status = 'O' OR (ends IS NOT NULL AND ended IS NULL)"""


@query("d7_clip_incremental", BATCH_SQL)
def clipped_batch(spark, sf):
    batch = F.col("status") == "O"
    rows = uploads(spark, sf).withColumn("id", F.when(batch, F.col("id") + LATER).otherwise(F.col("id")))
    stored = clip_replaced(rows.where(~batch), "zone", "id", *PERIOD)
    rewritten, new = clip_incremental(stored, rows.where(batch), "zone", "id", *PERIOD)
    return rewritten.unionByName(new).select("id", *PERIOD)


AT = "1998-06-01 00:00:00"


@query(
    "d8_p10_valid_at",
    f"""SELECT id, zone FROM ({CLIPPED_SQL}) WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}')
        AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AT}')""",
)
def valid(spark, sf):
    return valid_at(clipped(spark, sf), *PERIOD, F.lit(AT).cast("timestamp")).select("id", "zone")


@query(
    "d9_newest_valid_at",
    f"""SELECT t.moment AS "at", zone, arg_max(id, (uploaded_at, id)) AS id FROM ({CLIPPED_SQL}),
        (VALUES (TIMESTAMP '1996-01-01'), (TIMESTAMP '{AT}'), (TIMESTAMP '2001-03-01')) t(moment)
        WHERE (valid_from IS NULL OR valid_from <= moment) AND (valid_until IS NULL OR valid_until > moment)
        GROUP BY moment, zone""",
)
def newest(spark, sf):
    times = [datetime(1996, 1, 1), datetime.fromisoformat(AT), datetime(2001, 3, 1)]
    found = newest_valid_at(clipped(spark, sf), "zone", ["uploaded_at", "id"], *PERIOD, times)
    return found.select("at", "zone", "id")


@query(
    "d10_reading_in_effect",
    """SELECT t.moment AS "at", user_id, arg_max(event_id, ts) AS event_id FROM events,
       (VALUES (TIMESTAMP '2024-01-05'), (TIMESTAMP '2024-01-20 12:00:00')) t(moment)
       WHERE ts <= moment GROUP BY moment, user_id""",
)
def reading(spark, sf):
    readings = load(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.col("ts").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"),
    )
    in_turn = clip_replaced(readings, "user_id", "event_id", *PERIOD)
    times = [datetime(2024, 1, 5), datetime(2024, 1, 20, 12)]
    found = newest_valid_at(in_turn, "user_id", ["ts"], *PERIOD, times)
    return found.select("at", "user_id", "event_id")


@query(
    "d6_validity",
    """SELECT o_orderkey, CASE WHEN reject_reason IS NULL THEN f END AS valid_from,
        CASE WHEN reject_reason IS NULL THEN u END AS valid_until, reject_reason FROM (
      SELECT *, CASE WHEN mode = 'sometimes' THEN 'unknown validity'
          WHEN mode = 'period' AND o_orderstatus = 'P' THEN 'valid_from is not a date-time'
          WHEN mode = 'period' AND u <= f THEN 'the end is not after the start' END AS reject_reason
      FROM (SELECT *, CASE WHEN mode IN ('until_replaced', 'period') THEN o_orderdate END AS f,
          CASE WHEN mode = 'period' THEN TIMESTAMP '1998-01-01 10:00:00' END AS u
        FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'period' WHEN '2-HIGH' THEN 'sometimes'
            WHEN '5-LOW' THEN 'always' ELSE 'until_replaced' END AS mode FROM orders)))""",
)
def derived_validity(spark, sf):
    modes = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "period")
        .when(F.col("o_orderpriority") == "2-HIGH", "sometimes")
        .when(F.col("o_orderpriority") == "5-LOW", "always")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "until_replaced")
        .otherwise("")
    )
    start = F.when(F.col("o_orderstatus") == "P", "soon").when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    )
    orders = load(spark, sf, "orders").select(
        "o_orderkey", "o_orderdate", modes.alias("mode"), start.alias("valid_from"),
        F.lit("1998-01-01T12:00+02:00").alias("valid_until"),
    )
    return validity(
        orders, "mode", "o_orderdate", *PERIOD, default="until_replaced"
    ).select("o_orderkey", *PERIOD, "reject_reason")


SETS_SQL = """
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'rejected' WHEN name IS NULL THEN 'ok' ELSE 'rejected' END AS status,
  CASE WHEN n IS NULL THEN 'the set has no files' WHEN name IS NOT NULL THEN
    'file ''' || name || ''' is empty' END AS reject_reason
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n,
    arg_min(CAST(l_partkey AS VARCHAR), (l_linenumber, l_partkey)) FILTER (WHERE l_quantity = 1) AS name
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey"""


def line_files(spark, sf) -> DataFrame:
    """Lines as files; a line of quantity one stands for an empty file."""
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct("l_linenumber", "l_partkey").alias("position"),
        F.col("l_partkey").cast("string").alias("name"),
        (F.col("l_quantity") - 1).cast("long").alias("size"),
    )


def settled_sets(spark, sf) -> DataFrame:
    sets, files = load(spark, sf, "orders").select("o_orderkey"), line_files(spark, sf)
    verdicts = [
        check_has_files(sets, files, "o_orderkey"),
        check_not_empty(files, "o_orderkey", "position", "name", "size"),
    ]
    return settle(sets, "o_orderkey", verdicts)


query("d1_d2_d3_settle_sets", SETS_SQL)(settled_sets)


@query(
    "d2_accepted_files",
    f"""SELECT l_orderkey AS o_orderkey, CAST(l_partkey AS VARCHAR) AS name FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM ({SETS_SQL}) WHERE status = 'ok')""",
)
def files_taken(spark, sf):
    kept = accepted(line_files(spark, sf), settled_sets(spark, sf), "o_orderkey")
    return kept.select("o_orderkey", "name")


@query(
    "d4_safe_names",
    """SELECT event_id, event_type || CASE WHEN rn > 1 THEN '_' || (rn - 1) ELSE '' END || '.csv'
       AS safe_name FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
         ORDER BY event_id) AS rn FROM events)""",
)
def names(spark, sf):
    files = load(spark, sf, "events").select(
        "user_id", "event_id", F.concat(F.lit("in/"), F.col("event_type"), F.lit(".csv")).alias("name")
    )
    return safe_names(files, "user_id", "event_id", "name").select("event_id", "safe_name")


# Files of a set take their names one after the other: a step of the recursion is the next file of each set.
SUFFIXES_SQL = """
WITH RECURSIVE f AS (
    SELECT user_id, event_id, event_type || CASE WHEN value > 20 THEN '_1' ELSE '' END AS stem,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n, event_type
    FROM events
),
t AS (
    SELECT user_id, event_type, 0::BIGINT AS n, []::VARCHAR[] AS taken, NULL::BIGINT AS event_id, NULL::VARCHAR AS safe_name
    FROM (SELECT DISTINCT user_id, event_type FROM events)
    UNION ALL
    SELECT user_id, event_type, n, list_append(taken, safe_name), event_id, safe_name
    FROM (
        SELECT t.user_id, t.event_type, f.n, t.taken, f.event_id,
            CASE WHEN NOT list_contains(t.taken, f.stem || '.csv') THEN f.stem || '.csv' ELSE f.stem || '_'
                || list_filter(range(1, f.n + 1), lambda i: NOT list_contains(t.taken, f.stem || '_' || i || '.csv'))[1] || '.csv'
            END AS safe_name
        FROM t JOIN f ON f.user_id = t.user_id AND f.event_type = t.event_type AND f.n = t.n + 1
    )
)
SELECT event_id, safe_name FROM t WHERE n > 0"""


@query("d4_safe_names_with_real_suffixes", SUFFIXES_SQL)
def suffixed_names(spark, sf):
    stem = F.when(F.col("value") > 20, F.concat("event_type", F.lit("_1"))).otherwise(F.col("event_type"))
    files = load(spark, sf, "events").select(
        "user_id", "event_id", F.concat(stem, F.lit(".csv")).alias("name")
    )
    return safe_names(files, "user_id", "event_id", "name").select("event_id", "safe_name")


@query(
    "g9_files_per_set",
    "SELECT l_orderkey AS upload_id, count(*) AS files FROM lineitem GROUP BY l_orderkey",
)
def counts(spark, sf):
    files = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("upload_id"))
    return part_counts(files, "upload_id")


@query(
    "d5_g10_set_digest",
    """SELECT conv_id, sha256(string_agg(digest, '' ORDER BY digest)) AS sha256
       FROM (SELECT conv_id, sha256(text) AS digest FROM conversations) GROUP BY conv_id""",
)
def digests(spark, sf):
    return set_digest(load(spark, sf, "conversations"), "conv_id", "text")


STATUS_SQL = """
SELECT coalesce(l_orderkey, o_orderkey) AS set_id, coalesce(n, 0) AS parts, last_part,
  CASE WHEN o_orderkey IS NOT NULL AND n IS NULL THEN 'empty'
    WHEN o_orderkey IS NOT NULL AND cut THEN 'truncated' WHEN o_orderkey IS NOT NULL THEN 'complete'
    WHEN last_part < TIMESTAMP '2000-01-01' - INTERVAL 2 DAY THEN 'abandoned' ELSE 'open' END AS status
FROM (SELECT l_orderkey, count(*) AS n, bool_or(l_quantity = 50) AS cut, max(l_shipdate) AS last_part
      FROM lineitem GROUP BY l_orderkey)
FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey"""


def assembled(spark, sf) -> tuple[DataFrame, DataFrame]:
    parts = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("set_id"), F.col("l_shipdate").alias("at"), "l_partkey",
        (F.col("l_quantity") == 50).alias("cut"),
    )
    commits = load(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("set_id")
    )
    return complete_sets(
        parts, commits, "set_id", "at", "cut", F.lit("2000-01-01").cast("timestamp"),
        F.expr("INTERVAL 2 DAYS"),
    )


@query("d11_d12_set_status", STATUS_SQL)
def set_status(spark, sf):
    return assembled(spark, sf)[1]


@query(
    "d11_parts_of_complete_sets",
    f"""SELECT l_orderkey AS set_id, l_shipdate AS at, l_partkey FROM lineitem WHERE l_orderkey IN
        (SELECT set_id FROM ({STATUS_SQL}) WHERE status = 'complete')""",
)
def set_parts(spark, sf):
    return assembled(spark, sf)[0].select("set_id", "at", "l_partkey")


@query(
    "j8_files_valid_at",
    f"""SELECT id AS upload_id, uploaded_at, CAST(l_partkey AS VARCHAR) AS file FROM ({CLIPPED_SQL})
        JOIN lineitem ON l_orderkey = id JOIN customer ON c_custkey = zone
        WHERE c_name = 'Customer#000000007' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}')
          AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AT}')""",
)
def files_valid(spark, sf):
    files = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"), F.col("l_partkey").cast("string").alias("file")
    )
    zones = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    sets = clipped(spark, sf).withColumnRenamed("zone", "dropzone_id")
    return stored_files(
        sets, files, zones, "Customer#000000007", F.lit(AT).cast("timestamp")
    ).select("upload_id", "uploaded_at", "file")


@query(
    "p10_interval_containment",
    f"""SELECT id, uploaded_at, (valid_from IS NULL OR valid_from <= TIMESTAMP '{AT}')
        AND (valid_until IS NULL OR valid_until > TIMESTAMP '{AT}') AS covered FROM ({UPLOADS_SQL})""",
)
def containment(spark, sf):
    covered = covers("valid_from", "valid_until", F.lit(AT).cast("timestamp"))
    return uploads(spark, sf).select("id", "uploaded_at", covered.alias("covered"))
