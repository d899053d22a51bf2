"""Sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.audits import audit_not_null, audit_unique, publish
from tidemark.operators.sync import apply_changes, reconcile, upsert
from tidemark.operators.validity import valid_at
from tidemark.plans.synthetic.registry import query
from tidemark.plans.synthetic.tenants import ALL_SQL, all_issues
from tidemark.session import load, work_path
from tidemark.sinks import versions
from tidemark.sinks.tables import (
    append_snapshot,
    convert,
    fan_out,
    refresh,
    registered,
    registry,
    rows_of_sets,
    store_set,
    upsert_partitions,
    view,
)
from tidemark.sources.files import read_csv, read_csv_text, read_json, read_lines

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CUSTOMER_SQL = "SELECT * FROM customer"


@query("s1_csv_declared", CUSTOMER_SQL)
def csv(spark, sf):
    path = work_path(spark, "csv")
    load(spark, sf, "customer").write.csv(path, header=True)
    return read_csv(spark, path, CUSTOMER)


@query(
    "s1_csv_empty_is_null",
    "SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS paid FROM events",
)
def csv_nulls(spark, sf):
    path = work_path(spark, "csv")
    paid = F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid")
    load(spark, sf, "events").select("event_id", paid).write.csv(path, header=True)
    return read_csv(spark, path, "event_id long, paid double")


@query(
    "s1_csv_quoted",
    """SELECT c_custkey, 'say "' || c_name || '", C:\\dir\\' AS said, 'two' || chr(10) || 'lines' AS note
    FROM customer""",
)
def csv_quoted(spark, sf):
    path = work_path(spark, "csv")
    line = F.concat(F.col("c_custkey"), F.lit(',"say ""'), F.col("c_name"), F.lit('"", C:\\dir\\","two\nlines"'))
    # Raw text, a thousand rows below a header to a file.
    files = load(spark, sf, "customer").groupBy((F.col("c_custkey") / 1000).cast("long").alias("file"))
    text = F.concat(F.lit("c_custkey,said,note\n"), F.array_join(F.collect_list(line), "\n"))
    files.agg(text.alias("value")).write.partitionBy("file").text(path)
    return read_csv(spark, f"{path}/*", "c_custkey long, said string, note string", multi_line=True)


@query(
    "s2_csv_text_then_dates",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS logged FROM orders",
)
def csv_text(spark, sf):
    path = work_path(spark, "csv")
    rows = load(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("logged"))
    rows.write.csv(path, header=True)
    text = read_csv_text(spark, path, ["o_orderkey", "logged"])
    return text.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.to_date("logged").alias("logged"))


@query("s4_json_lines", CUSTOMER_SQL)
def json(spark, sf):
    path = work_path(spark, "json")
    load(spark, sf, "customer").write.json(path)
    return read_json(spark, path, CUSTOMER, lines=True)


@query("s4_json_one_object_per_file", "SELECT r_regionkey, r_name FROM region")
def json_objects(spark, sf):
    # A document per file: each file is one task's work, as such files are.
    path = work_path(spark, "json")
    load(spark, sf, "region").select("r_regionkey", "r_name").repartition("r_regionkey").write.option(
        "maxRecordsPerFile", 1
    ).json(path)
    return read_json(spark, path, "r_regionkey int, r_name string")


@query(
    "s5_parquet_of_valid_sets",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'",
)
def valid_files(spark, sf):
    data, known = work_path(spark, "data"), work_path(spark, "registry")
    orders = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("set_id"), "o_orderdate")
    sets = orders.groupBy("set_id").agg(F.min("o_orderdate").alias("valid_from")).withColumn(
        "valid_until", F.when(F.col("set_id") == "P", F.col("valid_from"))
    )
    store_set(sets, orders.select("o_orderkey", "set_id"), "set_id", data, known)
    valid = valid_at(
        registry(spark, "set_id", known), "valid_from", "valid_until", F.lit("2001-01-01").cast("timestamp")
    )
    return rows_of_sets(spark, valid, "set_id", data).select("o_orderkey", F.col("set_id").alias("o_orderstatus"))


@query("s6_raw_lines", "SELECT props || chr(92) || event_type AS value FROM events")
def raw_lines(spark, sf):
    path = work_path(spark, "lines")
    line = F.concat(F.col("props"), F.lit("\\"), F.col("event_type"))
    load(spark, sf, "events").select(line).write.text(path)
    return read_lines(spark, path)


@query("k1_full_refresh", "SELECT * FROM supplier")
def refreshed(spark, sf):
    path = work_path(spark, "refresh")
    refresh(load(spark, sf, "supplier").where(F.col("s_acctbal") > 0), path)
    return refresh(load(spark, sf, "supplier"), path)


@query("k2_view", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def viewed(spark, sf):
    solvent = load(spark, sf, "supplier").where(F.col("s_acctbal") > 0)
    return view(solvent, "solvent_suppliers").select("s_suppkey", "s_name")


@query("k3_csv_to_parquet", CUSTOMER_SQL)
def csv_converted(spark, sf):
    source = work_path(spark, "csv")
    load(spark, sf, "customer").write.csv(source, header=True)
    return convert(spark, source, "csv", CUSTOMER, work_path(spark, "parquet")).drop("stem")


@query("k4_json_to_parquet", CUSTOMER_SQL)
def json_converted(spark, sf):
    source = work_path(spark, "json")
    load(spark, sf, "customer").write.json(source)
    options = {"multiLine": "false"}
    return convert(
        spark, source, "json", CUSTOMER, work_path(spark, "parquet"), options
    ).drop("stem")


@query("k5_fan_out", "SELECT o_orderstatus AS part, count(*) AS orders FROM orders GROUP BY 1")
def fanned_out(spark, sf):
    path = work_path(spark, "parts")
    orders = load(spark, sf, "orders").withColumn("part", F.col("o_orderstatus"))
    fan_out(orders, "part", path)
    return spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "k6_append_snapshot",
    """SELECT s_suppkey, tick AS sampled_at, CAST(tick AS DATE) AS day FROM supplier,
       (VALUES (TIMESTAMP '2024-01-01 23:59:00'), (TIMESTAMP '2024-01-02 00:00:00')) t(tick)""",
)
def snapshots(spark, sf):
    path = work_path(spark, "snapshots")
    for tick in ("2024-01-01 23:59:00", "2024-01-02 00:00:00"):
        rows = load(spark, sf, "supplier").select("s_suppkey")
        append_snapshot(rows, path, F.lit(tick).cast("timestamp"))
    return spark.read.parquet(path).select("s_suppkey", "sampled_at", "day")


@query(
    "k7_upsert_partitions",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS price,
       CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
       WHERE o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT'""",
)
def upserted(spark, sf):
    path = work_path(spark, "upsert")
    orders = load(spark, sf, "orders").withColumn("price", F.col("o_totalprice")).withColumn(
        "year", F.year("o_orderdate")
    )
    row = ["o_orderkey", "price", "year"]
    fan_out(orders.where(F.col("o_orderstatus") != "O").select(row), "year", path)
    # Pending orders change their price, urgent open ones are new.
    changed = orders.where(F.col("o_orderstatus") == "P").withColumn("price", F.lit(0.0))
    new = orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"))
    upsert_partitions(changed.select(row).unionByName(new.select(row)), path, ["o_orderkey"], "year")
    return spark.read.parquet(path).select(row)


@query(
    "k7_upsert",
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE c_mktsegment END AS c_mktsegment
       FROM customer""",
)
def merged(spark, sf):
    customers = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    blocked = customers.where(F.col("c_acctbal") < 0).withColumn("c_mktsegment", F.lit("blocked"))
    return upsert(customers, blocked, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@query("k9_set_all_or_nothing", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'")
def stored_sets(spark, sf):
    data, registry = work_path(spark, "data"), work_path(spark, "registry")
    rows = load(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("set_id"))
    sets = rows.select("set_id").distinct()
    store_set(sets.where("set_id <> 'P'"), rows.where("set_id <> 'P'"), "set_id", data, registry)
    # A job that wrote its rows and died before it registered the set.
    versions.write_rows(rows.where("set_id = 'P'").withColumn("bucket", F.lit(0)), data, ["bucket"])
    return registered(spark, "set_id", data, registry).select(
        "o_orderkey", F.col("set_id").alias("o_orderstatus")
    )


MIRROR = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'old' ELSE c_name END AS name FROM customer WHERE c_mktsegment <> 'BUILDING'"
SOURCE = "SELECT c_custkey, c_name AS name FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"


def mirror_and_source(spark, sf):
    customers = load(spark, sf, "customer")
    old = F.when(F.col("c_acctbal") < 0, "old").otherwise(F.col("c_name")).alias("name")
    mirror = customers.where(F.col("c_mktsegment") != "BUILDING").select("c_custkey", old)
    source = customers.where(F.col("c_mktsegment") != "HOUSEHOLD").select(
        "c_custkey", F.col("c_name").alias("name")
    )
    return mirror, source


@query(
    "k10_reconcile",
    f"""SELECT c_custkey, CASE WHEN s.c_custkey IS NULL THEN m.name ELSE s.name END AS name,
        CASE WHEN m.c_custkey IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'delete'
          WHEN m.name IS DISTINCT FROM s.name THEN 'update' ELSE 'same' END AS change
        FROM ({MIRROR}) m FULL JOIN ({SOURCE}) s USING (c_custkey)""",
)
def reconciled(spark, sf):
    return reconcile(*mirror_and_source(spark, sf), ["c_custkey"])


@query("k10_full_sync", SOURCE)
def synchronised(spark, sf):
    return apply_changes(reconcile(*mirror_and_source(spark, sf), ["c_custkey"]))


@query("a5_publish_after_audits", ALL_SQL)
def published(spark, sf):
    return publish(
        all_issues(spark, sf),
        {
            "unique": lambda f: audit_unique(f, ["tenant_id", "issue_id"]),
            "not null": lambda f: audit_not_null(f, ["tenant_id", "issue_id"]),
        },
        work_path(spark, "issues"),
    )
