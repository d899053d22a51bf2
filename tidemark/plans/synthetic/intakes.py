"""Intake of files written from a table, a set per nation; two of the sets have a file that can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.registry import converters
from tidemark.plans.intake import Intake, csv_converter, json_converter, take_in
from tidemark.plans.synthetic.registry import query
from tidemark.session import load, work_path, written
from tidemark.sources.files import read_bodies

ROW = "c_custkey long, c_name string, c_acctbal double"
# The sets of nations 3 and 5 are broken.
GOOD_SQL = "SELECT c_custkey, c_name, c_acctbal, CAST(c_nationkey AS VARCHAR) AS set_id FROM customer WHERE c_nationkey NOT IN (3, 5)"
BODY_SQL = """SELECT c_nationkey, 'c_custkey,c_name,c_acctbal' || chr(10)
    || string_agg(c_custkey || ',' || c_name || ',' || printf('%.2f', c_acctbal), chr(10) ORDER BY c_custkey) || chr(10) AS body
    FROM customer WHERE c_nationkey NOT IN (3, 5) GROUP BY c_nationkey"""


@converters.register("Customers, CSV")
def customers_csv(files: DataFrame) -> DataFrame:
    return csv_converter(ROW)(files)


@converters.register("Customers, JSON")
def customers_json(files: DataFrame) -> DataFrame:
    return json_converter(ROW)(files)


def taken(spark: SparkSession, body, converter: str, customers: DataFrame) -> Intake:
    """What comes of a file per nation; `body` makes it of the nation and its sorted rows."""
    path = work_path(spark, "intake")
    rows = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal")))
    texts = customers.groupBy("c_nationkey").agg(rows.alias("rows"))
    # A file is one text value with a line break behind it.
    files = texts.select(F.col("c_nationkey").alias("set"), body(F.col("c_nationkey"), F.col("rows")).alias("value"))
    files.repartition("set").write.partitionBy("set").text(path)
    bodies = read_bodies(spark, path)
    none = F.lit(None).cast("string")
    manifest = bodies.select(
        F.regexp_extract("path", "/set=([0-9]+)/", 1).alias("set_id"), F.lit("customers").alias("dropzone"), F.lit("rows").alias("file"),
        F.lit(0).alias("position"), "path", F.lit("2024-01-01").cast("timestamp").alias("arrived_at"), none.alias("validity"),
        none.alias("valid_from"), none.alias("valid_until"), F.lit(True).alias("committed"), F.lit(False).alias("truncated"),
    )
    return take_in(written(manifest, "manifest"), bodies, "reject_empty_files", converter)


def csv_body(nation, rows):
    line = lambda r: F.concat_ws(",", r["c_custkey"].cast("string"), r["c_name"], F.format_string("%.2f", r["c_acctbal"]))
    header = F.when(nation == 5, "c_name,c_custkey,c_acctbal").otherwise("c_custkey,c_name,c_acctbal")
    last = F.when(nation == 3, F.array(F.lit("one,two,three"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(header), F.transform(rows, line), last), "\n")


def json_body(nation, rows):
    return F.concat(F.to_json(rows), F.when(nation.isin(3, 5), "]").otherwise(""))


def taken_csv(spark, sf) -> Intake:
    return taken(spark, csv_body, "customers_csv", load(spark, sf, "customer"))


@query("d2_f1_accepted_rows", GOOD_SQL)
def rows_taken(spark, sf):
    return taken_csv(spark, sf).rows.drop("file")


@query(
    "d2_f1_uploads",
    f"""SELECT CAST(c_nationkey AS VARCHAR) AS set_id, 'customers' AS dropzone, TIMESTAMP '2024-01-01' AS uploaded_at,
        TIMESTAMP '2024-01-01' AS valid_from, sha256(sha256(body)) AS sha256 FROM ({BODY_SQL})""",
)
def uploads_taken(spark, sf):
    return taken_csv(spark, sf).uploads.drop("valid_until")


@query(
    "d2_f1_rejects",
    """SELECT CAST(c_nationkey AS VARCHAR) AS set_id, CASE c_nationkey WHEN 3 THEN 'line ' || (count(*) + 2) || ' of file ''rows'' does not fit'
       ELSE 'the header of file ''rows'' is not c_custkey,c_name,c_acctbal' END AS reject_reason
       FROM customer WHERE c_nationkey IN (3, 5) GROUP BY c_nationkey""",
)
def sets_refused(spark, sf):
    return taken_csv(spark, sf).rejects


@query("d2_f1_accepted_json_rows", GOOD_SQL)
def json_rows_taken(spark, sf):
    return taken(spark, json_body, "customers_json", load(spark, sf, "customer")).rows.drop("file")
