"""Reading tenant files, stored sets, logs and device readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import MAX_READING_LENGTH, MAX_READINGS, READING_NAME


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, multi_line: bool = False
) -> DataFrame:
    """CSV with a header and declared types; empty is NULL, a misfit fails the read.

    The header is checked against the declared names, as the columns go by position. A quote in a quoted
    field is doubled, a backslash is a character like any other. Pass `multi_line` for files with line
    breaks in quoted fields; such a file is read by one task, as it can't be split.
    """
    return spark.read.schema(schema).csv(
        path,
        header=True,
        mode="FAILFAST",
        enforceSchema=False,
        nullValue="",
        quote='"',
        escape='"',
        multiLine=multi_line,
    )


def read_csv_text(
    spark: SparkSession, path: str | list[str], columns: Sequence[str], multi_line: bool = False
) -> DataFrame:
    """CSV with a header, every column as text, for a tenant whose formats are parsed later; otherwise as `read_csv`."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return read_csv(spark, path, schema, multi_line)


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    lines: bool = False,
) -> DataFrame:
    """JSON files that each hold one object or an array of objects.

    Such a file is read by one task, as it has no line structure to split at; pass `lines` for
    JSON lines, which split.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(path, multiLine=not lines)


def tenant_view(
    source: DataFrame, columns: Sequence[str | Column], scope: Column, name: str | None = None
) -> DataFrame:
    """What one tenant may see of a shared table: its rows, its columns. Both reach the scan."""
    view = source.where(scope).select(*columns)
    if name:
        view.createOrReplaceTempView(name)
    return view


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Log lines exactly as written, as `value`."""
    return spark.read.text(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Files as (path, modificationTime, length, content); the content is read only if used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def parse_readings(frame: DataFrame, query: str) -> DataFrame:
    """A device's URL parameters as one row of readings.

    Adds `readings` (name to value, both as they arrived), `names` (sorted, so that the order
    does not depend on the device) and `reject_reason`. Refused are: no parameters, too many of
    them, a name that would not do as a column name, a name given twice, an overlong value.
    """
    pieces = F.filter(
        F.split(F.coalesce(F.col(query), F.lit("")), "&"), lambda p: p != ""
    )

    def decoded(text: Column) -> Column:
        # Text with a broken escape stays as it is, but for the blanks.
        return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))

    def pair(piece: Column) -> Column:
        name = F.substring_index(piece, "=", 1)
        value = F.when(F.contains(piece, F.lit("=")), F.substr(piece, F.length(name) + 2)).otherwise("")
        return F.struct(decoded(name).alias("name"), decoded(value).alias("value"))

    parsed = frame.withColumn("_pairs", F.transform(pieces, pair)).withColumn(
        "names", F.array_sort(F.array_distinct(F.transform("_pairs", lambda p: p["name"])))
    )
    reason = (
        F.when(F.size("_pairs") == 0, "no parameters")
        .when(F.size("names") > MAX_READINGS, "too many parameters")
        .when(F.exists("names", lambda n: ~n.rlike(READING_NAME)), "invalid parameter name")
        .when(F.size("names") < F.size("_pairs"), "duplicate parameter")
        .when(
            F.exists("_pairs", lambda p: F.length(p["value"]) > MAX_READING_LENGTH),
            "value too long",
        )
    )
    accepted = F.col("reject_reason").isNull()
    return (
        parsed.withColumn("reject_reason", reason)
        .withColumn("readings", F.when(accepted, F.map_from_entries("_pairs")))
        .withColumn("names", F.when(accepted, F.col("names")))
        .drop("_pairs")
    )
