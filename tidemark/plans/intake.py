"""Taking in upload sets: from a manifest of files to registered sets and their rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import is_json
from tidemark.operators.registry import Function, checkers, converters
from tidemark.operators.uploads import check_not_empty, set_digest, settle
from tidemark.operators.validity import UNTIL_REPLACED, validity

MANIFEST = (
    "set_id string, dropzone string, file string, position int, path string, "
    "arrived_at timestamp, validity string, valid_from string, valid_until string, "
    "committed boolean, truncated boolean"
)
"""One row per file; what concerns the set is the same on all its rows."""


class Intake(NamedTuple):
    uploads: DataFrame
    """Accepted sets: set_id, dropzone, uploaded_at, valid_from, valid_until, sha256."""
    rows: DataFrame
    """The converted rows of accepted sets, with their set_id."""
    rejects: DataFrame
    """set_id and reject_reason of the rest."""


@checkers.register("Reject empty files")
def reject_empty_files(files: DataFrame) -> DataFrame:
    return check_not_empty(files, "set_id", "position", "file", "length")


@converters.register("Lines")
def lines(files: DataFrame) -> DataFrame:
    """Every file as its non-empty text lines; a converter for a layout would go on from here."""
    text = F.explode(F.split(F.decode("content", "utf-8"), r"\r?\n")).alias("line")
    return files.select("set_id", "file", text).where(F.col("line") != "")


def csv_converter(schema: str) -> Function:
    """A converter of CSV files with a header and the given columns; a misfit refuses the file's set, and no other.

    A line is a row. Register what it returns under a name of its own.
    """
    columns = T.StructType.fromDDL(schema)
    broken = "_broken"
    layout = f"{schema}, {broken} string"
    header = ",".join(columns.names)

    def convert(files: DataFrame) -> DataFrame:
        text = _text(files)
        lines = text.select("set_id", "file", "_odd", F.posexplode(F.split("_text", r"\r?\n")).alias("_line", "_text"))
        parsed = F.from_csv("_text", layout, {"columnNameOfCorruptRecord": broken, "quote": '"', "escape": '"', "nullValue": ""})
        rows = lines.where((F.col("_text") != "") | F.col("_odd")).withColumn("_row", parsed)
        reason = (
            F.when(F.col("_odd"), F.format_string("file '%s' is not UTF-8", "file"))
            .when((F.col("_line") == 0) & (F.col("_text") != header), F.format_string(f"the header of file '%s' is not {header}", "file"))
            .when((F.col("_line") > 0) & F.col("_row")[broken].isNotNull(), F.format_string("line %d of file '%s' does not fit", F.col("_line") + 1, "file"))
        )
        rows = rows.withColumn("reject_reason", reason).where((F.col("_line") > 0) | F.col("reject_reason").isNotNull())
        return rows.select("set_id", "file", *[F.col("_row")[c].alias(c) for c in columns.names], "reject_reason")

    return convert


def json_converter(schema: str) -> Function:
    """A converter of JSON files, each an object or an array of objects; what is no JSON refuses the file's set, and no other."""
    columns = T.StructType.fromDDL(schema)

    def convert(files: DataFrame) -> DataFrame:
        text = _text(files)
        whole = F.when(F.col("_text").rlike(r"^\s*\["), F.col("_text")).otherwise(F.concat(F.lit("["), F.col("_text"), F.lit("]")))
        objects = is_json("_text") & F.col("_text").rlike(r"^\s*[\[{]")
        reason = F.when(F.col("_odd") | ~objects, F.format_string("file '%s' is not JSON", "file"))
        rows = text.select("set_id", "file", reason.alias("reject_reason"), F.from_json(whole, T.ArrayType(columns)).alias("_rows"))
        nothing = F.array(F.lit(None).cast(columns))
        rows = rows.withColumn("_row", F.explode(F.when(F.col("reject_reason").isNotNull(), nothing).otherwise(F.col("_rows"))))
        return rows.select("set_id", "file", *[F.col("_row")[c].alias(c) for c in columns.names], "reject_reason")

    return convert


def _text(files: DataFrame) -> DataFrame:
    """The files' bytes as text, and whether they are none (`_odd`)."""
    text = F.col("content").cast("string")
    odd = ~F.is_valid_utf8(text)
    return files.select("set_id", "file", odd.alias("_odd"), F.regexp_replace(F.when(odd, "").otherwise(text), "^\ufeff", "").alias("_text"))


def take_in(
    manifest: DataFrame,
    bodies: DataFrame,
    checker: str | None = None,
    converter: str | None = None,
    default_validity: str = UNTIL_REPLACED,
) -> Intake:
    """Check, hash and convert complete sets; each is taken whole or not at all.

    The digest is that of the files as they came, so that it does not change with the converter.
    Store the result with `store_set`, and close replaced uploads with `clip_incremental`.

    Args:
        manifest: MANIFEST rows.
        bodies: The files as (path, length, content), as `read_bodies` gives them. A file without
            a row there is empty.
        checker: Name of a registered checker: files in, one (set_id, reject_reason) per bad set.
        converter: Name of a registered converter: files in, rows with their set_id out. A row with a
            `reject_reason` refuses its set. Without a converter the files themselves are the rows.
        default_validity: The mode of sets that name none.
    """
    check = checkers.get(checker) if checker else None
    convert: Function | None = converters.get(converter) if converter else None

    first = lambda c: F.min_by(c, "position").alias(c)
    sets = manifest.groupBy("set_id").agg(
        *[first(c) for c in ("dropzone", "arrived_at", "validity", "valid_from", "valid_until")],
        F.bool_and("committed").alias("committed"),
        F.bool_or("truncated").alias("truncated"),
    )
    dated = validity(
        sets, "validity", "arrived_at", "valid_from", "valid_until", default_validity
    )
    reason = (
        F.when(~F.col("committed"), "not committed")
        .when(F.col("truncated"), "a file broke off")
        .otherwise(F.col("reject_reason"))
    )
    judged = dated.withColumn("reject_reason", reason)
    refused = judged.where(F.col("reject_reason").isNotNull()).select("set_id", "reject_reason")
    files = (
        manifest.join(refused, "set_id", "left_anti")
        .select("set_id", "file", "position", "path")
        .join(bodies.select("path", "length", "content"), "path", "left")
        # Spark's readers leave out empty files.
        .withColumn("length", F.coalesce("length", F.lit(0)))
        .withColumn("content", F.coalesce("content", F.lit(b"")))
    )
    rows = convert(files) if convert else files
    unread = []
    if convert and "reject_reason" in rows.columns:
        broken = rows.where(F.col("reject_reason").isNotNull())
        unread = [broken.groupBy("set_id").agg(F.min("reject_reason").alias("reject_reason"))]
        rows = rows.where(F.col("reject_reason").isNull()).drop("reject_reason")
    empty = (
        sets.select("set_id")
        .join(rows.select("set_id"), "set_id", "left_anti")
        .withColumn("reject_reason", F.lit("no files came of it"))
    )
    verdicts = [refused] + ([check(files)] if check else []) + unread + [empty]
    settled = settle(judged.drop("reject_reason"), "set_id", verdicts)

    good = settled.where(F.col("status") == "ok")
    uploads = good.join(set_digest(files, "set_id", "content"), "set_id").select(
        "set_id", "dropzone", F.col("arrived_at").alias("uploaded_at"), "valid_from",
        "valid_until", "sha256",
    )
    return Intake(
        uploads,
        rows.join(good.select("set_id"), "set_id", "left_semi"),
        settled.where(F.col("status") != "ok").select("set_id", "reject_reason"),
    )
