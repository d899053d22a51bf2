"""A content-addressed archive of WARC records.

Payload bytes are kept once each, under their SHA-256; the records' header bytes are kept exactly
and apart, and name their payload by that digest. A join of the two gives the records back. The
digest is checked when payloads are stored (equal digests of different lengths stop the job) and when
they are read (the bytes must have the digest that they are filed under).
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import runs_on_executors

runs_on_executors(__name__)

DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


@F.pandas_udf(T.BinaryType())
def packed(payload: pd.Series) -> pd.Series:
    """gzip, as WARC files pack their records; without a time, so that equal bytes pack alike."""
    return payload.map(lambda b: gzip.compress(b, 4, mtime=0))


@F.pandas_udf(T.BinaryType())
def unpacked(member: pd.Series) -> pd.Series:
    return member.map(gzip.decompress)


def base32(sha1_hex: Column) -> Column:
    """The 160 bits that 40 hexadecimal digits stand for in 32 characters, without padding."""
    parts = [
        F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record_id, uri, payload) of pages; null html is an empty payload."""
    return pages.select(
        F.col(page_id).alias("record_id"),
        # No line of a header may end early.
        F.regexp_replace(url, "[\\x00-\\x20]", "%20").alias("uri"),
        F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"")).alias("payload"),
    )


def _digested(records: DataFrame) -> DataFrame:
    return records.select(
        "record_id",
        "uri",
        F.sha2("payload", 256).alias("digest"),
        base32(F.sha1("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes"),
        "payload",
    )


def _header(response_id: Column, smallest: int) -> tuple[Column, Column]:
    """The kind of a record and its header bytes: the record's own, and those of the HTTP message."""
    revisit = (F.col("bytes") >= smallest) & ~F.col("record_id").eqNullSafe(response_id)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("record_id"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("uri")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(response_id))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    text = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http)
    return F.when(revisit, "revisit").otherwise("response"), F.encode(text, "UTF-8")


def archive(records: DataFrame, path: str, smallest: int = 0) -> None:
    """Write records (record_id, uri, payload) below `path`, as `payloads` and `headers`.

    Of records with equal payloads of at least `smallest` bytes, the one with the smallest id is a
    response and the others revisit it; rows that repeat that id are responses too, and their payload
    is still kept once. A null id counts as larger than any other. Payloads are packed before the
    shuffle, and copies are dropped before it, so a payload that a third of all records have reaches
    the store once per task.
    """
    rows = _digested(records)
    once = (
        rows.select("digest", "bytes", "record_id", packed("payload").alias("member"))
        .groupBy("digest")
        .agg(
            F.first("member").alias("member"),
            F.min("bytes").alias("bytes"),
            F.max("bytes").alias("most"),
            F.min("record_id").alias("response_id"),
        )
        .select(
            "digest",
            "member",
            F.when(F.col("bytes") == F.col("most"), F.col("bytes"))
            .otherwise(F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest"))).cast("long"))
            .alias("bytes"),
            "response_id",
        )
    )
    once.write.option("compression", "uncompressed").parquet(f"{path}/payloads")
    responses = records.sparkSession.read.parquet(f"{path}/payloads").select("digest", "response_id")
    kind, header = _header(F.col("response_id"), smallest)
    (
        rows.drop("payload")
        .join(responses, "digest")
        .select("record_id", kind.alias("record_type"), header.alias("header"), "digest")
        .write.parquet(f"{path}/headers")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: (record_id, header, payload, digest), payloads unpacked and checked."""
    headers = spark.read.parquet(f"{path}/headers").select("record_id", "header", "digest")
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "member")
    # Unpacked behind the join: the packed bytes are what the shuffle carries.
    rows = headers.join(payloads, "digest").withColumn("payload", unpacked("member"))
    return rows.select(
        "record_id",
        "header",
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("these bytes are not those of "), F.col("digest"))).cast("binary"))
        .alias("payload"),
        "digest",
    )


def field(header: Column, name: str) -> Column:
    """A field of a record's header, or null."""
    text = F.decode(header, "UTF-8")
    value = F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(value != "", value)


def original(archived: DataFrame) -> DataFrame:
    """(record_id, record): each record as a WARC file holds it; a revisit has no payload."""
    revisit = field(F.col("header"), "WARC-Type") == "revisit"
    return archived.select(
        "record_id",
        F.concat(
            F.col("header"),
            F.when(revisit, F.lit(b"")).otherwise(F.col("payload")),
            F.lit((CRLF + CRLF).encode()),
        ).alias("record"),
    )


def described(archived: DataFrame) -> DataFrame:
    """What the records read from an archive say, with length and SHA-1 of the payload as read."""
    header = F.col("header")
    id_of = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    own, target = id_of(field(header, "WARC-Record-ID")), id_of(field(header, "WARC-Refers-To"))
    return archived.select(
        F.when(own != "", own).cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32(F.sha1("payload")).alias("payload_digest"),
        field(header, "WARC-Type").alias("record_type"),
        F.when(target != "", target).cast("long").alias("refers_to"),
    )
