"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import discard, runs_on_executors, stored  # noqa: F401

runs_on_executors(__name__)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Documents are a few kB each and may be megabytes: small batches bound a Python worker's memory.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}


def prepare(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, taken: list[str]) -> str:
    """`name`, or the name with underscores, so that no column of `taken` has it in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def may_train(doc_id: Column) -> Column:
    """True for the rows that models may learn from: crc32 of the id as text mod 4 is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def spread(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, for `repartition` by a key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
