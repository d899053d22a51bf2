"""Session settings and the shared folder that multi-step jobs write to."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    # Every timestamp in this package is read and written in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Zoneless Parquet timestamps are read as UTC instants, so that filters reach the scan, which a
    # cast would prevent.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The joins rely on this to split a hot join key over several tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A union of equally partitioned inputs otherwise fails to run when adaptive execution turns the
    # join in one of them into a broadcast join ("Can't zip RDDs with unequal numbers ...").
    "spark.sql.unionOutputPartitioning": "false",
    # Upserts rewrite only the partitions that a batch touches.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What a step has shuffled goes when the step has ended. Else it stays until the driver happens to collect its garbage, and
    # a job of many steps fills the disks with the shuffles of all of them. A frame that runs twice shuffles anew.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # An object that names a key twice is JSON; the last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Needed by transformWithState only.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session(
    master: str | None = None, app: str = "tidemark", conf: dict[str, str] | None = None
) -> SparkSession:
    """A session with the settings this package expects, and those in `conf`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **(conf or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def runs_on_executors(module: str) -> None:
    """Send a module's functions to the executors by value.

    For the few modules with Python that runs there, so that the package need not be installed
    on every machine.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, as the cluster sets it.

    Only a local session without the setting falls back to a temporary folder, one per
    application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _fallback:
        _fallback[context.applicationId] = tempfile.mkdtemp(prefix="tidemark-")
    return _fallback[context.applicationId]


def work_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back.

    For a derived table that several steps read: it is computed once, and a lost executor costs
    no more than the step at hand.
    """
    return stored(frame, name)[0]


def stored(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As `written`, with the table's path, so that it can be discarded."""
    path = work_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that `stored` wrote and nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One Parquet table, with zoneless timestamps as UTC instants.

    `withWatermark` and `unix_micros` refuse zoneless timestamps. With the settings above there
    are none; the cast is for sessions without them.
    """
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    for field in frame.schema:
        if isinstance(field.dataType, T.TimestampNTZType):
            frame = frame.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return frame


def zoneless(frame: DataFrame) -> DataFrame:
    """UTC instants back to zoneless timestamps, as the input tables store them."""
    columns = [
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name)
        for f in frame.schema
    ]
    return frame.select(*columns)
