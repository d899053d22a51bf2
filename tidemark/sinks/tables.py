"""Writing tables: full refresh, append, upsert by partition, sets in buckets, conversion."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import any_of
from tidemark.operators.sync import upsert
from tidemark.sinks import versions

# Buckets of the rows that one call of `store_set` writes.
BUCKETS = 64


def refresh(frame: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace the versioned table at `path`; readers of the old rows keep them (`sinks/versions.py`)."""
    return versions.replace(frame, path, partition_by)


def view(frame: DataFrame, name: str) -> DataFrame:
    """A named, lazily computed table."""
    frame.createOrReplaceTempView(name)
    return frame.sparkSession.table(name)


def append_snapshot(frame: DataFrame, path: str, tick: Column, ts: str = "sampled_at") -> None:
    """Append a snapshot, each row stamped with the tick, in a partition per day."""
    stamped = frame.withColumn(ts, tick).withColumn("day", F.to_date(ts))
    stamped.write.mode("append").partitionBy("day").parquet(path)


def upsert_partitions(
    changes: DataFrame, path: str, keys: Sequence[str], partition: str
) -> None:
    """Upsert into a Parquet table partitioned by `partition`, a function of the key.

    Only the partitions in the batch are read and rewritten. Their names pass through the driver;
    there are as many as the batch has days or months. The batch, so that it is computed once, and
    the merged rows, as a table cannot be read while it is overwritten, are staged beside it, under
    names of this call. Rows without a partition value are a partition as well. A batch that holds a key
    twice is refused, since either row could win.
    """
    spark, table = changes.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        _upsert_partitions(spark, _staged(changes, f"{table}.batch"), path, f"{table}.merged", keys, partition)
    finally:
        for staged in (f"{table}.batch", f"{table}.merged"):
            where = spark._jvm.org.apache.hadoop.fs.Path(staged)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _upsert_partitions(
    spark: SparkSession, batch: DataFrame, path: str, staging: str, keys: Sequence[str], partition: str
) -> None:
    if not batch.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"the batch holds a key ({', '.join(keys)}) more than once")
    try:
        # Columns in the batch's order, so that the merged rows line up with the stored ones.
        base = spark.read.schema(batch.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return fan_out(batch, partition, path)
    touched = [r[0] for r in batch.select(partition).distinct().collect()]
    held = F.col(partition).isin([value for value in touched if value is not None])
    if None in touched:
        held = held | F.col(partition).isNull()
    merged = upsert(base.where(held), batch, keys)
    writer = _staged(merged, staging).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _staged(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fan_out(frame: DataFrame, part: str, path: str) -> None:
    """One table per value of `part`, below `path`, written in one pass.

    Rows are spread over tasks as they come, so a large part is written by many tasks.
    """
    writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(part).parquet(path)


def convert(
    spark: SparkSession,
    files: str | list[str],
    fmt: str,
    schema: T.StructType | str,
    path: str,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Convert CSV or JSON files to Parquet, one table per input file, named after its stem.

    All files go through one job, which takes files of equal layout; `options` go to the reader. Quotes in
    quoted CSV fields are doubled; `multiLine` is the option for line breaks in them.
    """
    csv = {"header": "true", "mode": "FAILFAST", "quote": '"', "escape": '"'}
    defaults = {"csv": csv, "json": {"multiLine": "true"}}
    reader = spark.read.format(fmt).schema(schema).options(**{**defaults[fmt], **(options or {})})
    rows = reader.load(files)
    name = F.col("_metadata.file_name")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    fan_out(rows.withColumn("stem", stem), "stem", path)
    return spark.read.parquet(path)


def store_set(
    sets: DataFrame, rows: DataFrame, set_key: str, data_path: str, registry_path: str, buckets: int = BUCKETS
) -> None:
    """Write the rows of some sets, then register the sets.

    The rows of a call go to one folder, in buckets by a hash of the set, however many sets there are. Readers start from
    the registry, a versioned table that says which folder and bucket a set is in, so a job that dies in between has stored
    nothing that anybody sees. A set that is stored again is read from its newest folder. A NULL key is no set.
    """
    bucket = F.pmod(F.xxhash64(F.col(set_key)), F.lit(buckets)).cast("int").alias("bucket")
    kept = rows.where(F.col(set_key).isNotNull())
    commit = versions.write_rows(kept.select(*rows.columns, bucket), data_path, ["bucket"])
    entries = sets.where(F.col(set_key).isNotNull()).select(*sets.columns, bucket, F.lit(commit).alias("stored_in"))
    spark = sets.sparkSession
    versions.add_version(spark, registry_path, versions.write_rows(entries, registry_path), replaces=False)


def registry(spark: SparkSession, set_key: str, registry_path: str) -> DataFrame:
    """The newest entry of each registered set, with its `bucket` and the folder it is `stored_in`."""
    known = versions.commits(spark, registry_path)
    entries = versions.read_commits(spark, registry_path, [e.commit for e in known])
    # One row per call of `store_set` since the registry was last compacted.
    order = spark.createDataFrame([(e.commit, e.version) for e in known], f"{versions.COMMIT} string, _version long")
    columns = [c for c in entries.columns if c != versions.COMMIT]
    newest = entries.join(F.broadcast(order), versions.COMMIT).groupBy(set_key).agg(
        F.max_by(F.struct(*columns), "_version").alias("_entry")
    )
    return newest.select("_entry.*")


def compact_registry(spark: SparkSession, set_key: str, registry_path: str) -> None:
    """One folder in place of one per call of `store_set`, without entries that newer ones replace.

    For times without writers: what is registered while this runs would be lost.
    """
    versions.replace(registry(spark, set_key, registry_path), registry_path)


def rows_of_sets(spark: SparkSession, chosen: DataFrame, set_key: str, data_path: str) -> DataFrame:
    """The stored rows of some sets of `registry`, with their set.

    Only the folders and buckets that hold one of them are read. Those pairs pass through the driver, as many as calls of
    `store_set` times buckets at most; the sets themselves meet their rows in a join.
    """
    wanted = chosen.select(set_key, "stored_in", "bucket").distinct()
    parts: dict[str, list[int]] = {}
    for r in wanted.select("stored_in", "bucket").distinct().collect():
        parts.setdefault(r.stored_in, []).append(r.bucket)
    if not parts:
        raise ValueError("no set to read")
    stored = versions.read_commits(spark, data_path, sorted(parts))
    held = any_of(
        (F.col(versions.COMMIT) == commit) & F.col("bucket").isin(sorted(buckets)) for commit, buckets in sorted(parts.items())
    )
    rows = stored.where(held).withColumnRenamed(versions.COMMIT, "stored_in")
    return rows.join(wanted, [set_key, "stored_in", "bucket"], "left_semi").drop("stored_in", "bucket")


def registered(spark: SparkSession, set_key: str, data_path: str, registry_path: str) -> DataFrame:
    """The stored rows of all registered sets."""
    return rows_of_sets(spark, registry(spark, set_key, registry_path), set_key, data_path)
