"""Hourly rollups of a stream of samples that may arrive late."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.series import Rollup, hourly_rollup
from tidemark.sinks.tables import upsert_partitions


def gauge_stream(
    samples: DataFrame, series: Sequence[str], ts: str, gauges: Mapping[str, str], late: str
) -> DataFrame:
    """Average and peak of gauges per series and hour, each hour once it can no longer change."""
    out = [F.count(F.lit(1)).alias("samples")]
    for name, c in gauges.items():
        out += [F.avg(c).alias(f"{name}_avg"), F.max(c).alias(f"{name}_max")]
    hour = F.window(ts, "1 hour")
    grouped = samples.withWatermark(ts, late).groupBy(*series, hour).agg(*out)
    return grouped.withColumn("bucket", F.col("window.start")).drop("window")


def rollup_stream(
    samples: DataFrame,
    series: Sequence[str],
    ts: str,
    rollup: Rollup,
    path: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Keep an hourly table of counters and gauges up to date, however late a sample arrives.

    A counter's growth needs the sample before it, and a late sample changes the growth of the one
    after it. Below `path` there are three tables partitioned by day: `raw` with all samples,
    `ends` with the last sample of each series and day, and `hourly`. A batch is added to `raw`;
    then the (series, day) pairs it touches, and for each the series' next day on record, are
    rolled up again, with the last sample of the day before as the predecessor. `hourly` ends up
    as if all samples had arrived in order, and the scans are pruned to the days concerned.
    """
    spark = samples.sparkSession
    columns = samples.columns
    pair = [*series, "day"]
    raw_path, ends_path, hourly_path = f"{path}/raw", f"{path}/ends", f"{path}/hourly"

    def fold(batch: DataFrame, number: int) -> None:
        dated = batch.withColumn("day", F.to_date(ts))
        writer = dated.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite")
        writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(raw_path)
        # Days pass through the driver as partition names do; a batch touches few.
        days = [r[0] for r in dated.select("day").distinct().collect()]
        if not days:
            return
        raw = spark.read.parquet(raw_path).select(*columns, "day")
        touched = dated.select(*pair).distinct()

        last = F.max_by(F.struct(*columns), F.col(ts)).alias("last")
        ends = raw.where(F.col("day").isin(days)).groupBy(*series, F.col("day").cast("date").alias("day")).agg(last)
        upsert_partitions(ends, ends_path, pair, "day")

        in_order = Window.partitionBy(*series).orderBy("day")
        hit = touched.withColumn("_hit", F.lit(True))
        stored = spark.read.schema(ends.schema).parquet(ends_path).join(hit, pair, "left")
        # The touched pairs, and those whose predecessor was touched.
        marked = stored.withColumn(
            "_redo",
            F.coalesce("_hit", F.lag("_hit").over(in_order), F.lit(False)),
        ).withColumn("before", F.lag("last").over(in_order))
        redo = (
            marked.withColumn("_read", F.coalesce(F.lag("_redo").over(in_order), F.lit(False)))
            .where("_redo")
            .select(*pair, "before", "_read")
        )
        # Used three times and no larger than the batch: written down once.
        redo.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/redo")
        redo = spark.read.schema(redo.schema).parquet(f"{path}/redo")
        redo_days = [r[0] for r in redo.select("day").distinct().collect()]

        again = raw.where(F.col("day").isin(redo_days)).join(redo.select(*pair), pair, "left_semi")
        # Where the day before is not read itself, its last sample stands in for it.
        stand_in = redo.where(~F.col("_read") & F.col("before").isNotNull()).select("before.*")
        near = again.select(*columns).unionByName(stand_in.select(*columns))
        fresh = hourly_rollup(near, series, ts, rollup).withColumn("day", F.to_date("bucket"))
        upsert_partitions(
            fresh.join(redo.select(*pair), pair, "left_semi").select(*fresh.columns),
            hourly_path,
            [*series, "bucket"],
            "day",
        )

    writer = samples.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def hourly_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/hourly").drop("day")
