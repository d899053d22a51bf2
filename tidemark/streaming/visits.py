"""Visit logs as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.visits import parse_visits


def log_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New log files in `folder`, line by line.

    Files must appear whole: a log is rotated into the folder, not written there. The checkpoint
    remembers the files read, so none is read twice and none is skipped after a failure.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder)


def store_visits(
    lines: DataFrame, visits_path: str, quarantine_path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Parse a stream of log lines into the visit table and the quarantine.

    Each batch writes its own partition of both tables, and a batch that is repeated after a
    failure replaces it, so every line counts exactly once.
    """

    def store(batch: DataFrame, number: int) -> None:
        visits, bad = parse_visits(batch)
        for frame, path in ((visits, visits_path), (bad, quarantine_path)):
            stamped = frame.withColumn("batch", F.lit(number).cast("long"))
            writer = stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("batch").parquet(path)

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
