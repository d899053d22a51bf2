from datetime import datetime, timedelta

from tidemark.session import STATE_STORE
from tidemark.streaming.sets import MESSAGE, assemble_stream

T0 = datetime(2026, 1, 1)


def at(minute):
    return T0 + timedelta(minutes=minute)


def assembled(spark, tmp_path, batches, **options):
    """What comes of some batches, one after the other."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    source, name = tmp_path / "in", f"assembled{len(batches)}"
    source.mkdir()
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = assemble_stream(stream, 3600, "5 minutes", **options)
    q = (out.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).start())
    try:
        for rows in batches:
            spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
    finally:
        q.stop()
    return sorted((r.set_id, r.parts, r.last_part, r.status) for r in spark.table(name).collect())


def test_assembly(spark, tmp_path):
    batches = [
        [("a", at(0), "part", False), ("b", at(0), "part", True), ("c", at(1), "part", False), ("e", at(1), "commit", None)],
        [("a", at(2), "part", False), ("d", at(3), "part", False)],
        [("a", at(4), "commit", None), ("b", at(4), "commit", None), ("d", at(200), "part", False)],
        [("z", at(400), "part", False)],
        [("z", at(401), "part", False)],
    ]
    assert assembled(spark, tmp_path, batches) == sorted([
        ("a", 2, at(2), "complete"), ("b", 1, at(0), "truncated"), ("e", 0, None, "empty"),
        ("c", 1, at(1), "abandoned"), ("d", 2, at(200), "abandoned"),
    ])


def test_a_finished_set_gets_no_second_verdict(spark, tmp_path):
    batches = [
        [("a", at(0), "part", False), ("a", at(1), "commit", None), ("b", at(1), "part", False)],
        [("a", at(2), "part", True), ("a", at(3), "part", False), ("a", at(3), "commit", None)],
        [("z", at(200), "part", False)],  # b is abandoned
        [("z", at(201), "part", False), ("b", at(200), "part", False), ("b", at(201), "commit", None)],
        [("y", at(2000), "part", False)],  # a and b are forgotten
        [("y", at(2001), "commit", None)],
        [("a", at(2001), "part", False), ("a", at(2002), "commit", None)],  # a set of the same name
    ]
    assert assembled(spark, tmp_path, batches, remember_seconds=600 * 60) == sorted([
        ("a", 1, at(0), "complete"), ("a", 2, at(3), "late"), ("b", 1, at(1), "abandoned"), ("b", 1, at(200), "late"),
        ("z", 2, at(201), "abandoned"), ("y", 1, at(2000), "complete"), ("a", 1, at(2001), "complete"),
    ])
