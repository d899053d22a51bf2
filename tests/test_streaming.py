import random
from datetime import datetime, timedelta

from tests.test_visits import line
from tidemark.operators.series import Rollup, hourly_rollup
from tidemark.operators.visits import parse_visits
from tidemark.streaming.rollup import gauge_stream, hourly_table, rollup_stream
from tidemark.streaming.visits import log_stream, store_visits

SAMPLE = "host string, at timestamp, counter long, gauge long"
ROLLUP = Rollup(gauges={"gauge": "gauge"}, counters={"counter": "counter"}, rates={"rate": ("counter", 1.0)})


def sample_batches(seed):
    rng = random.Random(seed)
    t0 = datetime(2026, 1, 1)
    rows = []
    for host in "abc":
        for minute in rng.sample(range(0, 6 * 24 * 60), 60 if host != "c" else 6):
            rows.append((host, t0 + timedelta(minutes=minute), rng.randint(0, 1000), rng.randint(0, 9)))
    rng.shuffle(rows)
    return [rows[i::4] for i in range(4)]


def test_rollup_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    batches = sample_batches(1)
    for rows in batches:
        spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = rollup_stream(stream, ["host"], "at", ROLLUP, str(tmp_path / "t"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(300)
    assert q.exception() is None
    whole = hourly_rollup(spark.read.schema(SAMPLE).parquet(str(source)), ["host"], "at", ROLLUP)
    got = hourly_table(spark, str(tmp_path / "t")).select(whole.columns)
    key = lambda r: (r.host, r.bucket)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert len({key(r) for r in got.collect()}) == got.count()


def test_gauge_stream(spark, tmp_path):
    source = tmp_path / "in"
    t0 = datetime(2026, 1, 1)
    rows = [("a", t0 + timedelta(minutes=m), 0, g) for m, g in [(1, 1), (20, 3), (70, 5), (500, 7)]]
    spark.createDataFrame(rows, SAMPLE).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(SAMPLE).parquet(str(source))
    out = gauge_stream(stream, ["host"], "at", {"gauge": "gauge"}, "10 minutes")
    q = out.writeStream.format("memory").queryName("gauges").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = {(r.bucket, r.samples, r.gauge_avg, r.gauge_max) for r in spark.table("gauges").collect()}
    finally:
        q.stop()
    assert got == {(t0, 2, 2.0, 3), (t0 + timedelta(hours=1), 1, 5.0, 5)}


def test_visit_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    lines = [line(path=f"/dashboards/d/u{i}/x", dashboard_session=str(i)) for i in range(20)] + ["{", line(ts="x")]
    paths = [str(tmp_path / p) for p in ("visits", "bad", "cp")]
    for part in (lines[:9], lines[9:]):
        spark.createDataFrame([(t,) for t in part], "value string").coalesce(1).write.mode("append").text(str(source))
        # The second run resumes where the first one ended.
        q = store_visits(log_stream(spark, str(source), 1), *paths, once=True)
        q.awaitTermination(300)
        assert q.exception() is None
    visits, bad = parse_visits(spark.read.text(str(source)))
    got = spark.read.parquet(paths[0]).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, visits.collect()))
    assert sorted(r.line for r in spark.read.parquet(paths[1]).collect()) == sorted(r.line for r in bad.collect())
    assert got.count() == 20
