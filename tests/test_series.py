import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import slices
from tidemark.operators.series import (
    Rollup, collapse, counter_delta, counter_rate, forward_fill, growth_per_day, hourly_rollup,
    latest_non_null, rollup_and_prune, sum_devices, top_k, total_by, window_total,
)
from tidemark.operators.slices import find_cuts, running_count
from tidemark.plans import host
from tidemark.schemas import HOST_SAMPLE

T0 = datetime(2026, 1, 1)
SCHEMA = "host string, at timestamp, c long, g long"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def ts(moment):
    return F.lit(moment).cast("timestamp")


def frame(spark, rows):
    return spark.createDataFrame([(h, at(m), c, g) for h, m, c, g in rows], SCHEMA)


CASES = [("a", 0, 10, None), ("a", 1, 15, 7), ("a", 2, 3, None), ("a", 3, None, None),
         ("a", 4, 9, 1), ("a", 4.5, 12, None), ("b", 2, 100, None), ("b", 70, 160, 5)]


def by_row(got, *columns):
    return {(r.host, r["at"]): tuple(r[c] for c in columns) for r in got.collect()}


def test_delta_rate_fill(spark):
    rows = frame(spark, CASES)
    got = by_row(counter_delta(rows, ["host"], "at", ["c"]), "d_c")
    assert [got["a", at(m)][0] for m in (0, 1, 2, 3, 4, 4.5)] == [0, 5, 0, 0, 0, 3]
    got = by_row(counter_rate(rows, ["host"], "at", ["c"]), "rate_c")
    assert [got["a", at(m)][0] for m in (0, 1, 2, 4.5)] == [None, 5 / 60, 0.0, 0.1]
    assert got["b", at(70)] == (60 / (68 * 60),)
    got = by_row(forward_fill(rows, ["host"], "at", ["g"]), "g")
    assert [got["a", at(m)][0] for m in (0, 1, 2, 3, 4, 4.5)] == [None, 7, 7, 7, 1, 1]
    assert got["b", at(2)] == (None,)


def random_series(seed, n=400):
    rng = random.Random(seed)
    minutes = rng.sample(range(100_000), n)
    maybe = lambda: rng.choice([None, rng.randint(0, 99)])
    return [(rng.choice("aaaaab"), m, rng.randint(0, 1000), maybe()) for m in minutes]


def test_hot_series_equal_plain_ones(spark, monkeypatch):
    rows = frame(spark, random_series(2))
    jobs = {
        "delta": lambda: counter_delta(rows, ["host"], "at", ["c", "g"]),
        "rate": lambda: counter_rate(rows, ["host"], "at", ["c"]),
        "fill": lambda: forward_fill(rows, ["host"], "at", ["g"]),
        "rank": lambda: running_count(rows, ["host"], ["at"], "n"),
    }
    plain = {k: sorted(map(tuple, f().collect())) for k, f in jobs.items()}
    monkeypatch.setattr(slices, "ROWS_PER_TASK", 30)
    cuts = find_cuts(rows, ["host"], "at")
    table = cuts.table.collect()
    assert {r.host for r in table} == {"a", "b"} and max(len(r._cuts) for r in table) >= 9
    for name, job in jobs.items():
        assert sorted(map(tuple, job().collect())) == plain[name], name


def test_slices_are_even_and_bounded(spark):
    rows = spark.range(100_000).selectExpr("id % 3 = 0 AS k", "timestamp_micros(id * id) AS at")
    cuts = find_cuts(rows, ["k"], "at", rows_per_task=5_000)
    sizes = [r["count"] for r in slices.with_slice(rows, cuts, ["k"], "at").groupBy("k", slices.SLICE).count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) < 6_500
    assert find_cuts(rows, ["k"], "at", rows_per_task=200_000) is None
    many = find_cuts(rows, ["k"], "at", rows_per_task=40)
    assert many.longest > 1_500
    sizes = slices.with_slice(rows, many, ["k"], "at").groupBy("k", slices.SLICE).count()
    assert sizes.agg(F.max("count"), F.sum("count")).first()[1] == 100_000
    assert sizes.agg(F.max("count")).first()[0] < 150
    few = find_cuts(rows, ["k"], "at", rows_per_task=1, max_slices=10)
    assert sum(len(r._cuts) for r in few.table.collect()) <= 12


ROLLUP = Rollup(gauges={"g": "g"}, counters={"c": "c"}, rates={"r": ("c", 1.0)})


def test_rollup(spark):
    rows = frame(spark, [("a", 50, 10, 1), ("a", 59, 20, None), ("a", 65, 50, 3), ("a", 300, 5, 4)])
    got = {r.bucket: r.asDict() for r in hourly_rollup(rows, ["host"], "at", ROLLUP).collect()}
    first, second, last = got[at(0)], got[at(60)], got[at(300)]
    assert (first["samples"], first["c_sum"], first["g_avg"], first["anchored"]) == (2, 10, 1.0, False)
    # Growth across the edge belongs to the later hour.
    assert (second["c_sum"], second["r_max"], second["anchored"]) == (30, 30 / 360, True)
    assert last["c_sum"] == 0
    totals = total_by(hourly_rollup(rows, ["host"], "at", ROLLUP), ["host"], "bucket", "month", ["c_sum"])
    assert [r.c_sum for r in totals.collect()] == [40]


def test_rollup_and_prune_keeps_whole_hours(spark, tmp_path):
    raw = frame(spark, [("a", m, m * 10, m) for m in range(0, 600, 7)])
    whole = hourly_rollup(raw, ["host"], "at", ROLLUP)
    expected = sorted(map(tuple, whole.collect()))
    hourly = whole.limit(0)
    # As time goes on, the raw rows go; the hours stay as they were.
    for step, minutes in enumerate((600, 700, 733, 733, 800)):
        raw, hourly = rollup_and_prune(
            raw, hourly, ["host"], "at", ROLLUP, ts(at(minutes)),
            F.expr("INTERVAL 4 HOURS"), F.expr("INTERVAL 1 DAY"),
        )
        for name, f in (("raw", raw), ("hourly", hourly)):
            f.write.parquet(str(tmp_path / f"{name}{step}"))
        raw, hourly = (spark.read.parquet(str(tmp_path / f"{n}{step}")) for n in ("raw", "hourly"))
        assert sorted(map(tuple, hourly.collect())) == expected
    assert raw.agg(F.min("at")).first()[0] >= at(800 - 240)


def test_window_total(spark):
    rows = frame(spark, [("a", 0, 10, 0), ("a", 50, 30, 0), ("a", 70, 5, 0), ("a", 80, 25, 0), ("a", 200, 99, 0)])
    hour = F.expr("INTERVAL 1 HOUR")
    got = window_total(rows, ["host"], "at", "c", ts(at(50)), ts(at(80)), hour)
    assert [r.total for r in got.collect()] == [40]
    # The predecessor lies further back than the lookback: its delta is lost.
    got = window_total(rows, ["host"], "at", "c", ts(at(190)), ts(at(300)), hour)
    assert [r.total for r in got.collect()] == [0]


def test_growth_latest_top_and_sums(spark):
    rows = frame(spark, [("a", 0, 10, 1), ("a", 60, 40, None), ("b", 0, 5, 2), ("b", 4320, 65, 3), ("c", 1, None, None)])
    got = {r.host: (r.c_growth, r.c_per_day) for r in
           growth_per_day(rows, ["host"], "at", ["c"], ts(at(0)), ts(at(9999))).collect()}
    assert got == {"a": (30, 30.0), "b": (60, 20.0), "c": (None, None)}
    assert {r.host: r.g for r in latest_non_null(rows, ["host"], "at", "g").collect()} == {"a": 1, "b": 3}
    assert [(r.host, r.c) for r in top_k(rows, "c", 5, ["host"]).collect()] == [
        ("b", 65), ("a", 40), ("a", 10), ("b", 5), ("c", None)]
    assert {r["at"]: r.c for r in sum_devices(rows, ["at"], ["c"]).collect()}[at(0)] == 15
    texts = spark.createDataFrame([(1, "bb", 1), (1, "ba", 2), (None, "z", 9)], "id int, t string, n long")
    assert [tuple(r) for r in collapse(texts, "id", "t", ["n"], 1).collect()] == [(1, "b", 3)]


def test_dashboard_over_one_host(spark):
    empty = [None] * 14
    rows = [(at(m), m * 60_000_000, 8, *empty[2:]) for m in range(0, 10)]
    samples = spark.createDataFrame(rows, HOST_SAMPLE)
    busy = host.cpu_cores_used(samples, [], ts(at(0)), ts(at(9))).collect()
    assert [r["CPU cores busy"] for r in busy] == [None] + [1.0] * 9
    assert host.available_cores(samples, []).first()["Cores"] == 8
    assert host.traffic_sent(samples, [], ts(at(0)), ts(at(9))).first()["Sent"] == 0
    rolled = hourly_rollup(samples, [], "sampled_at", host.HOST_ROLLUP).first()
    assert (rolled.samples, rolled.cpu_cores_avg, rolled.io_read_bytes_sum) == (10, 1.0, 0)


@pytest.mark.parametrize("hot", [False, True])
def test_single_series_without_key(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(slices, "ROWS_PER_TASK", 20)
    rows = frame(spark, random_series(4, 200)).drop("host")
    got = counter_delta(rows, [], "at", ["c"]).orderBy("at").collect()
    values = [r.c for r in got]
    assert [r.d_c for r in got] == [0] + [max(b - a, 0) for a, b in zip(values, values[1:])]
