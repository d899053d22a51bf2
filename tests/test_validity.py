import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import READING_NAME
from tidemark.operators import slices
from tidemark.operators import uploads as uploads_operators
from tidemark.operators import validity as validity_operators
from tidemark.operators.slices import find_cuts
from tidemark.operators.uploads import (
    accepted, check_has_files, check_not_empty, complete_sets, part_counts, safe_names,
    set_digest, settle,
)
from tidemark.operators.validity import (
    clip_incremental, clip_replaced, newest_valid_at, stored_files, valid_at, validity,
)

T0 = datetime(2026, 1, 1)
DAY = timedelta(days=1)
SCHEMA = "id long, zone string, valid_from timestamp, valid_until timestamp"


def uploads(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clipped(frame, **kw):
    out = clip_replaced(frame, "zone", "id", "valid_from", "valid_until", **kw)
    return {r.id: (r.valid_from, r.valid_until) for r in out.collect()}


def replay(rows):
    stored = {}
    for id_, zone, start, end in rows:
        if start is not None:
            for other, (z, s, e) in stored.items():
                if z == zone and s is not None and e is None and s < start:
                    stored[other] = (z, s, start)
        stored[id_] = (zone, start, end)
    return {i: (s, e) for i, (_, s, e) in stored.items()}


CASES = {
    "replaced": [("z", T0, None), ("z", T0 + 7 * DAY, None)],
    "always stays": [("z", None, None), ("z", T0, None)],
    "fixed end stays": [("z", T0, T0 + 3 * DAY), ("z", T0 + DAY, None)],
    "back-dated clips nothing later": [("z", T0, None), ("z", T0 - 7 * DAY, None)],
    "always clips nothing": [("z", T0, None), ("z", None, None)],
    "other zone": [("o", T0, None), ("z", T0 + DAY, None)],
    "equal starts": [("z", T0, None), ("z", T0, None)],
}


def test_clipping_cases(spark):
    rows, expected = [], {}
    for name, case in CASES.items():
        mine = [(len(rows) + i, f"{name}/{z}", s, e) for i, (z, s, e) in enumerate(case)]
        rows += mine
        expected |= replay(mine)
    assert clipped(uploads(spark, rows)) == expected
    assert expected[0] == (T0, T0 + 7 * DAY)


def random_uploads(n, zones, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = None if rng.random() < 0.1 else T0 + rng.randint(0, 60) * DAY
        end = start + DAY * rng.randint(1, 9) if start and rng.random() < 0.2 else None
        rows.append((i, rng.choice(zones), start, end))
    return rows


@pytest.mark.parametrize("rows_per_task", [None, 10])
def test_clipping_equals_replay(spark, rows_per_task):
    rows = random_uploads(400, ["a", "a", "a", "b", "c"], 5)
    frame = uploads(spark, rows)
    started = frame.where("valid_from is not null")
    cuts = rows_per_task and find_cuts(started, ["zone"], "id", rows_per_task)
    assert clipped(frame, cuts=cuts or None) == replay(rows)


@pytest.mark.parametrize("branch", [2, 3, 64])
@pytest.mark.parametrize("falling", [False, True])
def test_clipping_with_blocks_of_any_size(spark, monkeypatch, branch, falling):
    """Small blocks make many levels; falling starts leave all uploads of a zone waiting to its end."""
    monkeypatch.setattr(validity_operators, "BRANCH", branch)
    rows = random_uploads(300, [f"z{i}" for i in range(10)] + ["big"] * 20, 6)
    if falling:
        rows = [(i, z, s and T0 - i * DAY, None) for i, z, s, _ in rows] + [(900, "big", T0 - 150 * DAY, None), (901, "big", T0 + DAY, None)]
    frame = clip_replaced(uploads(spark, rows), "zone", "id", "valid_from", "valid_until")
    assert {r.id: (r.valid_from, r.valid_until) for r in frame.collect()} == replay(rows)
    plan = frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Arrow" not in plan and "Python" not in plan


def test_clipping_keeps_other_columns_and_odd_rows(spark):
    frame = uploads(spark, [(1, None, T0, None), (2, "z", None, None), (3, "z", T0, None)]).withColumn("note", F.lit("n"))
    out = clip_replaced(frame, "zone", "id", "valid_from", "valid_until")
    assert out.columns == frame.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, frame.collect()))
    assert clip_replaced(frame.limit(0), "zone", "id", "valid_from", "valid_until").collect() == []


def test_incremental_equals_replay(spark):
    rows = random_uploads(200, ["a", "b", "c"], 9)
    before, batch = rows[:150], rows[150:]
    stored = replay(before)
    zone = {r[0]: r[1] for r in rows}
    old = uploads(spark, [(i, zone[i], s, e) for i, (s, e) in stored.items()])
    rewritten, fresh = clip_incremental(
        old, uploads(spark, batch), "zone", "id", "valid_from", "valid_until"
    )
    for r in [*rewritten.collect(), *fresh.collect()]:
        stored[r.id] = (r.valid_from, r.valid_until)
    assert stored == replay(rows)


def test_valid_at_bounds_and_newest(spark):
    rows = [(1, "z", None, None), (2, "z", T0, None), (3, "z", T0 + 10 * DAY, None)]
    frame = clip_replaced(uploads(spark, rows), "zone", "id", "valid_from", "valid_until")
    at = [T0 - DAY, T0, T0 + 5 * DAY, T0 + 10 * DAY, T0 + 20 * DAY]
    got = newest_valid_at(frame, "zone", ["id"], "valid_from", "valid_until", at)
    assert {r["at"]: r.id for r in got.collect()} == dict(zip(at, [1, 2, 2, 3, 3]))
    covered = valid_at(frame, "valid_from", "valid_until", F.lit(T0 + 10 * DAY).cast("timestamp"))
    assert sorted(r.id for r in covered.collect()) == [1, 3]


def test_back_dated_upload_wins_later(spark):
    rows = [(1, "z", T0, None), (2, "z", T0 - 7 * DAY, None)]
    frame = clip_replaced(uploads(spark, rows), "zone", "id", "valid_from", "valid_until")
    got = newest_valid_at(frame, "zone", ["id"], "valid_from", "valid_until", T0 + DAY)
    assert [r.id for r in got.collect()] == [2]


def test_stored_files(spark):
    sets = spark.createDataFrame(
        [(1, 7, T0, T0, None), (2, 7, T0 + DAY, T0 + DAY, None), (3, 8, T0, None, None)],
        "id long, dropzone_id long, uploaded_at timestamp, valid_from timestamp, valid_until timestamp",
    )
    files = spark.createDataFrame(
        [(1, "a"), (2, "b"), (2, "c"), (3, "d")], "upload_id long, file string"
    )
    zones = spark.createDataFrame([(7, "bank"), (8, "other")], "id long, name string")
    got = stored_files(sets, files, zones, "bank", F.lit(T0 + 2 * DAY).cast("timestamp"))
    assert [r.file for r in got.collect()] == ["b", "c", "a"]


def test_validity(spark):
    rows = [
        (1, "always", "x", None), (2, "until_replaced", "2026-01-01T00:00", None),
        (3, "period", "2026-01-05T10:00:00Z", "2026-01-06T10:00:00+02:00"), (4, "period", "", ""),
        (5, "period", "2026-01-05T10:00", "2026-01-05T10:00"), (6, "period", "soon", None),
        (7, "sometimes", None, None), (8, "", None, None), (9, "period", "2026-01-05T10:00:00+0200", None),
        (10, "period", "2026-01-05 10:00+02", None), (11, "period", "2026-01-05T10:00Z", None),
        (12, "period", "2026-01-05", None),
    ]
    frame = spark.createDataFrame(rows, "id int, mode string, f string, u string").withColumn(
        "arrived", F.lit(T0).cast("timestamp")
    )
    got = {r.id: (r.f, r.u, r.reject_reason) for r in
           validity(frame, "mode", "arrived", "f", "u", default="always").collect()}
    assert got[1] == got[8] == (None, None, None)
    assert got[2] == got[4] == (T0, None, None)
    assert got[3] == (datetime(2026, 1, 5, 10), datetime(2026, 1, 6, 8), None)
    assert got[9] == got[10] == (datetime(2026, 1, 5, 8), None, None)
    assert got[11] == (datetime(2026, 1, 5, 10), None, None)
    assert got[12][2] == "f is not a date-time"
    assert got[5][2] == "the end is not after the start"
    assert got[6][2] == "f is not a date-time"
    assert got[7][2] == "unknown validity"


def test_checks_reject_whole_sets(spark):
    sets = spark.createDataFrame([("a",), ("b",), ("c",)], "set_id string")
    files = spark.createDataFrame(
        [("a", 1, "x", 3), ("b", 1, "x", 3), ("b", 2, "y", 0), ("b", 3, "z", 0)],
        "set_id string, n int, name string, size long",
    )
    verdicts = [check_has_files(sets, files, "set_id"),
                check_not_empty(files, "set_id", "n", "name", "size")]
    settled = settle(sets, "set_id", verdicts)
    assert {r.set_id: (r.status, r.reject_reason) for r in settled.collect()} == {
        "a": ("ok", None), "b": ("rejected", "file 'y' is empty"),
        "c": ("rejected", "the set has no files")}
    assert [r.name for r in accepted(files, settled, "set_id").collect()] == ["x"]
    assert {r.set_id: r.files for r in part_counts(files, "set_id").collect()} == {"a": 1, "b": 3}


def test_set_digest(spark):
    rows = [(s, bytes([i % 7, s])) for s in range(20) for i in range(s + 1)]
    frame = spark.createDataFrame(rows, "s int, body binary")
    expected = {}
    for s in range(20):
        digests = sorted(hashlib.sha256(b).hexdigest() for t, b in rows if t == s)
        expected[s] = hashlib.sha256("".join(digests).encode()).hexdigest()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for f in (frame, frame.orderBy(F.desc("body"))):
            assert {r.s: r.sha256 for r in set_digest(f, "s", "body").collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def spool(names):
    taken, out = set(), []
    for name in names:
        bare = name.rstrip("/").rsplit("/", 1)[-1] or "upload"
        dot = bare.rfind(".")
        stem, suffix = (bare[:dot], bare[dot:]) if 0 < dot < len(bare) - 1 else (bare, "")
        target, n = bare, 0
        while target in taken:
            n += 1
            target = f"{stem}_{n}{suffix}"
        taken.add(target)
        out.append(target)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_safe_names(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(slices, "ROWS_PER_TASK", 5)
    rng = random.Random(3)
    pool = ["x.csv", "x_1.csv", "x_2.csv", "d/x.csv", "y", "y_1", ".env", "", "a/b/", "x_1_1.csv", "q.tar.gz", "x."]
    rows, expected = [], {}
    for s in range(15):
        names = [rng.choice(pool) for _ in range(12)]
        rows += [(s, i, n) for i, n in enumerate(names)]
        expected[s] = spool(names)
    rows += [(99, i, "same.csv") for i in range(30)]
    expected[99] = spool(["same.csv"] * 30)
    got = safe_names(spark.createDataFrame(rows, "s int, n int, name string"), "s", "n", "name")
    by_set = {}
    for r in sorted(got.collect(), key=lambda r: r.n):
        by_set.setdefault(r.s, []).append(r.safe_name)
    assert by_set == expected


def test_safe_names_of_a_large_mixed_family(spark, monkeypatch):
    """Several tasks share the family, and the rounds don't grow with it."""
    monkeypatch.setattr(slices, "ROWS_PER_TASK", 400)
    rng = random.Random(12)
    rounds = []
    after_taken = uploads_operators._after_taken
    monkeypatch.setattr(uploads_operators, "_after_taken", lambda *a: rounds.append(1) or after_taken(*a))
    names = ["x.csv"] * 600 + [f"x_{rng.randrange(900)}.csv" for _ in range(200)] + ["x_7.csv"] * 100 + ["x_7_3.csv"]
    rng.shuffle(names)
    got = safe_names(spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "s int, n int, name string"), "s", "n", "name")
    assert [r.safe_name for r in sorted(got.collect(), key=lambda r: r.n)] == spool(names)
    assert len(rounds) < 20


def test_complete_sets(spark):
    parts = spark.createDataFrame(
        [("a", T0, False), ("a", T0, False), ("b", T0, False), ("b", T0, True),
         ("c", T0, False), ("d", T0 + DAY, False)],
        "set_id string, at timestamp, cut boolean",
    )
    commits = spark.createDataFrame([("a",), ("b",), ("e",)], "set_id string")
    whole, status = complete_sets(
        parts, commits, "set_id", "at", "cut",
        F.lit(T0 + DAY).cast("timestamp"), F.expr("INTERVAL 1 HOUR"),
    )
    assert {r.set_id for r in whole.collect()} == {"a"} and whole.count() == 2
    assert {r.set_id: r.status for r in status.collect()} == {
        "a": "complete", "b": "truncated", "c": "abandoned", "d": "open", "e": "empty"}


def test_reading_names_are_matched_whole(spark):
    names = spark.createDataFrame([("abc",), ("abc\n",), ("",)], "n string")
    assert [r[0] for r in names.select(F.col("n").rlike(READING_NAME)).collect()] == [True, False, False]
