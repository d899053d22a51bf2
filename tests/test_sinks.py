import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.registry import Registry
from tidemark.operators.sync import apply_changes, reconcile
from tidemark.sinks import versions
from tidemark.sinks.tables import (
    append_snapshot, compact_registry, convert, refresh, registered, registry, rows_of_sets, store_set, upsert_partitions,
)
from tidemark.sources.files import read_bodies, read_json
from tidemark.operators.uploads import set_digest


def test_json_object_and_array(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": 2}')
    (tmp_path / "many.json").write_text('[{"a": 1, "b": 2}, {"a": 3, "b": 4}]')
    assert sorted(map(tuple, read_json(spark, str(tmp_path), "a int, b int").collect())) == [(1, 2), (1, 2), (3, 4)]
    out = convert(spark, str(tmp_path), "json", "a int, b int", str(tmp_path / "out"))
    assert {r.stem: r["count"] for r in out.groupBy("stem").count().collect()} == {"one": 1, "many": 2}


def test_csv_conversion_names_by_stem(spark, tmp_path):
    for name in ("numbers.csv", "more.v2.csv", ".env"):
        (tmp_path / name).write_text("a,b\n1,2\n")
    out = convert(spark, [str(tmp_path / "numbers.csv"), str(tmp_path / "more.v2.csv")], "csv", "a int, b int", str(tmp_path / "out"))
    assert sorted(r.stem for r in out.collect()) == ["more.v2", "numbers"]
    assert [(r.a, r.b) for r in out.where("stem = 'numbers'").collect()] == [(1, 2)]


def test_bodies_and_digest(spark, tmp_path):
    for s, name, body in (("s1", "a", b"x"), ("s1", "b", b"y"), ("s2", "c", b"y"), ("s2", "d", b"x"), ("s3", "e", b"z")):
        (tmp_path / s).mkdir(exist_ok=True)
        (tmp_path / s / name).write_bytes(body)
    bodies = read_bodies(spark, str(tmp_path)).withColumn("set_id", F.regexp_extract("path", "/(s[0-9])/", 1))
    got = {r.set_id: r.sha256 for r in set_digest(bodies, "set_id", "content").collect()}
    assert got["s1"] == got["s2"] != got["s3"]


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, v string, p int"
    upsert_partitions(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema), path, ["k"], "p")
    before = {f.name for f in (tmp_path / "t" / "p=1").iterdir()}
    for _ in range(2):
        upsert_partitions(spark.createDataFrame([(2, "c", 2), (3, "d", 3)], schema), path, ["k"], "p")
    got = spark.read.parquet(path)
    assert sorted((r.k, r.v, r.p) for r in got.collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]
    assert {f.name for f in (tmp_path / "t" / "p=1").iterdir()} == before


def test_unregistered_sets_are_invisible(spark, tmp_path):
    data, known = str(tmp_path / "d"), str(tmp_path / "r")
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "set_id string, v int")
    store_set(rows.where("set_id = 'a'").select("set_id"), rows.where("set_id = 'a'"), "set_id", data, known)
    # A job that died before it registered its set.
    versions.write_rows(rows.where("set_id = 'b'").withColumn("bucket", F.lit(1)), data, ["bucket"])
    assert [r.v for r in registered(spark, "set_id", data, known).collect()] == [1]
    store_set(rows.select("set_id"), rows, "set_id", data, known)
    assert sorted(r.v for r in registered(spark, "set_id", data, known).collect()) == [1, 2]
    # Storing a set again replaces its rows.
    again = spark.createDataFrame([("a", 7), ("a", 8)], "set_id string, v int")
    store_set(again.select("set_id").distinct(), again, "set_id", data, known)
    for _ in range(2):
        assert sorted(r.v for r in registered(spark, "set_id", data, known).collect()) == [2, 7, 8]
        compact_registry(spark, "set_id", known)


def test_only_buckets_of_chosen_sets_are_read(spark, tmp_path):
    data, known = str(tmp_path / "d"), str(tmp_path / "r")
    rows = spark.range(1000).selectExpr("concat('s', id % 200) AS set_id", "id AS v")
    store_set(rows.select("set_id").distinct(), rows, "set_id", data, known, buckets=8)
    # A folder per bucket, not per set.
    (folder,) = (tmp_path / "d/data").iterdir()
    assert sum(f.is_dir() for f in folder.iterdir()) == 8
    chosen = registry(spark, "set_id", known).where("set_id IN ('s1', 's2')")
    got = rows_of_sets(spark, chosen, "set_id", data)
    assert sorted(r.v for r in got.collect()) == sorted([*range(1, 1000, 200), *range(2, 1000, 200)])
    # The scan is given the buckets, at most two of eight.
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters")[1].split("]")[0] for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("bucket#" in f for f in filters)
    with pytest.raises(ValueError, match="no set"):
        rows_of_sets(spark, chosen.limit(0), "set_id", data)


def test_a_table_changes_all_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version"):
        versions.read_version(spark, path)
    first = refresh(spark.range(3).withColumn("p", F.col("id") % 2), path, ["p"])
    assert sorted(map(tuple, first.collect())) == [(0, 0), (1, 1), (2, 0)]

    # The job dies after it has written its rows and before the switch.
    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "_renamed", dies)
        with pytest.raises(RuntimeError, match="lost"):
            refresh(spark.range(100), path)
    assert sorted(r.id for r in versions.read_version(spark, path).collect()) == [0, 1, 2]

    refresh(spark.range(10, 12), path)
    # Who read the first version goes on reading it.
    assert first.count() == 3 and versions.read_version(spark, path, 1).count() == 3
    versions.add_version(spark, path, versions.write_rows(spark.range(12, 14), path), replaces=False)
    assert sorted(r.id for r in versions.read_version(spark, path).collect()) == [10, 11, 12, 13]
    versions.forget(spark, path)
    assert [e.version for e in versions.history(spark, path)] == [2, 3]
    assert sorted(r.id for r in versions.read_version(spark, path).collect()) == [10, 11, 12, 13]
    with pytest.raises(ValueError, match="no version 1"):
        versions.read_version(spark, path, 1)


def test_two_writers_take_different_versions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    refresh(spark.range(1), path)
    mine = versions.write_rows(spark.range(5), path)
    newest = versions._newest

    # Another writer takes the next number after this one has looked.
    def beaten(*where):
        seen = newest(*where)
        monkeypatch.setattr(versions, "_newest", newest)
        versions.add_version(spark, path, versions.write_rows(spark.range(7), path))
        return seen

    monkeypatch.setattr(versions, "_newest", beaten)
    assert versions.add_version(spark, path, mine) == 3
    assert [e.version for e in versions.history(spark, path)] == [1, 2, 3]
    assert versions.read_version(spark, path).count() == 5 and versions.read_version(spark, path, 2).count() == 7


def test_snapshots_append(spark, tmp_path):
    for hour in (1, 2):
        append_snapshot(spark.range(3), str(tmp_path / "s"), F.lit(datetime(2026, 1, 1, hour)).cast("timestamp"))
    got = spark.read.parquet(str(tmp_path / "s"))
    assert got.count() == 6 and got.select("sampled_at").distinct().count() == 2


def test_reconcile(spark):
    schema = "k int, v string"
    mirror = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], schema)
    source = spark.createDataFrame([(2, "b"), (3, None), (4, "x"), (5, None)], schema)
    changes = reconcile(mirror, source, ["k"])
    assert {r.k: (r.v, r.change) for r in changes.collect()} == {
        1: ("a", "delete"), 2: ("b", "same"), 3: (None, "same"), 4: ("x", "update"), 5: (None, "insert")}
    assert sorted(map(str, apply_changes(changes).collect())) == sorted(map(str, source.collect()))


def test_registry(spark):
    registry = Registry("checker")

    @registry.register("Drop b")
    def keep_a(frame):
        return frame.where("v <> 'b'")

    assert registry.register("Drop b")(keep_a) is keep_a
    with pytest.raises(ValueError):
        def other(frame):
            return frame
        other.__name__ = "keep_a"
        registry.register()(other)
    with pytest.raises(LookupError):
        registry.get("nothing")
    assert registry.names() == ["keep_a"] and registry.choices() == [("keep_a", "Drop b")]
    assert registry.get("keep_a")(spark.createDataFrame([("a",), ("b",)], "v string")).count() == 1


def test_upsert_keeps_the_rows_without_a_partition(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k int, v string, p int"
    upsert_partitions(spark.createDataFrame([(1, "a", 1), (2, "b", None), (5, "e", None)], schema), path, ["k"], "p")
    upsert_partitions(spark.createDataFrame([(3, "c", None), (5, "f", None)], schema), path, ["k"], "p")
    rows = spark.read.schema(schema).parquet(path).collect()
    assert {tuple(r) for r in rows} == {(1, "a", 1), (2, "b", None), (3, "c", None), (5, "f", None)}
    assert [f.name for f in tmp_path.iterdir()] == ["t"]


def test_upsert_refuses_a_repeated_key(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", 1), (1, "b", 1)], "k int, v string, p int")
    with pytest.raises(ValueError):
        upsert_partitions(frame, f"{tmp_path}/t", ["k"], "p")
