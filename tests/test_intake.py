import hashlib
from datetime import datetime

import pytest

from tidemark.operators.registry import converters
from tidemark.plans.intake import MANIFEST, csv_converter, json_converter, take_in
from tidemark.sources.files import read_bodies

T0 = datetime(2026, 1, 1)


def test_take_in(spark, tmp_path):
    bodies = {"a": b"h\n1\n", "b": b"2", "empty": b"", "blank": b"\n\n"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    rows = []

    def add(set_id, *names, mode=None, until=None, committed=True, truncated=False):
        for i, name in enumerate(names):
            rows.append((set_id, "zone", name, i, f"file:{tmp_path}/{name}", T0, mode, None, until, committed, truncated))

    add("good", "a", "b")
    add("always", "b", mode="always")
    add("open", "a", committed=False)
    add("cut", "a", truncated=True)
    add("hollow", "a", "empty")
    add("nothing", "blank")
    add("odd", "a", mode="sometimes")
    add("late", "a", mode="period", until="2025-01-01T00:00")
    manifest = spark.createDataFrame(rows, MANIFEST)
    got = take_in(manifest, read_bodies(spark, str(tmp_path)), "reject_empty_files", "lines")

    hexes = sorted(hashlib.sha256(bodies[n]).hexdigest() for n in "ab")
    uploads = {r.set_id: r for r in got.uploads.collect()}
    assert set(uploads) == {"good", "always"}
    assert uploads["good"].sha256 == hashlib.sha256("".join(hexes).encode()).hexdigest()
    assert (uploads["good"].valid_from, uploads["good"].valid_until) == (T0, None)
    assert (uploads["always"].valid_from, uploads["always"].uploaded_at) == (None, T0)
    assert sorted((r.set_id, r.line) for r in got.rows.collect()) == [
        ("always", "2"), ("good", "1"), ("good", "2"), ("good", "h")]
    assert {r.set_id: r.reject_reason for r in got.rejects.collect()} == {
        "open": "not committed", "cut": "a file broke off", "hollow": "file 'empty' is empty",
        "nothing": "no files came of it", "odd": "unknown validity",
        "late": "the end is not after the start"}
    with pytest.raises(LookupError):
        take_in(manifest, read_bodies(spark, str(tmp_path)), "nothing")


def test_one_bad_file_refuses_its_set_only(spark, tmp_path):
    bodies = {
        "good.csv": b"a,b\n1,\"x, \"\"y\"\"\"\n2,\n", "type.csv": b"a,b\n1,x\nz,y\n", "more.csv": b"a,b\r\n1,x,7\r\n",
        "head.csv": b"b,a\n1,x\n", "bytes.csv": b"a,b\n1,\xff\n", "bom.csv": "\ufeffa,b\n3,é\n".encode(),
        "one.json": b'{"a": 1, "b": "x"}', "many.json": b' [{"a": 2, "b": null}, {"a": 3}]', "cut.json": b'[{"a": 4', "text.json": b'"a"',
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    converters.register()(intake_named("csv_rows", csv_converter("a int, b string")))
    converters.register()(intake_named("json_rows", json_converter("a int, b string")))

    def taken(converter, sets):
        rows = [
            (set_id, "zone", name, i, f"file:{tmp_path}/{name}", T0, None, None, None, True, False)
            for set_id, names in sets.items() for i, name in enumerate(names)
        ]
        got = take_in(spark.createDataFrame(rows, MANIFEST), read_bodies(spark, str(tmp_path)), "reject_empty_files", converter)
        assert {r.set_id for r in got.uploads.collect()} == {r.set_id for r in got.rows.select("set_id").collect()}
        return sorted((r.set_id, r.a, r.b) for r in got.rows.collect()), {r.set_id: r.reject_reason for r in got.rejects.collect()}

    assert taken("csv_rows", {"s1": ["good.csv", "bom.csv"], "s2": ["good.csv", "type.csv"], "s3": ["more.csv"], "s4": ["head.csv"], "s5": ["bytes.csv"]}) == (
        [("s1", 1, 'x, "y"'), ("s1", 2, None), ("s1", 3, "é")],
        {"s2": "line 3 of file 'type.csv' does not fit", "s3": "line 2 of file 'more.csv' does not fit",
         "s4": "the header of file 'head.csv' is not a,b", "s5": "file 'bytes.csv' is not UTF-8"})
    assert taken("json_rows", {"s1": ["one.json", "many.json"], "s2": ["one.json", "cut.json"], "s3": ["text.json"]}) == (
        [("s1", 1, "x"), ("s1", 2, None), ("s1", 3, None)],
        {"s2": "file 'cut.json' is not JSON", "s3": "file 'text.json' is not JSON"})


def intake_named(name, function):
    function.__name__ = name
    return function
