import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import NO_SESSION
from tidemark.operators.visits import (
    PathRules, distinct_sessions, page_views, parse_visits, sessions_dwell, valid_json, visits_by,
)
from tidemark.sources.files import parse_readings


def line(**fields):
    base = dict(ts="2026-03-01T10:00:00+00:00", app="dashboards", path="/dashboards/d/abc/name",
                status=200, ip="10.0.0.1", xff="", ua="agent", dashboard_session="s", admin_session="")
    return json.dumps({**base, **fields})


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_parse_visits(spark):
    lines = [
        line(), line(path="/dashboards/d-solo/xyz/p?x", xff="1.2.3.4, 5.6.7.8"),
        line(path="/admin/x", app="admin", dashboard_session="", admin_session="t"),
        line(dashboard_session="", status=""), "", '{"ts":"2026', line() + "}", line() + ',"a":1', '"text"', "17", "[1]",
        line(ts="soon"), line(status="ok"), line(ua="back\\slash\ttab"),
        '{"ua":"first","deep":[{"a":1,"a":2}],' + line(ts="2026-03-01")[1:], line(ts="2026"),
    ]
    visits, bad = parse_visits(spark.createDataFrame([(t,) for t in lines], "value string"))
    rows = visits.collect()
    assert [r.dashboard_uid for r in rows] == ["abc", "xyz", None, "abc", "abc", "abc"]
    assert [r.client_ip for r in rows] == ["10.0.0.1", "1.2.3.4", "10.0.0.1", "10.0.0.1", "10.0.0.1", "10.0.0.1"]
    assert [r.session_hash for r in rows] == [md5("s"), md5("s"), md5("t"), NO_SESSION, md5("s"), md5("s")]
    assert [r.status for r in rows] == [200, 200, 200, None, 200, 200]
    assert rows[0].visited_at == datetime(2026, 3, 1, 10)
    assert rows[4].user_agent == "back\\slash\ttab"
    # Of a key named twice the last value counts.
    assert (rows[5].visited_at, rows[5].user_agent) == (datetime(2026, 3, 1), "agent")
    assert [r.reason for r in bad.collect()] == ["not JSON"] * 3 + [
        "not an object", "not an object", "not an object", "bad ts", "bad status", "bad ts"]
    assert "cookie" not in " ".join(visits.columns) and "dashboard_session" not in visits.columns
    assert valid_json(spark.createDataFrame([(t,) for t in lines], "v string"), "v").count() == 12


def test_page_views(spark):
    rows = [("GET", "/dashboards/d/a/b"), ("GET", "/dashboards/d-solo/a/b"), ("POST", "/dashboards/d/a/b"),
            ("GET", "/dashboards/api/x"), ("GET", "/admin/static/x.css"), ("GET", "/admin/users"), ("GET", "/")]
    frame = spark.createDataFrame(rows, "method string, path string")
    got = page_views(frame, "method", "path", PathRules.standard())
    assert [(r.path, r.app) for r in got.collect()] == [
        ("/dashboards/d/a/b", "dashboards"), ("/dashboards/d-solo/a/b", "dashboards"), ("/admin/users", "admin")]


def test_sessions(spark):
    at = lambda s: datetime(2026, 1, 1, 0, 0, s)
    rows = [("s1", at(1), "a"), ("s1", at(4), "b"), ("s2", at(2), "a"), (NO_SESSION, at(3), "a"), (NO_SESSION, at(9), "a")]
    frame = spark.createDataFrame(rows, "session string, ts timestamp, uid string")
    dwell = sessions_dwell(frame, "session", "ts")
    assert {(r.session, r.ts.second): r.dwell for r in dwell.collect()} == {
        ("s1", 1): 3.0, ("s1", 4): None, ("s2", 2): None}
    for approximate in (False, True):
        got = distinct_sessions(frame, ["uid"], "session", approximate)
        assert {r.uid: r.sessions for r in got.collect()} == {"a": 2, "b": 1}
    assert {r.uid: r.visits for r in visits_by(frame, F.col("uid")).collect()} == {"a": 4, "b": 1}


def test_readings(spark):
    queries = {
        "temperature=21.5&humidity=60": ({"humidity": "60", "temperature": "21.5"}, None),
        "note=a,b": ({"note": "a,b"}, None),
        "a=1%20x+y&b=%zz&c&d==": ({"a": "1 x y", "b": "%zz", "c": "", "d": "="}, None),
        "": (None, "no parameters"),
        None: (None, "no parameters"),
        "t=1&t=2": (None, "duplicate parameter"),
        "bad-name=1": (None, "invalid parameter name"),
        "t=" + "9" * 1001: (None, "value too long"),
        "t=" + "9" * 1000: ({"t": "9" * 1000}, None),
        "&".join(f"p{i}=1" for i in range(101)): (None, "too many parameters"),
    }
    frame = spark.createDataFrame([(q,) for q in queries], "q string")
    for r in parse_readings(frame, "q").collect():
        assert (r.readings, r.reject_reason) == queries[r.q], r.q
        assert r.names == (sorted(r.readings) if r.readings else None)
