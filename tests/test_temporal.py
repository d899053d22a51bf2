import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.histories import (
    COMPONENTS,
    COMPONENTS_SCHEMA,
    ISSUES,
    ISSUES_SCHEMA,
    JOINED,
    replay,
)
from tidemark.operators import temporal
from tidemark.operators.temporal import changes_only, periods, temporal_join, temporal_join_theta
from tidemark.session import written

ON = [("component_key", "component_key")]


def golden(spark):
    return (
        spark.createDataFrame(ISSUES, ISSUES_SCHEMA),
        spark.createDataFrame(COMPONENTS, COMPONENTS_SCHEMA),
    )


def flat(frame):
    return sorted(
        tuple(r)
        for r in frame.select(
            "issue_key", "ts", "lhs.status", "lhs.story_points", "lhs.component_key",
            "rhs.safety_class", "rhs.owner_team",
        ).collect()
    )


def test_golden_rows(spark):
    left, right = golden(spark)
    got = temporal_join(left, right, "changed_at", "changed_at", "issue_key", ON)
    assert got.columns == ["issue_key", "ts", "lhs", "rhs"]
    assert flat(got) == JOINED


def test_golden_rows_when_every_key_is_cut(spark):
    left, right = golden(spark)
    got = temporal_join(left, right, "changed_at", "changed_at", "issue_key", ON, rows_per_task=1)
    assert flat(got) == JOINED


def test_golden_rows_of_the_theta_form(spark):
    left, right = golden(spark)
    got = temporal_join_theta(
        left, right, "changed_at", "changed_at", "issue_key", ON, lambda l, r: F.lit(True), []
    )
    assert flat(got) == JOINED


def history(rng, keys, links, days):
    start = date(2026, 1, 1)
    pick = lambda n: rng.sample(range(days), min(n, days))
    lefts = [
        (k, start + timedelta(d), rng.choice("ab"), rng.choice([None, *links]))
        for k in keys for d in pick(rng.randint(1, 9))
    ]
    rights = [
        (k, start + timedelta(d), rng.choice(["x", "y", None]), rng.randint(0, 2))
        for k in links for d in pick(rng.randint(0, 9))
    ]
    return lefts, rights


@pytest.mark.parametrize("rows_per_task,block", [(None, 64), (2, 2), (None, 1)])
def test_equals_replay(spark, monkeypatch, rows_per_task, block):
    monkeypatch.setattr(temporal, "NEWS_PER_BLOCK", block)
    rng = random.Random(7)
    all_left, all_right, expected = [], [], []
    for n in range(12):
        lefts, rights = history(rng, [f"i{n}a", f"i{n}b"], [f"c{n}a", f"c{n}b", f"c{n}c"], 14)
        all_left += lefts
        all_right += rights
        expected += replay(lefts, rights, lambda l, r: l[3] == r[0])
    left = spark.createDataFrame(all_left, "item string, at date, v string, link string")
    right = spark.createDataFrame(all_right, "comp string, on_day date, cls string, n int")
    got = temporal_join(
        left, right, "at", "on_day", "item", [("link", "comp")], rows_per_task=rows_per_task
    )
    rows = sorted(
        ((r[0], r[1], tuple(r.lhs), r.rhs and tuple(r.rhs)) for r in got.collect()),
        key=lambda r: r[:2],
    )
    assert rows == sorted(expected, key=lambda r: r[:2])


def test_a_change_at_the_end_of_time_counts(spark):
    left = spark.sql("SELECT 'i' AS item, timestamp'2020-01-01' AS at, 'c' AS link")
    right = spark.range(65).selectExpr(
        "'c' AS comp",
        "if(id = 64, timestamp'9999-12-31 23:59:59', timestamp'2021-01-01' + make_dt_interval(int(id))) AS at",
        "id AS n",
    )
    got = temporal_join(left, right, "at", "at", "item", [("link", "comp")])
    assert got.count() == 66 and got.where("rhs.n = 64").count() == 1


def test_a_hot_link_meets_only_what_it_needs(spark):
    holding = spark.range(200).selectExpr("id AS item", "'hot' AS _link0", "id * 100 AS _after", "id * 100 + 99 AS _upto").union(
        spark.range(2000).selectExpr("id + 1000", "string(id) AS _link0", "0L", "1L")
    )
    news = spark.range(20_000).selectExpr("'hot' AS _link0", "id AS ts", "id + 1 AS _n").union(
        spark.range(2000).selectExpr("string(id)", "5L", "1L")
    )
    met = temporal._meet(holding, news, ["_link0"])
    assert met.count() == 200 * 99 + 2000
    # A row meets whole blocks. All pairs would be 4,002,000.
    joined = temporal._each_block(
        holding, temporal._block_of(F.col("_after") + 1), temporal._block_of(F.col("_upto"))
    ).count() * temporal.NEWS_PER_BLOCK
    assert joined <= 200 * (99 + 2 * temporal.NEWS_PER_BLOCK) + 2000 * temporal.NEWS_PER_BLOCK


def test_theta_meets_only_the_time_of_a_value(spark, monkeypatch):
    """40 values, each held for a fortieth of a hot link's time: not all pairs of value and right row."""
    met = []
    each_block = temporal._each_block
    monkeypatch.setattr(temporal, "_each_block", lambda *a: met.append(each_block(*a)) or met[-1])
    left = spark.range(40).selectExpr("id AS item", "id * 1000 AS at", "'c' AS link", "id AS least").union(
        # Given up again at the next value's time.
        spark.range(40).selectExpr("id", "(id + 1) * 1000", "NULL", "id")
    )
    right = spark.range(40_000).selectExpr("'c' AS comp", "id AS at", "id % 50 AS n")
    got = temporal_join_theta(
        left, right, "at", "at", "item", [("link", "comp")], lambda l, r: r("n") >= l("least"), ["least"]
    )
    rows = got.collect()
    # The right row at or just before each start, and then each matching row in the 999 after it.
    assert len(rows) == sum(2 + sum(t % 50 >= i for t in range(i * 1000 + 1, (i + 1) * 1000)) for i in range(40))
    for_items = [r for r in rows if r.ts == r.item * 1000]
    assert {r["item"]: r.rhs and r.rhs["at"] for r in for_items} == {
        i: next((t for t in range(i * 1000, -1, -1) if t % 50 >= i), None) for i in range(40)}
    theta = met[:-1]  # the last is the join of the histories
    # All pairs would be 1,600,000.
    assert sum(m.count() for m in theta) * temporal.NEWS_PER_BLOCK <= 40 * (1000 + 6 * temporal.NEWS_PER_BLOCK)


@pytest.mark.parametrize("block,rows_per_task", [(2, None), (1, 3), (3, 2)])
def test_theta_looks_back_as_far_as_needed(spark, monkeypatch, block, rows_per_task):
    monkeypatch.setattr(temporal, "NEWS_PER_BLOCK", block)
    rng = random.Random(13)
    start = date(2026, 1, 1)
    lefts = [(f"i{n}", start + timedelta(d), rng.choice("ab"), rng.choice([None, "c", "c"])) for n in range(8) for d in rng.sample(range(60), 4)]
    rights = [("c", start + timedelta(d), rng.choice(["x", "y"]), int(rng.random() < 0.1)) for d in range(60)]
    level = {"a": 0, "b": 1}
    expected = replay(lefts, rights, lambda l, r: l[3] == r[0] and r[3] >= level[l[2]])
    got = temporal_join_theta(
        spark.createDataFrame(lefts, "item string, at date, v string, link string"),
        spark.createDataFrame(rights, "comp string, on_day date, cls string, n int"),
        "at", "on_day", "item", [("link", "comp")], lambda l, r: r("n") >= F.when(l("v") == "b", 1).otherwise(0), ["v"],
        rows_per_task=rows_per_task,
    )
    rows = ((r[0], r[1], tuple(r.lhs), r.rhs and tuple(r.rhs)) for r in got.collect())
    assert sorted(rows, key=lambda r: r[:2]) == sorted(expected, key=lambda r: r[:2])


def test_theta_equals_replay(spark):
    rng = random.Random(11)
    all_left, all_right, expected = [], [], []
    level = {"a": 0, "b": 1}
    match = lambda l, r: l[3] == r[0] and r[3] >= level[l[2]]
    for n in range(10):
        lefts, rights = history(rng, [f"i{n}a", f"i{n}b"], [f"c{n}a", f"c{n}b"], 14)
        all_left += lefts
        all_right += rights
        expected += replay(lefts, rights, match)
    left = spark.createDataFrame(all_left, "item string, at date, v string, link string")
    right = spark.createDataFrame(all_right, "comp string, on_day date, cls string, n int")
    got = temporal_join_theta(
        left, right, "at", "on_day", "item", [("link", "comp")],
        lambda l, r: r("n") >= F.when(l("v") == "b", 1).otherwise(0), ["v"],
    )
    rows = sorted(
        ((r[0], r[1], tuple(r.lhs), r.rhs and tuple(r.rhs)) for r in got.collect()),
        key=lambda r: r[:2],
    )
    assert rows == sorted(expected, key=lambda r: r[:2])


def test_arguments_are_checked(spark):
    left, right = golden(spark)
    join = lambda **k: temporal_join(
        **{**dict(left=left, right=right, left_ts="changed_at", right_ts="changed_at",
                  key="issue_key", on=ON), **k}
    )
    with pytest.raises(ValueError, match="left has no column"):
        join(key="nothing")
    with pytest.raises(ValueError, match="right has no column"):
        join(on=[("component_key", "nothing")])
    with pytest.raises(ValueError, match="at least one"):
        join(on=[])
    with pytest.raises(ValueError, match="differ in type"):
        join(right=right.withColumn("changed_at", F.col("changed_at").cast("timestamp")))


@pytest.mark.parametrize("hot", [False, True])
def test_periods_and_changes(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr("tidemark.operators.slices.ROWS_PER_TASK", 1)
    rows = [("a", date(2026, 1, 1), 1), ("a", date(2026, 1, 5), 1), ("a", date(2026, 1, 6), 2),
            ("a", date(2026, 1, 9), 1), ("b", date(2026, 1, 3), 1)]
    frame = spark.createDataFrame(rows, "k string, d date, v int")
    kept = changes_only(frame, "k", "d", ["v"])
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2], rows[3], rows[4]]
    got = periods(kept, "k", "d", F.lit(date(2026, 1, 10)))
    assert sorted((r.k, r.d.day, r.valid_to and r.valid_to.day, r.days) for r in got.collect()) == [
        ("a", 1, 6, 5), ("a", 6, 9, 3), ("a", 9, None, 1), ("b", 3, None, 7)]


def broadcasts(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_histories_are_not_sent_through_the_driver(spark):
    # The files are far smaller than the limit below which Spark would broadcast what they hold.
    left, right = (written(frame, "history") for frame in golden(spark))
    got = temporal_join(left, right, "changed_at", "changed_at", "issue_key", ON)
    assert broadcasts(got) == 0
    assert flat(got) == JOINED


def test_matching_does_not_send_histories_through_the_driver(spark, monkeypatch):
    planned = []

    def noted(frame, name):
        planned.append(frame._jdf.queryExecution().executedPlan().toString())
        return written(frame, name)

    monkeypatch.setattr(temporal, "written", noted)
    left, right = (written(frame, "history") for frame in golden(spark))
    meets = lambda l, r: (l("status") != "Done") | (r("safety_class") == "C")
    got = temporal_join_theta(left, right, "changed_at", "changed_at", "issue_key", ON, meets, ["status"])
    assert broadcasts(got) == 0
    assert len(planned) >= 4 and not any("Broadcast" in plan for plan in planned)
