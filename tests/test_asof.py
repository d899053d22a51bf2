import itertools
import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import slices
from tidemark.operators.asof import asof_join

T0 = datetime(2026, 1, 1)


def tables(spark):
    rng = random.Random(21)
    minute = lambda m: T0 + timedelta(minutes=m)
    rights = [(k, minute(m), i) for k in "ab" for i, m in enumerate(rng.sample(range(60), 25))]
    lefts = [(i, rng.choice(["a", "a", "b", "c", None]), minute(rng.randint(0, 60))) for i in range(120)]
    lefts.append((200, "a", None))
    return (
        lefts, rights,
        spark.createDataFrame(lefts, "id int, k string, at timestamp"),
        spark.createDataFrame(rights, "key string, since timestamp, v int"),
    )


def expected(lefts, rights, strict, forward, how):
    out = {}
    for i, k, at in lefts:
        hits = [r for r in rights if r[0] == k and at is not None]
        if forward:
            hits = [r for r in hits if r[1] > at or (r[1] == at and not strict)]
        else:
            hits = [r for r in hits if r[1] < at or (r[1] == at and not strict)]
        best = (min if forward else max)(hits, key=lambda r: r[1]) if hits else None
        if best or how == "left":
            out[i] = (k, at, best and best[1], best and best[2])
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_asof_equals_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(slices, "ROWS_PER_TASK", 10)
    lefts, rights, left, right = tables(spark)
    one_each = left.dropDuplicates(["k", "at"])
    kept = {r.id for r in one_each.collect()}
    for strict, forward, how in itertools.product([False, True], [False, True], ["left", "inner"]):
        args = dict(how=how, prefix="r_", strict=strict, forward=forward)
        want = expected(lefts, rights, strict, forward, how)
        got = asof_join(left, right, "at", "since", [("k", "key")], **args)
        assert got.columns == ["id", "k", "at", "r_since", "r_v"]
        assert {r.id: tuple(r)[1:] for r in got.collect()} == want
        unique = asof_join(one_each, right, "at", "since", [("k", "key")], unique_left=True, **args)
        found = {r.id: tuple(r)[1:] for r in unique.collect()}
        assert found == {i: v for i, v in want.items() if i in kept}


def test_arguments(spark):
    _, _, left, right = tables(spark)
    with pytest.raises(ValueError, match="prefix"):
        asof_join(left, right.withColumnRenamed("v", "id"), "at", "since", [("k", "key")])
    with pytest.raises(ValueError, match="how"):
        asof_join(left, right, "at", "since", [("k", "key")], how="outer")
