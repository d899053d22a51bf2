"""Groups and kept rows against a plain dictionary, on a filter of any size."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup
from tidemark.llm.common import LOWER, UPPER

ODD = [
    (1, "Same text", "a"), (2, "same TEXT", "b"), (2, "same TEXT", "c"), (3, "sÑme", "a"), (4, "sñme", "a"), (5, None, "a"), (6, "", None),
    (None, "", "z"), (None, "alone with no id", "z"), (7, "x" * 300_000, "a"), (8, "X" * 300_000, "a"), (9, " same text", "a"), (10, "\x00", "a"),
]


def own(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def plain(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[own(t)].append(i)
    for i, t, *_ in rows:
        group = groups[own(t)]
        keep = max((x for x in group if x is not None), default=None)
        yield i, keep, len(group), i == keep, hashlib.sha256(own(t).encode()).hexdigest()


def made(rng):
    words = ["ab", "AB", "Ab", "c", "ñ", "Ñ", ""]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(4))), "s") for i in range(400)]


@pytest.mark.parametrize("most", [exact_dedup.MOST_WORDS, 2, 1])
def test_groups(spark, most):
    """With a filter of one word nearly every row is thought to be repeated."""
    rows = ODD + [(i + 100, t, s) for i, t, s in made(random.Random(3))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Word string")
    found = exact_dedup.exact_groups(docs, most_words=most)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("most", [exact_dedup.MOST_WORDS, 1])
def test_kept_rows(spark, most):
    rows = ODD + [(i + 100, t, s) for i, t, s in made(random.Random(4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `H` string").withColumn("row", F.lit(1))
    found = exact_dedup.deduplicated(docs, most_words=most)
    assert found.schema.names == docs.schema.names
    got = [(r.doc_id, r.text) for r in found.collect()]
    assert sorted(got, key=repr) == sorted({(i, t) for (i, t, _), p in zip(rows, plain(rows)) if p[3]}, key=repr)


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "X"), (None, "y")], "doc_id string, text string")
    assert sorted((r.doc_id or "", r.keep_id) for r in exact_dedup.exact_groups(docs).collect()) == [("", None), ("a", "b"), ("b", "b")]
    none = docs.limit(0)
    assert exact_dedup.exact_groups(none).collect() == [] and exact_dedup.deduplicated(none).collect() == []


def test_only_patterns_met_twice_are_set(spark):
    words = 1 << 10
    hashes = spark.range(2_000).select(F.xxhash64("id").alias("h"))
    assert exact_dedup.repeated_filter(hashes.where("true"), words).count() == 0
    again = hashes.unionAll(hashes.limit(50))
    found = exact_dedup.repeated_filter(again, words)
    marked = exact_dedup._marked(hashes, found, words, "h", "maybe")
    assert 50 <= marked.where("maybe").count() < 70
