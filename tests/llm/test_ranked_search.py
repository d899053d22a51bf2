"""Ranks against a plain count of all documents, with blocks and turns of any size."""

import math
import random
import re
from collections import Counter

import pytest

from tidemark.llm import ranked_search
from tidemark.llm.common import LOWER, UPPER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def plain(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    for item, text, *_ in items:
        scores = []
        for i, c in counted:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if c[t]
            )
            if score:
                scores.append((-score, i is not None, i))
        for rank, (score, _, i) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, i, -score


def made(rng, n):
    words = [w + x for w in ("the", "Ab", "ñu", "x1", "Été") for x in ("", "a", "b", "A")]
    weights = [1 / (1 + i) for i in range(len(words))]
    return [(i, rng.choice(" .\n-").join(rng.choices(words, weights, k=rng.choice([1, 2, 5, 5, 5, 30, 200]))), "s") for i in range(n)]


def found(spark, docs, items, k, **options):
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, Term string")
    asked = spark.createDataFrame(items, "item_id bigint, text string, block string")
    block = options.pop("block", ranked_search.BLOCK)
    index = ranked_search.build_index(documents, ranked_search.index_folder(spark), block=block)
    rows = ranked_search.search(spark, index, asked, k, **options)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block": 3, "first": 7}, {"block": 1, "first": 1, "pairs_at_once": 20}])
def test_agrees_with_a_plain_count(spark, options):
    rng = random.Random(6)
    docs, items = made(rng, 300), [(i, t, s) for i, t, s in made(rng, 12)]
    copies = [(1_000 + i, "The the ab a copy of many", "s") for i in range(40)]
    odd = [(-1, None, "s"), (-2, "", "s"), (-3, " .,- ", "s"), (7, "the ab", "s"), (7, "the ab", "s"), (None, "the ab été", "s"), (-4, "ab " * 30_000, "s")]
    items += [(50, "copy many COPY", "s"), (51, None, "s"), (52, "?", "s"), (53, "nowhere", "s"), (None, "the ab", "s"), (54, "ab the ab", "s"), (54, "x1", "s")]
    docs += copies + odd
    assert found(spark, docs, items, 10, **options) == sorted(plain(docs, items, 10), key=repr)


def test_empty_tables(spark):
    docs, items = [(1, "a b", "s")], [(1, "a", "s")]
    assert found(spark, docs, [], 5) == [] and found(spark, [], items, 5) == []
    # A term that all documents have may weigh nothing, and its documents then score 0.
    assert found(spark, docs, items, 5) == sorted(plain(docs, items, 5))


def test_blocks_that_cannot_matter_are_not_visited(spark):
    """Short documents with the rare term fill the first ranks, and long ones without it are left out."""
    docs = [(i, "rare one", "s") for i in range(20)] + [(100 + i, "one " + "long " * (50 + i), "s") for i in range(200)]
    asked = [(1, "rare one", "s")]
    seen = []
    scored = ranked_search._scored

    def counting(rows, *rest):
        seen.append(rows.select("block").distinct().count())
        return scored(rows, *rest)

    ranked_search._scored = counting
    try:
        assert found(spark, docs, asked, 10, block=4, first=10) == sorted(plain(docs, asked, 10), key=repr)
    finally:
        ranked_search._scored = scored
    # 5 blocks of 4 hold the short ones; 200 lengths make 200 strata or nearly so.
    assert sum(seen) <= 8
