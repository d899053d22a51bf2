"""Removed bytes against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries, repeats
from tidemark.llm.common import table


def replay(rows, length):
    seen = Counter()
    for _, t in rows:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_query_agrees_with_all_windows(spark, sf_dir):
    rows = [(r.doc_id, (r.text or "").encode()) for r in table(spark, sf_dir, "documents").collect()]
    found = queries.QUERIES["op2_repeated_strings"](spark, sf_dir).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(replay(rows, 400))
    assert all(r.has_repeats == (r.n_removed > 0) for r in found)


@pytest.mark.parametrize("most", [1000, 5, 1])
def test_odd_rows(spark, most):
    rng = random.Random(5)
    line = "".join(rng.choices("abcü ", k=150))
    rows = [(i, "".join(rng.choices("abc ", k=rng.randrange(80))) + line[rng.randrange(40) :] + "".join(rng.choices("abc ", k=60))) for i in range(30)]
    rows += [(100, "a" * 500), (101, line), (101, line), (None, line + "x"), (102, None), (102, ""), (103, "a" * 99), (104, "ab" * 80)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, Content string")
    found = repeats.without_repeats(docs, length=100, most=most).collect()
    got = [
        (-1 if r.doc_id is None else r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
        for r in found
    ]
    assert sorted(got) == sorted(replay([(-1 if i is None else i, (t or "").encode()) for i, t in rows], 100))
    assert repeats.without_repeats(docs.limit(0)).collect() == []


def test_blind_trie_sorts():
    rng = random.Random(2)
    words = [bytes(rng.choices(b"ab", k=12)) for _ in range(500)]
    trie = repeats.BlindTrie(words[0], 0)
    for i, w in enumerate(words[1:], 1):
        trie.add(w, i)
    assert [(w, n) for w, n in trie.leaves()] == [(w, [i for i, x in enumerate(words) if x == w]) for w in sorted(set(words))]
