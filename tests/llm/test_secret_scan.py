"""Spans and redacted texts against a plain search, with odd rows and very many spans."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import secret_scan

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")


def entropy(text):
    return sum(-n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def random_looking(word):
    if re.fullmatch(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", word) or re.fullmatch(r"[0-9+/_-]+", word):
        return False
    if len(word.rstrip("=")) < 20 or "example" in word.lower():
        return False
    least = 3.01 if re.fullmatch("[0-9a-fA-F]+", word) else 4.11 if re.fullmatch("[A-Za-z/_-]+=*", word) else 3.61
    return max(entropy(word[i : i + 20]) for i in range(len(word) - 19)) > least


def plain(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if random_looking(m[0])])


def plain_redacted(text):
    out, at = [], 0
    for start, _, end in plain(text):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, end)
    return text if text is None else "".join(out) + text[at:]


def made(rng, n):
    key = lambda k, chars: "".join(rng.choices(chars, k=k))
    parts = [
        lambda: 'Password = "' + key(rng.randint(5, 20), "abcXYZ019+/_.=-"), lambda: "AKIA" + key(rng.randint(10, 20), "ABC019"),
        lambda: key(rng.randint(8, 40), "0123456789abcdef"), lambda: key(rng.randint(15, 60), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/") + "==",
        lambda: "é😀 words and words ", lambda: "token:'", lambda: " secret: api_key=", lambda: "", lambda: "123e4567-e89b-12d3-a456-426614174000",
    ]
    return [rng.choice([" ", "\n", ""]).join(rng.choice(parts)() for _ in range(rng.randrange(12))) for _ in range(n)]


def found(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, Spans string")
    spans = secret_scan.scan(rows).collect()
    clean = rows.withColumn("s", secret_scan.secret_spans(F.col("text"))).withColumn("clean", secret_scan.redacted(F.col("text"), F.col("s")))
    return {r.doc_id: [tuple(s) for s in r.spans] for r in spans}, {r.doc_id: r.clean for r in clean.collect()}


@pytest.mark.parametrize("chunk,text_chunk", [(128, 4096), (2, 5), (3, 1)])
def test_agrees_with_a_plain_search(spark, monkeypatch, chunk, text_chunk):
    monkeypatch.setattr(secret_scan, "CHUNK", chunk)
    monkeypatch.setattr(secret_scan, "TEXT_CHUNK", text_chunk)
    texts = [None, "", " ", "x", "token=", "a" * 10_000, *made(random.Random(8), 150)]
    texts += texts[-3:]
    spans, clean = found(spark, texts)
    for i, t in enumerate(texts):
        assert spans[i] == plain(t), t
        assert clean[i] == plain_redacted(t), t


def test_empty_table(spark):
    assert secret_scan.scan(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_very_many_spans(spark):
    """The work follows the text; with the square of its spans this would take minutes."""
    rng = random.Random(9)
    texts = ["\n".join("".join(rng.choices("0123456789abcdef", k=16)) for _ in range(n)) for n in (100, 64_000)]
    found(spark, texts[:1])
    began = time.time()
    spans, clean = found(spark, texts[1:])
    assert time.time() - began < 60
    assert spans[0] == plain(texts[1]) and clean[0] == plain_redacted(texts[1])
