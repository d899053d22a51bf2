"""Weighted sampling against exact similarities, models on held-out rows, and odd inputs."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, quality, queries, weighted_sampling
from tidemark.llm.common import may_train, table

ODD = "doc_id bigint, text string, lang string, Score2 string"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_edits_agree_with_a_replay(spark, sf_dir):
    rows = sorted(table(spark, sf_dir, "documents").select("doc_id", "text").collect(), reverse=True)
    found = {r.doc_id: r for r in queries.QUERIES["op7_document_fingerprints"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    sampler = weighted_sampling.Sampler()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints = [sampler.fingerprint(t) for t in (text, edited, after)]
        assert r.fingerprint == prints[0].astype(">u2").tobytes().hex()
        assert r.edited_fingerprint == prints[1].astype(">u2").tobytes().hex()
        assert r.near_edited == (prints[0] == prints[1]).mean() and r.near_next == (prints[0] == prints[2]).mean()


def test_likeness_is_the_generalised_jaccard_similarity():
    rng = np.random.default_rng(1)
    sampler = weighted_sampling.Sampler(4096)
    for _ in range(5):
        a, b = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
        text = lambda w: " ".join(f"w{i}" for i, n in enumerate(w) for _ in range(n))
        likeness = weighted_sampling.likeness(sampler.fingerprint(text(a)), sampler.fingerprint(text(b)))
        assert likeness == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_edits_of_odd_rows(spark):
    rows = [(3, None), (3, None), (None, "z"), (2, ""), (1, "a b c d e f"), (1, "a b c d e f")]
    found = weighted_sampling.edits(spark.createDataFrame([(*r, None, "x") for r in rows], ODD)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.edited_text) for r in found) == [
        (False, 1, "a b c d a b"), (False, 1, "a b c d z"), (False, 2, ""), (False, 3, ""), (False, 3, ""), (True, None, "z")
    ]
    assert weighted_sampling.edits(spark.createDataFrame([], ODD)).collect() == []


def test_quality_of_held_out_rows(spark, sf_dir):
    marked = {r.doc_id: r.quality for r in table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels").collect()}
    found = queries.QUERIES["op5_quality_classifier"](spark, sf_dir.replace("sf0.001", "sf0.01")).collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    right = [r.predicted == marked[r.doc_id] for r in found if r.held_out and r.doc_id in marked]
    assert len(right) > 50 and np.mean(right) > 0.9


def test_quality_looks_at_every_place():
    tables = np.zeros((quality.WIDTH, 256, quality.FILTERS), np.float32)
    tables[0, ord("#")] = 1
    network = quality.Network(tables, np.zeros(quality.FILTERS, np.float32), np.ones(2 * quality.FILTERS, np.float32), -1.0)
    plain = quality.probability(network, "a" * 100_000)
    for at in (0, 510, 511, 512, quality.BLOCK - 1, quality.BLOCK, 99_000):
        assert quality.probability(network, "a" * at + "#" + "a" * (100_000 - at)) > plain


def test_odd_rows_get_scores(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "", "en", None), (2, "ab " * 200_000, "en", "")], ODD)
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id bigint, quality int")
    network = quality.train(docs, labels, may_train(F.col("doc_id")))
    assert quality.score(docs, network).count() == 4
    model = language_id.train(docs, may_train(F.col("doc_id")))
    assert quality.score(docs.limit(0), network).collect() == []
    for model in (model, language_id.fit([], [])):
        found = language_id.predict(docs, model).collect()
        assert [r.lang_pred for r in found if not r.text] == ["und"] * 3
    with pytest.raises(ValueError):
        language_id.predict(docs.withColumnRenamed("Score2", "SCORE"), model)


def test_language_of_held_out_rows(spark, sf_dir):
    known = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    found = queries.QUERIES["op10_language_id"](spark, sf_dir).collect()
    assert len(found) == len(known) and all(r.held_out == held(r.doc_id) for r in found)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in found if r.held_out]) > 0.9


def test_kernel_is_the_share_of_common_grams():
    texts, seen = ["ab ba", "abba", "xyz"], np.zeros(1 << language_id.BITS, bool)
    grams = [{f" {' '.join(t.split())} "[i : i + n] for n in (1, 2, 3) for i in range(len(t) + 3 - n)} for t in texts]
    assert [language_id.present(t, seen)[1] for t in texts] == [len(g) for g in grams]
    model = language_id.fit(texts, ["a", "b", "c"])
    got = language_id._kernels(model, [language_id.present(t, seen) for t in texts])
    want = [[len(x & y) / (len(x) * len(y)) ** 0.5 for y in grams] for x in grams]
    assert np.allclose(got, want)
