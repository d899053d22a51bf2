"""The best path against all cuts and a public library, and texts that come back as they were."""

import itertools
import random

import numpy as np
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm import queries, sentencepieces
from tidemark.llm.common import table

ODD = ["", " ", "  a", "a  b ", "\n\t\r", "é😀漢", "▁", "▁ ▁", "\x00x", "a" * 70_000, "x" * 100 + " y" * 100, "😀" * 60]


def all_cuts(text):
    for ends in itertools.product([False, True], repeat=len(text) - 1):
        cuts = [0, *(i for i, e in enumerate(ends, 1) if e), len(text)]
        yield [text[a:b] for a, b in zip(cuts, cuts[1:])]


def small_vocabulary(rng):
    words = {"".join(rng.choices("ab▁", k=rng.randint(1, 4))) for _ in range(25)}
    pieces = [("<unk>", 2, 0.0), *((f"<0x{b:02X}>", sentencepieces.BYTE, 0.0) for b in range(256))]
    return pieces + [(w, sentencepieces.NORMAL, -rng.random() * 10) for w in sorted(words)]


def test_best_path_is_the_best_of_all_cuts():
    rng = random.Random(4)
    for _ in range(20):
        pieces = small_vocabulary(rng)
        vocabulary = sentencepieces.make_vocabulary(pieces)
        score = {w: s for w, kind, s in pieces if kind == sentencepieces.NORMAL}
        lowest = min(score.values()) - sentencepieces.UNKNOWN_PENALTY
        encoder = sentencepieces.Encoder(vocabulary)
        for _ in range(10):
            text = "".join(rng.choices("abc ", k=rng.randint(1, 9)))
            shown = "▁" + text.replace(" ", "▁")

            def total(cut):
                if any(len(w) > 1 and w not in score for w in cut):
                    return float("-inf")
                return sum(score.get(w, lowest) for w in cut)

            (ids,) = encoder.encode([text])
            # A byte piece stands for one character that no piece covers.
            got = sum(lowest if pieces[i][1] == sentencepieces.BYTE else pieces[i][2] for i in ids if pieces[i][0] not in ("<0xE2>", "<0x96>"))
            assert abs(got - max(map(total, all_cuts(shown)))) < 1e-9
            assert sentencepieces.decode_ids(vocabulary, ids.tolist()) == text


def test_agrees_with_a_public_library(spark, sf_dir):
    """In its unigram mode, on scores that its 32-bit sums can hold: those of -1e9 in the file drown all others there."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.MODEL_FILE, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    vocabulary = sentencepieces.make_vocabulary([(p.piece, p.type, p.score) for p in model.pieces])
    texts = [r.text for r in table(spark, sf_dir, "documents").select("text").collect() if r.text] + ODD[1:6]
    got = sentencepieces.Encoder(vocabulary).encode(texts)
    assert [x.tolist() for x in got] == library.encode(texts)


def test_long_and_short_segments_are_cut_alike():
    vocabulary = sentencepieces.read_vocabulary(queries.MODEL_FILE)
    encoder = sentencepieces.Encoder(vocabulary)
    for segment in ("▁hest", "▁a😀b", "▁" + "entebest" * 5, "▁▁▁x"):
        (_, many), = encoder._best_paths([segment], len(segment))
        assert many == encoder.best_path(segment)


def test_odd_rows_come_back(spark):
    vocabulary = sentencepieces.read_vocabulary(queries.MODEL_FILE)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(3, "a  b ", "y"), (50, None, None), (None, "z", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, IDs string")
    found = sentencepieces.decode(sentencepieces.encode(docs, vocabulary), vocabulary)
    got = sorted(((r.doc_id, r.decoded, r.ids is None) for r in found.collect()), key=repr)
    # The marker of white space is white space when it comes back.
    assert got == sorted(((i, t if t is None else t.replace("▁", " "), t is None) for i, t, _ in rows), key=repr)
    assert sentencepieces.decode(sentencepieces.encode(docs.limit(0), vocabulary), vocabulary).collect() == []


def test_query_returns_all_texts(spark, sf_dir):
    found = queries.QUERIES["op8_sentencepiece"](spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("own"))
    assert found.count() == texts.count()
    assert found.join(texts, "doc_id").where("decoded_sha256 <> own").count() == 0


def test_ids_outside_the_vocabulary():
    vocabulary = sentencepieces.make_vocabulary(small_vocabulary(random.Random(1)))
    assert sentencepieces.decode_ids(vocabulary, [-1, 10**6]) == "��"
    assert np.array(vocabulary.base).dtype == np.int32
