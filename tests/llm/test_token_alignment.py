"""Groups and counts against a plain walk over the bytes of all tokens."""

import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import queries, token_alignment
from tidemark.llm.common import table

ODD = [
    "", " ", "  a", "a  b ", "\n\t\r\n", "é😀漢字 x", "▁", "a▁b", "\x00x", "a" * 5_000, "x" * 100 + " y" * 300, "😀" * 60, "<|endoftext|> a<s></s><unk>",
    "<0x41> A", "don't won't  we'll", "İstanbul ÑANDÚ ñandú", "á ​ b", "   　", "1234567 12 a1b2",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(queries.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)


SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BACK = {chr(b): b for b in SHOWN} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in SHOWN)}


def a_bytes(a, i):
    return bytes(BACK[c] for c in a.id_to_token(i))


def b_bytes(b, i):
    piece = b.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()


def plain_groups(both, text):
    """[(A ids, B ids)], none for texts that don't come back."""
    a, b = both
    sides = [(i, a_bytes(a, i)) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, b_bytes(b, i)) for i in b.encode(text)]
    if not text or any(b"".join(t for _, t in side) != (" " + text).encode() for side in sides):
        return []
    ends = []
    for side in sides:
        at, found = 0, []
        for _, t in side:
            at += len(t)
            found.append(at)
        ends.append(found)
    shared, groups, last = sorted(set(ends[0]) & set(ends[1])), [], 0
    for end in shared:
        places = [(bisect_right(es, last), bisect_right(es, end)) for es in ends]
        groups.append(tuple([i for i, _ in side[low:high]] for side, (low, high) in zip(sides, places)))
        last = end
    return groups


def plain(both, rows):
    groups = [(i, plain_groups(both, t or "")) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, g in groups for a, b in g)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for i, g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(counts[x] == most[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if g else "",
        )


def test_query_agrees_with_a_plain_walk(spark, sf_dir, both):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    found = queries.QUERIES["op11_token_alignment"](spark, sf_dir).collect()
    assert sorted(map(tuple, found)) == sorted(plain(both, rows))


def test_odd_rows(spark, both, monkeypatch):
    monkeypatch.setattr(token_alignment, "AT_ONCE", 50)
    rows = list(enumerate(ODD)) + [(3, "a  b "), (None, "z z"), (30, None), (31, "z z")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, Pairs string")
    tokenizers = token_alignment.read_tokenizers(queries.A_FILE, queries.MODEL_FILE)
    aligned = token_alignment.align(docs, tokenizers)
    bound = token_alignment.most_pairs(tokenizers.a_tokens, tokenizers.b_tokens)
    found = token_alignment.score_links(aligned, token_alignment.pair_counts(aligned), bound).collect()
    got = [
        (r.doc_id, r.n_a, r.n_b, r.n_links, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        for r in found
    ]
    assert sorted(got, key=repr) == sorted(plain(both, rows), key=repr)
    none = token_alignment.align(docs.limit(0), tokenizers)
    assert token_alignment.score_links(none, token_alignment.pair_counts(none), bound).collect() == []


def test_ids_are_those_of_the_library_of_the_file(both):
    """The encoder in use is another library's; each code point there is, between letters, digits and blanks."""
    tokenizers = token_alignment.read_tokenizers(queries.A_FILE, queries.MODEL_FILE)
    aligner = token_alignment.Aligner(tokenizers)
    some = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b 1{c}2 {c}{c}\n" for c in some[i : i + 40]) for i in range(0, len(some), 40)]
    for i in range(0, len(texts), 1000):
        part = texts[i : i + 1000]
        library = both[0].encode_batch([" " + t for t in part], add_special_tokens=False)
        assert [ids.tolist() for ids in aligner.tokenise(part)[0]] == [e.ids for e in library]


def test_a_window_met_again_is_cut_alike(both, monkeypatch):
    tokenizers = token_alignment.read_tokenizers(queries.A_FILE, queries.MODEL_FILE)
    aligner = token_alignment.Aligner(tokenizers)
    text = "the thnt entestion  the thnt\nthe thnt"
    a, b = aligner.tokenise([text])
    (first,) = aligner.align([text], a, b)
    assert aligner.known and aligner.align([text], a, b) == [first]
    assert len(aligner.known) < len(aligner._windows(text, a[0], b[0]))
    aligner.known.clear()
    monkeypatch.setattr(token_alignment, "REMEMBERED", 3)
    monkeypatch.setattr(token_alignment, "LONG", 3)
    assert aligner.align([text, text], a * 2, b * 2) == [first, first]
    assert all(len(k[0]) + len(k[1]) <= 12 for k in aligner.known)


def test_pairs_are_bounded_by_the_vocabularies():
    a, b = [b"a", b"ba", b"c"], [b"a", b"cba", b"c", b"c"]
    ends_together = sum(x.endswith(y) or y.endswith(x) for x in a for y in b)
    assert token_alignment.most_pairs(a, b) == ends_together
