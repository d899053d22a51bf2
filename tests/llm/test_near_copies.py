"""The stage for near copies: copies of 0.8 or more go, others stay."""

import random

import numpy as np

from tidemark.llm import simhash


def test_copies_go_and_others_stay(spark):
    rng = random.Random(3)
    texts, want = [], set()
    for group in range(40):
        words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
        want.add(len(texts))
        texts.append(" ".join(words))
        for _ in range(3):
            other = list(words)
            for at in rng.sample(range(300), 5):
                other[at] = "new"
            texts.append(" ".join(other))
        texts.append(" ".join(words))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(9000, None, "y"), (9001, "", "y"), (9001, "", "y"), (None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Kept_ID string")
    kept = simhash.one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want | {9000})
    assert simhash.one_each(docs.limit(0)).collect() == []


def with_similarity(rng, shared, own):
    """Two texts that share `shared` five-word shingles and have `own` more each; their similarity is shared / (shared + 2 own)."""
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    common = [word() for _ in range(shared + 4)]
    return [" ".join(common + [word() for _ in range(own)]) for _ in range(2)]


def kept_apart(spark, planted):
    """How many of each kind's pairs stay two documents; `planted` has a list of pairs for each kind."""
    pairs = [(kind, pair) for kind, some in planted.items() for pair in some]
    rows = [(2 * i + k, text) for i, (_, pair) in enumerate(pairs) for k, text in enumerate(pair)]
    kept = {r.doc_id for r in simhash.one_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    return {kind: sum(k == kind and 2 * i + 1 in kept for i, (k, _) in enumerate(pairs)) for kind in planted}


def test_only_pairs_of_the_similarity_are_copies(spark):
    rng = random.Random(5)
    # (shared, own): 0.6, 0.7, 0.79 and just below 0.8; then 0.8 itself and 0.81.
    below, above = [(300, 100), (280, 60), (316, 42), (399, 50)], [(400, 50), (324, 38)]
    found = kept_apart(spark, {kind: [with_similarity(rng, *kind) for _ in range(60)] for kind in below + above})
    assert [found[kind] for kind in below] == [60] * 4
    assert max(found[kind] for kind in above) <= 2


def test_bands_fail_independently():
    rng = np.random.default_rng(17)
    # By calculation 0.028 %, 0.0002 % and under 1e-8 of the pairs share no band.
    for shared, own, most in ((160, 20, 5), (180, 10, 1), (190, 5, 0)):
        lost = 0
        for _ in range(4000):
            hashes = rng.integers(0, 2**64, shared + 2 * own, dtype=np.uint64)
            a, b = hashes[: shared + own], np.concatenate([hashes[:shared], hashes[shared + own :]])
            lost += not any(x == y for x, y in zip(simhash.bands(a), simhash.bands(b)))
        assert lost <= most


def test_copies_with_distant_fingerprints_go(spark):
    rng = random.Random(7)
    far = []
    while len(far) < 30:
        a, b = with_similarity(rng, 160, 20)
        fps = [simhash.fingerprint(t, simhash.WIDE_WORDS) for t in (a, b)]
        if (fps[0] ^ fps[1]).bit_count() > 14:
            far.append((a, b))
    assert kept_apart(spark, {"far": far})["far"] <= 1


def test_large_shards_are_cut_to_tiles(spark):
    # One shard: 600 members of one root, 300 of three others; 100 shingles each.
    rows = [("s", i, 100, 0 if i < 600 else i % 3 + 1) for i in range(900)]
    members = spark.createDataFrame(rows, "shard string, node bigint, n_shingles bigint, root bigint")
    held = {}
    for r in simhash._tiles(members, 10_000).collect():
        held.setdefault(r.tile, ([], []))[r.apart].append((r.node, r.root))
    assert max(len(side) for sides in held.values() for side in sides) <= 150
    met = [(a, b) for others, apart in held.values() for a in apart for b in others if a[1] != b[1]]
    want = {(a, b) for _, a, _, r in rows if r for _, b, _, q in rows if q != r}
    assert len(met) == len(want) and {(a[0], b[0]) for a, b in met} == want


def test_tiles_give_the_same_groups(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    # All share 150 of 250 words, so that they meet in shards; five of each six are alone, the others have a copy.
    common, texts, want = [word() for _ in range(150)], [], set()
    for i in range(120):
        words = common + [word() for _ in range(100)]
        want.add(len(texts))
        texts.append(" ".join(words))
        if i % 6 == 0:
            texts.append(" ".join(words[:-5] + [word() for _ in range(5)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.one_each(docs, tile=2000).collect()} == want
    assert {r.doc_id for r in simhash.one_each(docs).collect()} == want


def test_linked_fingerprints_propose_pairs(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    texts, want = [], set()
    for _ in range(20):
        words = [word() for _ in range(600)]
        want.add(len(texts))
        texts += [" ".join(words), " ".join(words[:-1] + [word()])]
    # Nearly all shingles are repeats of a few, so the fingerprints are equal; the sets share fewer than 0.8.
    common = " ".join(["one two three"] * 400)
    apart = [f"{common} {word()}" for _ in range(2)]
    assert len({simhash.fingerprint(t) for t in apart}) == 1
    want |= {len(texts), len(texts) + 1}
    docs = spark.createDataFrame(list(enumerate(texts + apart)), "doc_id bigint, text string")
    near = {i for i in range(0, 40, 2) if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i + 1])).bit_count() <= 2}
    assert len(near) >= 10
    # Without bands the links between fingerprints are all that proposes pairs.
    kept = {r.doc_id for r in simhash.one_each(docs, n_bands=0).collect()}
    assert kept == want | {i + 1 for i in range(0, 40, 2) if i not in near}
    assert {r.doc_id for r in simhash.one_each(docs).collect()} == want
