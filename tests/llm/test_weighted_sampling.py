"""Fingerprints of many texts at once against those of one text, and how often draws are made."""

import numpy as np

from tidemark.llm import weighted_sampling as ws


def test_a_batch_of_texts_is_drawn_for_at_once(monkeypatch):
    drawn, draws = [], ws.draws

    def noted(terms, *args):
        drawn.append(len(terms))
        return draws(terms, *args)

    monkeypatch.setattr(ws, "draws", noted)
    texts = [f"both both w{i} x{i}" for i in range(200)]
    ws.Sampler().fingerprints([*texts, *texts])
    assert sum(drawn) == 401 and len(drawn) <= 2


def test_a_text_has_one_fingerprint_whatever_is_remembered(monkeypatch):
    long = " ".join(f"w{i % 3000} x{i}" for i in range(9000))
    turned = " ".join(reversed(long.split()))
    texts = [long, None, "", " \n", "One two two", "two ONE two", turned, *(f"w{i} w{i} x{i + 1}" for i in range(300)), long]
    alone = [ws.Sampler().fingerprint(t) for t in texts]
    for remembered, group in ((10_300, 8_192), (12_000, 1), (250_000, 8_192)):
        monkeypatch.setattr(ws, "REMEMBERED", remembered)
        monkeypatch.setattr(ws, "GROUP", group)
        assert np.array_equal(ws.Sampler().fingerprints(texts), alone)
    assert np.array_equal(alone[0], alone[6]) and np.array_equal(alone[4], alone[5]) and not np.any(alone[1:4])


def test_draws_follow_the_definition():
    """Term by term, in plain Python."""

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    uniform = lambda x: (np.float32(x >> 8) + np.float32(0.5)) * np.float32(2**-24)
    terms, weights = [5, 2**64 - 3, 2**63 + 11, 7 << 48], [1, 3, 1, 4000]
    cost, mark = ws.draws(np.array(terms, np.uint64), np.array(weights), 16)
    for i, (term, weight) in enumerate(zip(terms, weights)):
        for k in range(16):
            bits = [mix((term + k * 0x9E3779B97F4A7C15) % 2**64 ^ 0xD1B54A32D192ED03 * j % 2**64) for j in (1, 2, 3)]
            r, c = (-np.log(uniform(x % 2**32) * uniform(x >> 32)) for x in bits[:2])
            b = uniform(bits[2] % 2**32)
            s = np.floor(np.log(np.float32(weight)) / r + b) if weight > 1 else np.float32(0)
            assert np.isclose(cost[i, k], np.log(c) - r * (s - b + 1), rtol=1e-4, atol=1e-5)
            assert mark[i, k] == (term >> 48) ^ (mix(int(s) % 2**64) >> 48 if weight > 1 else 0)
