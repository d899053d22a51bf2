"""Fingerprints of weighted terms by consistent weighted sampling.

A text's terms are its words, lower-case, and a term's weight is the number of its occurrences. For sample k and term t
there are r, c ~ Gamma(2, 1) and b ~ U(0, 1), all made from a hash of t and k, so that every task draws alike.
With s = floor(ln(weight) / r + b), the sample is the (t, s) with the smallest c / exp(r (s - b) + r). Two texts have equal samples
with a probability of sum(min) / sum(max) over their weights: the generalised Jaccard similarity. The share
of equal samples estimates it, with a standard error of at most 0.5 / sqrt(`SAMPLES`).

A sample is kept as 16 bits of a hash of (t, s); different ones look equal once in 65,536.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import spread, unused
from tidemark.session import runs_on_executors

runs_on_executors(__name__)

SAMPLES, SEED = 128, 42
# (term, weight) pairs whose draws a task remembers, those of a text and those of a group of texts that are looked up at a time, and those
# drawn at a time, which fit into a CPU's cache.
REMEMBERED, PART, GROUP, DRAWN = 250_000, 2_048, 8_192, 512


def _mix(x: np.ndarray) -> np.ndarray:
    """In place."""
    shifted = x >> np.uint64(30)
    x ^= shifted
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=shifted)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=shifted)
    return x


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1), from 24 bits."""
    # Signed numbers become floating ones faster.
    u = bits.astype(np.uint32, copy=False).view(np.int32).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2**-24)
    return u


def draws(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """(what the sample minimises, 16 bits of the sample) per term hash and sample."""
    key = terms[:, None] + np.arange(samples, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    drawn = lambda i: _mix(key ^ np.uint64(0xD1B54A32D192ED03 * i % 2**64))
    # The upper 24 of the lower and of the upper 32 bits.
    low = lambda bits: _uniform(bits.astype(np.uint32) >> np.uint32(8))

    def gamma(bits: np.ndarray) -> np.ndarray:
        g = low(bits)
        bits >>= np.uint64(40)
        g *= _uniform(bits)
        np.log(g, out=g)
        return np.negative(g, out=g)

    r, cost, b = gamma(drawn(1)), gamma(drawn(2)), low(drawn(3))
    np.log(cost, out=cost)
    mark = np.repeat((terms >> np.uint64(48)).astype(np.uint16)[:, None], samples, axis=1)
    # The logarithm of the weight one is zero, and s too.
    several = np.flatnonzero(weights > 1)
    s = np.floor(np.log(weights[several].astype(np.float32))[:, None] / r[several] + b[several])
    mark[several] ^= (_mix(s.astype(np.int64).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    np.negative(b, out=b)
    b[several] += s
    b += np.float32(1)
    b *= r
    cost -= b
    return cost, mark


class Sampler:
    """Fingerprints texts, and remembers the draws of the terms that it met last."""

    def __init__(self, samples: int = SAMPLES):
        self.samples, self.k = samples, np.arange(samples)
        # Of a pair of weight one the term alone, which is found faster.
        self.rows: dict[bytes | tuple[bytes, int], int] = {}
        self.cost = np.zeros((0, samples), np.float32)
        self.mark = np.zeros((0, samples), np.uint16)

    def _find(self, pairs: list[bytes | tuple[bytes, int]]) -> np.ndarray:
        return np.fromiter(map(self.rows.get, pairs, repeat(-1)), np.int64, len(pairs))

    def _rows(self, pairs: list[bytes | tuple[bytes, int]]) -> np.ndarray:
        at = self._find(pairs)
        found = list(dict.fromkeys(pairs[i] for i in np.flatnonzero(at < 0).tolist()))
        if not found:
            return at
        if len(self.rows) + len(found) > REMEMBERED:
            self.rows.clear()
            found = list(dict.fromkeys(pairs))
        n = len(self.rows)
        to = n + len(found)
        if to > len(self.cost):
            more = max(to, min(2 * len(self.cost), REMEMBERED), 4096)
            for name in ("cost", "mark"):
                old = getattr(self, name)
                grown = np.zeros((more, self.samples), old.dtype)
                grown[:n] = old[:n]
                setattr(self, name, grown)
        terms = np.array([xxhash.xxh64_intdigest(p if isinstance(p, bytes) else p[0], SEED) for p in found], np.uint64)
        weights = np.array([1 if isinstance(p, bytes) else p[1] for p in found], np.int64)
        for i in range(0, len(found), DRAWN):
            these = slice(n + i, min(n + i + DRAWN, to))
            self.cost[these], self.mark[these] = draws(terms[i : i + DRAWN], weights[i : i + DRAWN], self.samples)
        self.rows.update(zip(found, range(n, to)))
        return self._find(pairs)

    def _smallest(self, rows: np.ndarray) -> np.ndarray:
        """Per sample the row with the smallest cost, of several the first."""
        cost = self.cost.take(rows, axis=0)
        hits = np.flatnonzero(cost == cost.min(axis=0))
        # An equal cost is rare, and `argmin` takes longer.
        if len(hits) != self.samples:
            return rows[cost.argmin(axis=0)]
        at = np.empty(self.samples, np.int64)
        at[hits % self.samples] = rows[hits // self.samples]
        return at

    def _sampled(self, parts: list[tuple[int, list]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each part of a text's pairs: the text's number, and the costs and marks of its samples."""
        rows = self._rows([p for _, pairs in parts for p in pairs])
        begin = 0
        for i, pairs in parts:
            at = self._smallest(rows[begin : begin + len(pairs)])
            begin += len(pairs)
            yield i, self.cost[at, self.k], self.mark[at, self.k]

    def fingerprints(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """For each text `samples` numbers of 16 bits; all zero for one without words, null and empty ones too."""
        found, best = [], {}

        def take(parts):
            # Of equal costs the smaller mark counts, so that the order of the words doesn't.
            for i, cost, mark in self._sampled(parts):
                if i in best:
                    better = (cost < best[i]) | (cost == best[i]) & (mark < found[i])
                    cost, mark = np.where(better, cost, best[i]), np.where(better, mark, found[i])
                best[i], found[i] = cost, mark

        parts, size = [], 0
        for i, text in enumerate(texts):
            words = Counter((text or "").lower().encode("utf-8", "replace").split())
            pairs = [t if w == 1 else (t, w) for t, w in words.items()]
            found.append(np.zeros(self.samples, np.uint16))
            for at in range(0, len(pairs), PART):
                parts.append((i, pairs[at : at + PART]))
                size += len(parts[-1][1])
                if size >= GROUP:
                    take(parts)
                    parts, size = [], 0
        if parts:
            take(parts)
        return found

    def fingerprint(self, text: str | None) -> np.ndarray:
        return self.fingerprints([text])[0]


def _hex(fp: np.ndarray) -> str:
    return fp.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples."""
    return float((a == b).mean())


def fingerprints(documents: DataFrame, text: str = "text", to: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """The documents with a column `to`: the fingerprint in hex, four digits per sample."""
    if to.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"there is already a column {to!r}; {unused(to, documents.columns)!r} is free")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [_hex(fp) for fp in sampler.fingerprints(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, to])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(to, T.StringType())]))


def followed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """(at, id, text, kept) such that sorted by `at`, then `id` and text downwards, each kept row stands before its next one.

    The ids are cut into `ranges` ranges of about equal size, and each range gets a copy of the first row of
    the next one that has rows, as its last row, with `kept` false. Ids must be numbers; rows with
    a null id come last. Rows with equal ids follow each other by text, the larger first.
    """
    rows = documents.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    # More ranges than partitions, so that these come out even.
    n = ranges or 8 * spread(documents.sparkSession)
    cuts = sorted(set(rows.approxQuantile("id", [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []
    # Range 0 has the largest ids. Few of the limits are looked at: some that lie far apart, then those in between.
    limits = sorted({-int(c) for c in cuts})
    step = max(1, math.isqrt(len(limits)))
    array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)).cast("array<bigint>")
    passed = lambda xs: F.size(F.filter(xs, lambda c: -F.col("id") > c))
    whole = passed(array(limits[step - 1 :: step])) * step
    at = F.when(F.col("id").isNull(), len(limits)).otherwise(whole + passed(F.slice(array(limits), whole + 1, step)))
    rows = rows.select(at.cast("int").alias("at"), "id", "text", F.lit(True).alias("kept"))
    # One row per range, found by ids alone and then fetched.
    order = F.struct(F.col("id").isNotNull().alias("has"), "id", "text")
    firsts = rows.groupBy("at").agg(F.max(order).alias("first"))
    starts = firsts.select("at").collect()
    used = sorted(r["at"] for r in starts)
    before = {a: used[i - 1] for i, a in enumerate(used)}  # the last range stands before the first
    if not used:
        return rows
    to = F.create_map(*(F.lit(x).cast("int") for pair in before.items() for x in pair))
    ends = firsts.select(to[F.col("at")].alias("at"), F.col("first.id").alias("id"), F.col("first.text").alias("text"), F.lit(False).alias("kept"))
    return rows.unionByName(ends)


def edits(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each text's fingerprint beside those of an edited form and of the next document's text.

    The edited form has its last third (of code points, rounded down) replaced by the beginning of the
    next document's text, of the same length or all of it. Next is the document with the next smaller id; the last
    one is followed by the first. Returns (doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited,
    near_next). A null text counts as empty; two texts without words are alike by 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held = None
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4))))
            followers = []
            for (at, key, words, kept), fp in zip(rows, sampler.fingerprints(row[2] for row in rows)):
                if held is not None and held[0] == at:
                    _, old_key, old, old_fp = held
                    n = len(old) // 3
                    followers.append((old_key, old, old[: len(old) - n] + words[:n], old_fp, fp))
                held = (at, key, words, fp) if kept else None
            out = [
                (key, len(old), edited, _hex(old_fp), _hex(new), likeness(old_fp, new), likeness(old_fp, fp))
                for (key, old, edited, old_fp, fp), new in zip(followers, sampler.fingerprints(f[2] for f in followers))
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(result.names, r)) for r in out], schema=result)

    kind = dict(documents.dtypes)[doc_id]
    schema = T.StructType.fromDDL(
        f"doc_id {kind}, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    result = to_arrow_schema(schema)
    rows = followed(documents, doc_id, text)
    sent = rows.repartition(spread(documents.sparkSession), "at").sortWithinPartitions(
        F.col("at"), F.col("kept").desc(), F.col("id").desc_nulls_last(), F.col("text").desc()
    )
    return sent.select("at", "id", "text", "kept").mapInArrow(run, schema)
