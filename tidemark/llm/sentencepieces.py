"""SentencePiece encoding and decoding: the best path over a vocabulary's pieces and their scores.

The vocabulary comes from a model file, which the driver reads; the trie made of it is sent to the
tasks and is as large as the vocabulary. White space becomes U+2581, with one put in front of a text.
Of all ways to cut a text into pieces the one with the largest sum of scores is taken; a character
that no piece covers is encoded as its UTF-8 bytes.

A double array holds the trie: from state s, character c leads to t = base[s] + c if check[t] == s.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import unused
from tidemark.session import runs_on_executors

runs_on_executors(__name__)

SPACE = "▁"
# Fixed values of the model format: kinds of pieces, and what a piece outside the vocabulary costs.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNKNOWN_PENALTY = 10.0

# Segments up to this length are cut many at a time.
LONG = 48
# Segments that a task remembers.
REMEMBERED = 100_000


class Vocabulary(NamedTuple):
    """What tasks need of a model; `codes` maps characters of pieces to 1, 2, ..."""

    codes: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # the piece that ends in a state, or -1
    scores: np.ndarray
    surfaces: list[bytes]  # what each id decodes to
    first_byte: int  # the id of the piece of byte 0
    unknown_score: float
    longest: int
    crosses: bool  # whether a piece has white space behind other characters
    pairs: bool  # whether a piece has more than one white space


def double_array(words: list[tuple[list[int], int]], n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie of (codes, value); codes are 1 to n_codes."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for codes, value in words:
        node = 0
        for c in codes:
            below = children[node].get(c)
            if below is None:
                below = children[node][c] = len(children)
                children.append({})
                values.append(-1)
            node = below
        values[node] = value
    size = len(children) + 2 * n_codes + 16
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    value = np.full(size, -1, np.int32)
    taken = np.zeros(size, bool)
    taken[0] = True
    check[0] = 0
    state_of = {0: 0}
    order = [0]
    for node in order:
        below = children[node]
        state = state_of[node]
        value[state] = values[node]
        if not below:
            continue
        codes = np.array(sorted(below), np.int64)
        # Bases that put the first code on a free place, tried many at a time.
        b = None
        while b is None:
            tries = np.flatnonzero(~taken[: len(taken) - n_codes]) - int(codes[0])
            tries = tries[tries > 0]
            for i in range(0, len(tries), 256):
                fits = ~taken[tries[i : i + 256, None] + codes].any(axis=1)
                if fits.any():
                    b = int(tries[i + int(fits.argmax())])
                    break
            else:
                more = len(taken)
                base, value = np.concatenate([base, np.zeros(more, np.int32)]), np.concatenate([value, np.full(more, -1, np.int32)])
                check, taken = np.concatenate([check, np.full(more, -1, np.int32)]), np.concatenate([taken, np.zeros(more, bool)])
        base[state] = b
        for c in codes.tolist():
            taken[b + c] = True
            check[b + c] = state
            state_of[below[c]] = b + c
            order.append(below[c])
    end = int(np.flatnonzero(taken)[-1]) + n_codes + 2
    base, check, value = (np.concatenate([x, np.full(n_codes + 2, f, np.int32)])[:end] for x, f in ((base, 0), (check, -1), (value, -1)))
    return base, check, value


def read_vocabulary(model_file: str) -> Vocabulary:
    """The pieces and scores of a SentencePiece model with byte fallback."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as file:
        model.ParseFromString(file.read())
    pieces = [(p.piece, p.type, p.score) for p in model.pieces]
    return make_vocabulary(pieces)


def make_vocabulary(pieces: list[tuple[str, int, float]]) -> Vocabulary:
    """Of (piece, kind, score) by id."""
    kinds = [kind for _, kind, _ in pieces]
    if kinds.count(BYTE) != 256:
        raise ValueError("the vocabulary has no byte fallback")
    whole = [(text, i) for i, (text, kind, _) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)]
    codes = {c: n for n, c in enumerate(sorted({c for text, _ in whole for c in text}), 1)}
    base, check, piece = double_array([([codes[c] for c in text], i) for text, i in whole], len(codes))
    scores = np.array([score for _, _, score in pieces], np.float64)
    surfaces = []
    for text, kind, _ in pieces:
        if kind == BYTE:
            surfaces.append(bytes([int(text[1:-1], 16)]))
        else:
            surfaces.append(text.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"")
    return Vocabulary(
        codes,
        base,
        check,
        piece,
        scores,
        surfaces,
        kinds.index(BYTE),
        min((scores[i] for _, i in whole), default=0.0) - UNKNOWN_PENALTY,
        max((len(text) for text, _ in whole), default=1),
        any(SPACE in text.lstrip(SPACE) for text, _ in whole),
        any(text.count(SPACE) > 1 for text, _ in whole),
    )


class Encoder:
    """Encodes texts with a vocabulary; remembers the segments that it met last."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.lists = (vocabulary.base.tolist(), vocabulary.check.tolist(), vocabulary.piece.tolist())
        self.score_list = vocabulary.scores.tolist()
        self.code_of = np.zeros(0x110000, np.int32)
        for c, code in vocabulary.codes.items():
            self.code_of[ord(c)] = code
        self.known: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses: white space begins a part, unless pieces say otherwise."""
        text = SPACE + text.replace(" ", SPACE)
        if self.v.crosses:
            return [text]
        parts = text.split(SPACE)
        # parts[0] is what stands before the first white space: nothing.
        if not self.v.pairs:
            return [SPACE + p for p in parts[1:]]
        out, run = [], 0
        for p in parts[1:]:
            run += 1
            if p:
                out.append(SPACE * run + p)
                run = 0
        if run:
            out.append(SPACE * run)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, none for the empty text."""
        cut = [self.segments(t) if t else [] for t in texts]
        known = self.known
        new = {s for parts in cut for s in parts if s not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {s for parts in cut for s in parts}
        known.update(self._best(new))
        return [np.frombuffer(b"".join([known[s] for s in parts]), np.int32) for parts in cut]

    def _best(self, segments: set[str]) -> dict[str, bytes]:
        found, by_length = {}, {}
        for s in segments:
            if len(s) > LONG:
                found[s] = self.best_path(s)
            else:
                by_length.setdefault(len(s), []).append(s)
        for length, group in by_length.items():
            for i in range(0, len(group), 8192):
                found.update(self._best_paths(group[i : i + 8192], length))
        return found

    def best_path(self, segment: str) -> bytes:
        """One segment, a character at a time."""
        v, (base, check, piece), scores = self.v, self.lists, self.score_list
        codes = [v.codes.get(c, 0) for c in segment]
        n = len(codes)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            state, single, here = 0, False, best[i]
            for j in range(i, min(n, i + v.longest)):
                c = codes[j]
                to = base[state] + c
                if not c or check[to] != state:
                    break
                state = to
                if piece[state] >= 0:
                    single |= j == i
                    score = here + scores[piece[state]]
                    # The first of equal ones stays: the one whose last piece is the longest.
                    if score > best[j + 1]:
                        best[j + 1], back[j + 1] = score, (i, piece[state])
            if not single and here + v.unknown_score > best[i + 1]:
                best[i + 1], back[i + 1] = here + v.unknown_score, (i, -1)
        ids, at = [], n
        while at:
            start, which = back[at]
            if which < 0:
                ids.extend(v.first_byte + b for b in reversed(segment[start].encode("utf-8", "replace")))
            else:
                ids.append(which)
            at = start
        return np.array(ids[::-1], np.int32).tobytes()

    def _best_paths(self, group: list[str], n: int) -> Iterator[tuple[str, bytes]]:
        """Segments of n characters each, all of them a step at a time."""
        v, m = self.v, len(group)
        # Lone surrogates are characters like any other that no piece has.
        codes = self.code_of[np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)].reshape(m, n)
        best = np.full((m, n + 1), -np.inf)
        best[:, 0] = 0
        start, which = np.zeros((m, n + 1), np.int32), np.full((m, n + 1), -1, np.int32)
        for i in range(n):
            rows, state = np.arange(m), np.zeros(m, np.int32)
            single = np.zeros(m, bool)
            for j in range(i, min(n, i + v.longest)):
                c = codes[rows, j]
                to = v.base[state] + c
                go = (c > 0) & (v.check[to] == state)
                rows, state = rows[go], to[go]
                if not len(rows):
                    break
                ids = v.piece[state]
                ends = ids >= 0
                at, ids = rows[ends], ids[ends]
                if j == i:
                    single[at] = True
                score = best[at, i] + v.scores[ids]
                better = score > best[at, j + 1]
                at = at[better]
                best[at, j + 1], start[at, j + 1], which[at, j + 1] = score[better], i, ids[better]
            at = np.flatnonzero(~single)
            at = at[best[at, i] + v.unknown_score > best[at, i + 1]]
            best[at, i + 1], start[at, i + 1], which[at, i + 1] = best[at, i] + v.unknown_score, i, -1
        # Walked back together as well: place k from the end of each row.
        out = np.full((m, n), -2, np.int32)
        place = np.full(m, n, np.int32)
        rows = np.arange(m)
        while len(rows):
            at = place[rows]
            out[rows, at - 1] = which[rows, at]
            place[rows] = start[rows, at]
            rows = rows[place[rows] > 0]
        # The ids of all segments in a row, and where each one's begin.
        kept = out >= 0
        flat, ends = out[kept].tobytes(), np.concatenate([[0], np.cumsum(kept.sum(axis=1))]).tolist()
        by_bytes = set(np.flatnonzero((out == -1).any(axis=1)).tolist())
        for i, s in enumerate(group):
            if i not in by_bytes:
                yield s, flat[4 * ends[i] : 4 * ends[i + 1]]
                continue
            ids = [
                x
                for c, w in enumerate(out[i].tolist())
                if w != -2
                for x in ([w] if w >= 0 else [v.first_byte + b for b in s[c].encode("utf-8", "replace")])
            ]
            yield s, np.array(ids, np.int32).tobytes()


def decode_ids(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of some ids: byte pieces make up UTF-8, and the white space put in front goes.

    Bytes that are no UTF-8 become U+FFFD, and so do ids that the vocabulary has not.
    """
    surfaces, n = vocabulary.surfaces, len(vocabulary.surfaces)
    found = b"".join([surfaces[i] if 0 <= i < n else b"\xff" for i in ids])
    return found.removeprefix(b" ").decode("utf-8", "replace")


def decode_lists(vocabulary: Vocabulary, lists: pa.ListArray) -> list[str | None]:
    """The text of each list of ids; null for null, and for lists with a null as for an id that the vocabulary has not."""
    flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    ids = flat.fill_null(-1).to_numpy(zero_copy_only=False)
    surfaces = [*vocabulary.surfaces, b"\xff"]
    # What the vocabulary has not is decoded as the last surface.
    parts = [surfaces[i] for i in np.where((ids < 0) | (ids >= len(surfaces) - 1), len(surfaces) - 1, ids).tolist()]
    known = lists.is_valid().to_pylist()
    ends = ends.tolist()
    return [
        b"".join(parts[a:b]).removeprefix(b" ").decode("utf-8", "replace") if k else None for k, a, b in zip(known, ends, ends[1:])
    ]


def encode(
    documents: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, ids) per row, without a shuffle: null for null, no ids for the empty text.

    Whole texts are encoded, in parts that white space begins and that are remembered within bounds.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = encoder.encode([t or "" for t in texts])
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            # A null among the offsets is a null list.
            offsets = pa.array(ends, mask=np.array([t is None for t in texts] + [False]))
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null for null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    if to.lower() in {c.lower() for c in encoded.columns}:
        raise ValueError(f"there is already a column {unused(to, [])!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            texts = decode_lists(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    schema = ", ".join(f"`{n}` {k}" for n, k in [*encoded.dtypes, (to, "string")])
    return encoded.mapInArrow(run, schema)
