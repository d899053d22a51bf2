"""Alignment of the tokens of two tokenizers on the same text: a byte-level BPE (A) and a SentencePiece model (B).

Each text is tokenised whole by both. Where a token of either side ends before a token that begins with a space, and the
bytes so far are equal, is an anchor. Anchors cut a document into windows, mostly words, which come again and again: a window is known by
its tuples of ids, and how it is cut into groups is remembered. Within a window, groups end where tokens of both sides end together.

Of two tokens that end together the shorter is the end of the longer. So a vocabulary of n bytes in all can be linked to no more
than n tokens per side, however large the corpus is (`most_pairs`): that bounds the table of counts that goes to all tasks.
"""

from __future__ import annotations

import gc
import json
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import runs_on_executors

runs_on_executors(__name__)

SPACE = "▁"
# Fixed values of the SentencePiece format: kinds of pieces.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
# Fixed values of the byte-level format: the words that no token crosses, and how a file says so.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
# Windows that a task remembers, and the most ids that one of them may have.
REMEMBERED, LONG = 400_000, 64
# Characters tokenised at a time, if they are of several texts.
AT_ONCE = 1 << 20
SHIFT = 32


class Tokenizers(NamedTuple):
    """B's model file, and the bytes of each token by id."""

    b_file: bytes
    a_tokens: list[bytes]
    b_tokens: list[bytes]


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it shows, else 256 and up in order."""
    shown = {b for low, high in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(low), ord(high) + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def read_tokenizers(a_file: str, b_file: str) -> Tokenizers:
    """Reads both files on the driver; they are sent to the tasks, whose machines need not have them."""
    from sentencepiece import sentencepiece_model_pb2

    with open(a_file, encoding="utf-8") as file:
        a = json.load(file)
    with open(b_file, "rb") as file:
        b_model = file.read()
    alphabet = byte_alphabet()
    special = {t["content"] for t in a["added_tokens"]}
    vocabulary, merges = a["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in a["model"]["merges"]]
    # The encoder takes ids for the order of the merges, and the words of byte-level vocabularies.
    made = [vocabulary["".join(m)] for m in merges]
    if made != sorted(made) or a["pre_tokenizer"] != BYTE_LEVEL or a["normalizer"]:
        raise ValueError("not a byte-level vocabulary in the order of its merges")
    a_tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        a_tokens[i] = b"" if token in special else bytes(alphabet[c] for c in token)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(b_model)
    b_tokens = []
    for p in model.pieces:
        if p.type == BYTE:
            b_tokens.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            b_tokens.append(p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER_DEFINED) else b"")
    return Tokenizers(b_model, a_tokens, b_tokens)


def most_pairs(a_tokens: list[bytes], b_tokens: list[bytes]) -> int:
    """How many pairs of ids can end together: one of the two is the end of the other."""
    a, b = Counter(a_tokens), Counter(b_tokens)
    ends = lambda t: (t[i:] for i in range(len(t)))
    longer_a = sum(b[e] for t in a_tokens for e in ends(t))
    longer_b = sum(a[e] for t in b_tokens for e in ends(t))
    return longer_a + longer_b - sum(n * b[t] for t, n in a.items() if t)


Key = tuple[bytes, bytes]  # the ids of a window's tokens, of A and of B, as 32-bit numbers


class Groups(NamedTuple):
    """How a text is cut: its groups as text, and the pair of ids that ends each as 64-bit numbers."""

    groups: str
    pairs: bytes


class Aligner:
    """Cuts texts into groups; remembers the windows that it met last."""

    def __init__(self, tokenizers: Tokenizers):
        import sentencepiece
        import tiktoken

        ranks = {t: i for i, t in enumerate(tokenizers.a_tokens) if t}
        # Without special tokens: their strings are plain text here.
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=tokenizers.b_file)
        tables = (tokenizers.a_tokens, tokenizers.b_tokens)
        self.sizes = tuple(np.array([len(t) for t in tokens], np.int64) for tokens in tables)
        self.spaced = tuple(np.array([t[:1] == b" " for t in tokens], bool) for tokens in tables)
        # The bytes of all tokens end to end, and where each token's begin.
        self.pools = tuple((np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(n) - n) for tokens, n in zip(tables, self.sizes))
        # What follows an id: within a group, at the end of its A tokens or of the group, at the end of the window.
        n_a, n_b = map(len, tables)
        self.shown = [f"{i}{after}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for after in ends for i in range(n)] + [str(i) for i in range(n_b)]
        self.known: dict[Key, tuple[str, bytes]] = {}  # windows' groups and pairs

    def tokenise(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [np.array(self.a.encode_ordinary(" " + t), np.int32) for t in texts]
        return a, [np.array(ids, np.int32) for ids in self.b.encode(texts, num_threads=1)]

    def align(self, texts: list[str], a_lists: list[np.ndarray], b_lists: list[np.ndarray]) -> list[Groups | None]:
        """The groups of each text, or None where its tokens' bytes aren't those of a space and the text."""
        known = self.known
        keys = [self._windows(*x) or () for x in zip(texts, a_lists, b_lists)]
        met = [list(map(known.get, of_text)) for of_text in keys]
        new = dict.fromkeys(k for of_text, windows in zip(keys, met) if None in windows for k, w in zip(of_text, windows) if w is None)
        fresh = dict(self._cut(list(new)))
        found = []
        for of_text, windows in zip(keys, met):
            if None in windows:
                windows = [w or fresh[k] for k, w in zip(of_text, windows)]
            groups, pairs = zip(*windows) if windows else ((), ())
            found.append(Groups(";".join(groups), b"".join(pairs)) if windows else None)
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
        known.update((k, w) for k, w in fresh.items() if len(k[0]) + len(k[1]) <= 4 * LONG)
        return found

    def _windows(self, text: str, a_ids: np.ndarray, b_ids: np.ndarray) -> list[Key] | None:
        data = np.frombuffer(b" " + text.encode(), np.uint8)
        marks, starts = np.zeros(len(data), np.uint8), []
        for ids, size, spaced, (pool, at) in zip((a_ids, b_ids), self.sizes, self.spaced, self.pools):
            sizes = size[ids]
            start = np.cumsum(sizes) - sizes
            if not len(ids) or start[-1] + sizes[-1] != len(data):
                return None
            # Each byte of the text beside the byte of the token that covers it.
            if (pool[np.repeat(at[ids] - start, sizes) + np.arange(len(data))] != data).any():
                return None
            marks[start[spaced[ids]]] += 1
            starts.append(start)
        # Tokens of both sides begin here with a space; what comes before ends here on both sides, as their bytes are equal.
        anchors = np.flatnonzero(marks == 2)
        if not len(anchors) or anchors[0]:
            anchors = np.concatenate([[0], anchors])
        a_cuts, b_cuts = ((np.append(np.searchsorted(s, anchors), len(s)) * 4).tolist() for s in starts)
        a, b = a_ids.tobytes(), b_ids.tobytes()
        return [(a[i:j], b[k:m]) for i, j, k, m in zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:])]

    def _cut(self, keys: list[Key]) -> Iterator[tuple[Key, tuple[str, bytes]]]:
        """Cuts windows, all at once: laid end to end, both sides of each cover the same bytes."""
        if not keys:
            return
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), np.int32).astype(np.int64) for side in (0, 1))
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        at = np.searchsorted(a_ends, b_ends)
        b_last = np.flatnonzero(a_ends[at] == b_ends)
        a_last = at[b_last]
        pairs = (a[a_last] << SHIFT | b[b_last]).tobytes()
        # The ids as they are shown: of each group its A tokens and then its B tokens.
        n_a, n_b = map(len, self.sizes)
        a_group, b_group = (np.cumsum(np.bincount(last + 1, minlength=len(ids) + 1)[:-1]) for ids, last in ((a, a_last), (b, b_last)))
        order = np.empty(len(a) + len(b), np.int64)
        a_shown, b_shown = a.copy(), b + 2 * n_a
        a_shown[a_last] += n_a
        b_shown[b_last] += n_b
        window_ends = np.cumsum([len(k[1]) // 4 for k in keys])
        b_shown[window_ends - 1] += n_b
        order[np.arange(len(a)) + np.concatenate([[0], b_last + 1])[a_group]] = a_shown
        order[np.arange(len(b)) + a_last[b_group] + 1] = b_shown
        shown = list(map(self.shown.__getitem__, order.tolist()))
        n_shown = (np.cumsum([len(k[0]) // 4 for k in keys]) + window_ends).tolist()
        n_groups = (np.searchsorted(b_last, window_ends - 1) + 1).tolist()
        from_shown = from_group = 0
        for key, to_shown, to_group in zip(keys, n_shown, n_groups):
            yield key, ("".join(shown[from_shown:to_shown]), pairs[8 * from_group : 8 * to_group])
            from_shown, from_group = to_shown, to_group


def _parts(texts: list[str], at_once: int) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > at_once:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def align(documents: DataFrame, tokenizers: Tokenizers, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row, without a shuffle: (doc_id, n_a, n_b, groups, pairs, times).

    `groups` is `a1,a2|b1;a3|b2,b3`, the ids of A and B in each group in order. A link is a pair of tokens, of A and of B, that end
    together: the last two of each group. `pairs` are the different pairs of ids among them, `times` how often each is there; a
    pair is A's id times 2^32 plus B's.

    A null or empty text, and one whose tokens don't give back a space and the text, has no tokens: zeros, '' and empty arrays. Rows
    that repeat an id are rows of their own, and an empty table gives an empty one. Texts are tokenised whole, which takes about a hundred
    bytes of a task's memory per token of the longest.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(shared.value)
        # Nothing here refers to itself, and the collector would look through all windows time and again.
        gc.disable()
        none = np.zeros(0, np.int64)
        for batch in batches:
            n_a, n_b, groups, pairs, times = [], [], [], [], []
            for part in _parts([t or "" for t in batch.column(1).to_pylist()], AT_ONCE):
                a_lists, b_lists = aligner.tokenise(part)
                for t, a_ids, b_ids, found in zip(part, a_lists, b_lists, aligner.align(part, a_lists, b_lists)):
                    found = found if t else None
                    n_a.append(len(a_ids) if found else 0)
                    n_b.append(len(b_ids) if found else 0)
                    groups.append(found.groups if found else "")
                    which, often = np.unique(np.frombuffer(found.pairs, np.int64), return_counts=True) if found else (none, none)
                    pairs.append(which)
                    times.append(often)
            ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            columns = [
                batch.column(0),
                pa.array(n_a, pa.int64()),
                pa.array(n_b, pa.int64()),
                pa.array(groups, pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *pairs]), pa.int64())),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([none, *times]), pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "groups", "pairs", "times"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_a bigint, n_b bigint, groups string, pairs array<bigint>, times array<bigint>"
    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): how many links of the whole corpus hold each pair, and whether none of the B id's pairs has more."""
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = counts.select(F.shiftright("pair", SHIFT).alias("a_id"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b_id"), "n")
    # One row per id of B, at most the vocabulary.
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, bound: int) -> DataFrame:
    """Adds n_links, n_best and count_sum to rows of `align`: links in all, those whose pair is `best`, and the sum of `n` over them.

    `counts` is what `pair_counts` found in a corpus that has all the pairs; it may have at most `bound` rows, which `most_pairs` gives, and
    goes to all tasks.
    """
    spark = aligned.sparkSession
    table = counts.select((F.shiftleft(F.col("a_id"), SHIFT).bitwiseOR(F.col("b_id"))).alias("pair"), "n", "best").limit(bound + 1).toArrow()
    if table.num_rows > bound:
        raise ValueError(f"more than the {bound} pairs that the vocabularies allow")
    columns = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    order = np.argsort(columns[0])
    shared = spark.sparkContext.broadcast(tuple(c[order] for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            at = np.searchsorted(known, lists.flatten().to_numpy())
            often = times.flatten().to_numpy()
            sums = [
                np.concatenate([[0], np.cumsum(x)]) for x in (often, often * best[at] if len(known) else often, often * n[at] if len(known) else often)
            ]
            added = [pa.array(s[ends[1:]] - s[ends[:-1]], pa.int64()) for s in sums]
            names = [*batch.schema.names, "n_links", "n_best", "count_sum"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    schema = ", ".join(f"`{c}` {kind}" for c, kind in [*aligned.dtypes, *((c, "bigint") for c in ("n_links", "n_best", "count_sum"))])
    return aligned.mapInArrow(run, schema)
