"""Removal of byte strings of `LENGTH` bytes that occur twice, found by sorting suffixes.

A window is `LENGTH` neighbouring bytes. The window's anchor is the place of the smallest hash of `GRAM` bytes in it, the
first of equal ones; equal windows have their anchors at equal places, so only windows around equal anchors are compared. The windows
of one anchor are a run of neighbouring starts. It is halved by the anchor's place in the window: each half's windows share at least
`SHARED` bytes around the anchor, whose hash is the half's key. What Spark then does:

1. One pass over the documents gives a row per half run: its key and a hash of the bytes that its windows span.
2. Halves that span equal bytes are counted. Two or more repeat each other in all windows.
3. Different halves with one key may share some windows. One of each kind goes, with its bytes, to its key's task.
   There the windows are sorted as suffixes cut at `LENGTH`: by a multikey quicksort of eight bytes at a step to a depth of `SHALLOW`,
   which leaves out what is alone; a blind trie orders each group that still agrees.
4. A key with more than `MOST` kinds isn't gathered. Its runs are halved by the anchor's place in the window, again and again: the
   windows of a smaller run share more bytes, whose hash is a finer key, and kinds that differ elsewhere become equal there.
   So steps 2 and 3 deal with the parts. A run of one window is its shared bytes, so that this ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import discard, spread, stored
from tidemark.session import runs_on_executors

runs_on_executors(__name__)

LENGTH, GRAM = 400, 32
SHALLOW, MOST = 64, 1_000
# Bytes hashed at a time, and windows sorted at a time.
BLOCK, SORTED = 1 << 20, 200_000
UNITS = "key bigint, kind bigint, start bigint, n int, place int"


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on, `gram` a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    size = 1
    while size < gram:
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _first_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of `width` numbers from each place on, the first of equal ones."""
    def better(a, b):
        return np.where(h[a] <= h[b], a, b)

    at, size = np.arange(len(h)), 1
    while size * 2 <= width:
        at = better(at[:-size], at[size:])
        size *= 2
    return better(at[: len(h) - width + 1], at[width - size :]) if size < width else at


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(first start, last start, anchor) of the windows of each anchor, in order.

    A long text is worked on in blocks; a run that crosses the edge of a block is two.
    """
    last = len(data) - length
    for at in range(0, last + 1, BLOCK):
        part = data[at : min(at + BLOCK, last + 1) + length - 1]
        anchors = _first_minima(_gram_hashes(part, gram), length - gram + 1)
        first = np.flatnonzero(np.diff(anchors, prepend=-1))
        final = np.append(first[1:] - 1, len(anchors) - 1)
        yield from zip((first + at).tolist(), (final + at).tolist(), (anchors[first] + at).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def halves(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """(key, kind, first start, number of windows, anchor's place in the first window) per half run."""
    if len(text) < length:
        return
    half = (length - gram) // 2
    digest = xxhash.xxh64_intdigest
    for first, final, anchor in runs(np.frombuffer(text, np.uint8), length, gram):
        middle = anchor - half  # starts up to here see `half` bytes before the anchor
        for begin, end, side in ((first, min(final, middle), 1), (max(first, middle + 1), final, 2)):
            if begin <= end:
                shared = text[anchor - half : anchor + gram] if side == 1 else text[anchor : anchor + length - half + 1]
                spanned = digest(text[begin : end + length], anchor - begin)
                yield _signed(digest(shared, side)), _signed(spanned), begin, end - begin + 1, anchor - begin


class BlindTrie:
    """Strings of one length, told apart by the first byte in which they differ; equal ones share a leaf."""

    def __init__(self, first: bytes, number: int):
        # A leaf is (string, numbers); an inner node is [depth, children by the byte there].
        self.root: list | tuple = (first, [number])

    def add(self, text: bytes, number: int) -> None:
        node = self.root
        # Down without looking at the bytes in between.
        while isinstance(node, list):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[0]
        if other == text:
            node[1].append(number)
            return
        low, high = 0, len(text)  # text[:low] is shared, text[:high] is not
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if text[low:mid] == other[low:mid] else (low, mid)
        above, node = None, self.root
        while isinstance(node, list) and node[0] < low:
            above, node = node, node[1][text[node[0]]]
        leaf = (text, [number])
        if isinstance(node, list) and node[0] == low:
            node[1][text[low]] = leaf
            return
        new = [low, {other[low]: node, text[low]: leaf}]
        if above is None:
            self.root = new
        else:
            above[1][text[above[0]]] = new

    def leaves(self) -> Iterator[tuple[bytes, list[int]]]:
        """In order of the strings."""
        todo = [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                yield node
            else:
                todo.extend(child for _, child in sorted(node[1].items(), reverse=True))


def repeated(buffer: bytes, starts: np.ndarray, groups: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Which of the windows at `starts` have an equal one in their group."""
    found = np.zeros(len(starts), bool)
    raw = np.frombuffer(buffer + bytes(8), np.uint8).astype(np.uint64)
    words = np.zeros(len(buffer), np.uint64)
    for i in range(8):
        words |= raw[i : i + len(buffer)] << np.uint64(56 - 8 * i)
    rows, group = np.arange(len(starts)), groups

    def shared(sorted_group):
        same = sorted_group[1:] == sorted_group[:-1]
        return np.append(False, same) | np.append(same, False)

    order = np.argsort(group, kind="stable")
    rows, group = rows[order], group[order]
    keep = shared(group)
    rows, group = rows[keep], group[keep]
    for depth in range(0, min(shallow, length - 7), 8):
        if not len(rows):
            return found
        word = words[starts[rows] + depth]
        order = np.lexsort((word, group))
        rows, group, word = rows[order], group[order], word[order]
        group = np.cumsum(np.append(False, (group[1:] != group[:-1]) | (word[1:] != word[:-1])))
        keep = shared(group)
        rows, group = rows[keep], group[keep]
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)) if len(rows) else np.zeros(0, np.int64)
    places = starts[rows].tolist()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        trie = BlindTrie(buffer[places[a] : places[a] + length], a)
        for i in range(a + 1, b):
            trie.add(buffer[places[i] : places[i] + length], i)
        for _, numbers in trie.leaves():
            if len(numbers) > 1:
                found[rows[numbers]] = True
    return found


def _ranges(places: list[int]) -> list[dict]:
    """Neighbouring numbers of a sorted list as ranges."""
    out = []
    for p in places:
        if out and out[-1]["until"] == p - 1:
            out[-1]["until"] = p
        else:
            out.append({"since": p, "until": p})
    return out


FOUND = "key bigint, kind bigint, ranges array<struct<since:int,until:int>>"
RANGE = pa.struct([("since", pa.int32()), ("until", pa.int32())])
FOUND_ARROW = pa.schema([("key", pa.int64()), ("kind", pa.int64()), ("ranges", pa.list_(RANGE))])


def _sorted_keys(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, place, bytes) come sorted by key; whole keys are sorted together."""
    def answer(held: list[tuple]) -> pa.RecordBatch:
        buffer = b"".join(r[3] for r in held)
        sizes = np.array([len(r[3]) for r in held])
        counts = sizes - length + 1
        which = np.repeat(np.arange(len(held)), counts)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
        _, keys = np.unique(np.array([r[0] for r in held]), return_inverse=True)
        # Equal windows have their anchors at equal places: the first thing to sort by.
        groups = keys[which] * length + np.array([r[2] for r in held])[which] - offset
        hit = np.flatnonzero(repeated(buffer, starts, groups, length))
        out = [
            {"key": held[i][0], "kind": held[i][1], "ranges": _ranges(part.tolist())}
            for i, part in zip(
                np.unique(which[hit]).tolist(),
                np.split(offset[hit], np.flatnonzero(np.diff(which[hit])) + 1) if len(hit) else [],
            )
        ]
        return pa.RecordBatch.from_pylist(out, schema=FOUND_ARROW)

    held, windows = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if windows > SORTED and row[0] != held[-1][0]:
                yield answer(held)
                held, windows = [], 0
            held.append(row)
            windows += len(row[3]) - length + 1
    if held:
        yield answer(held)


CELL = "key bigint, kind bigint, place int, first int, bytes binary, finer bigint, low int, high int"


def _cells(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Halves each row's range `low` to `high` of the anchor's place in a window, and its bytes by that; see `_in_cells`."""
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            data, place, middle = r["bytes"], r["place"], (r["low"] + r["high"]) // 2
            for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                most, least = min(high, place), max(low, place - len(data) + length)
                if least <= most:
                    part = data[place - most : place - least + length]
                    shared = data[place - low : place - high + length]
                    out.append(
                        {
                            **r,
                            "place": most,
                            "first": r["first"] + place - most,
                            "bytes": part,
                            "finer": _signed(digest(b"%d:%d:" % (r["finer"], low) + shared)),
                            "sub": _signed(digest(part, most)),
                            "low": low,
                            "high": high,
                        }
                    )
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _in_cells(crowded: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(key, kind, ranges) of keys with more than `most` kinds, given their (key, kind, place, bytes).

    A cell is a range of the anchor's place in the window. In a round each run is cut by the halves of its cell; what all
    windows of the half share is hashed to `finer`, and what the run spans to `sub`. Equal ones of two kinds repeat each other, and
    one of each goes on: to its task if `finer` has up to `most`, else to the next round. Rounds are as many as halvings.
    """
    spark = crowded.sparkSession
    half = (length - gram) // 2
    side = F.col("place") >= half
    todo = crowded.select(
        "key",
        "kind",
        "place",
        F.lit(0).alias("first"),
        "bytes",
        F.col("key").alias("finer"),
        F.when(side, half).otherwise(0).alias("low"),
        F.when(side, length - gram).otherwise(half - 1).alias("high"),
    )
    shape = T.StructType.fromDDL(CELL + ", sub bigint")
    schema = to_arrow_schema(shape)
    found = spark.createDataFrame([], FOUND)
    while not todo.isEmpty():
        cells, _ = stored(todo.mapInArrow(lambda batches: _cells(batches, length, schema), shape), "cells")
        one = F.min(F.struct("key", "kind", "place", "first", "bytes", "low", "high")).alias("one")
        subs, _ = stored(cells.groupBy("finer", "sub").agg(F.count("*").alias("copies"), one), "subs")
        until = F.col("first") + F.octet_length("bytes") - length
        whole = cells.join(subs.where("copies > 1").select("finer", "sub"), ["finer", "sub"], "left_semi").select(
            "key", "kind", F.array(F.struct(F.col("first").alias("since"), until.alias("until"))).alias("ranges")
        )
        crowd = subs.groupBy("finer").agg(F.count("*").alias("kinds")).where("kinds > 1")
        apart, _ = stored(subs.join(crowd, "finer").select("finer", "sub", "copies", "one.*", "kinds"), "apart")
        few = apart.where(F.col("kinds") <= most)
        sorted_cells = (
            few.select(F.col("finer").alias("key"), F.col("sub").alias("kind"), "place", "bytes")
            .repartition(spread(spark), "key")
            .sortWithinPartitions("key")
            .mapInArrow(lambda batches: _sorted_keys(batches, length), FOUND)
            .select(F.col("key").alias("finer"), F.col("kind").alias("sub"), "ranges")
        )
        shifted = F.transform("ranges", lambda r: F.struct((F.col("first") + r["since"]).alias("since"), (F.col("first") + r["until"]).alias("until")))
        partly = few.where("copies = 1").join(sorted_cells, ["finer", "sub"]).select("key", "kind", shifted.alias("ranges"))
        found = found.unionByName(whole).unionByName(partly)
        todo = apart.where(F.col("kinds") > most).select("key", "kind", "place", "first", "bytes", "finer", "low", "high")
    return found


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(doc_id, content, ranges) of the texts with windows that also start elsewhere, as ranges of starts.

    `content` is a hash of the text, which tells rows of one id apart; rows that repeat id and text are copies of each
    other. Texts below `length` bytes and nulls have no window.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    rows = rows.where(F.octet_length("text") >= length)
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(halves(batch.column(2)[i].as_py().encode("utf-8", "replace"), length, gram))
                same = pa.array(np.full(len(found), i))
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(same),
                        batch.column(1).take(same),
                        *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))),
                    ],
                    names=["doc_id", "content", "key", "kind", "start", "n", "place"],
                )

    units, units_path = stored(rows.mapInArrow(cut, f"doc_id {kind}, content bigint, {UNITS}"), "units")
    one = F.min(F.struct("doc_id", "content", "start", "n", "place")).alias("one")
    kinds, kinds_path = stored(units.groupBy("key", "kind").agg(F.count("*").alias("copies"), one), "kinds")
    crowd = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    apart = kinds.join(crowd, "key")
    wanted = apart.groupBy(F.col("one.doc_id").alias("its_id"), F.col("one.content").alias("its_content")).agg(
        F.collect_list(F.struct("key", "kind", "one.start", "one.n", "one.place", "kinds")).alias("wanted")
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, asked in zip(batch.column(0), batch.column(1)):
                data = words.as_py().encode("utf-8", "replace")
                out = [
                    {
                        "key": u["key"],
                        "kind": u["kind"],
                        "place": u["place"],
                        "bytes": data[u["start"] : u["start"] + u["n"] + length - 1],
                        "kinds": u["kinds"],
                    }
                    for u in asked.as_py()
                ]
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_pylist(out[i : i + 10_000], schema=fetched)

    shape = T.StructType.fromDDL("key bigint, kind bigint, place int, bytes binary, kinds bigint")
    fetched = to_arrow_schema(shape)
    # Rows that repeat id and text would be fetched twice.
    pieces = (
        rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["its_id"]) & (rows["content"] == wanted["its_content"]))
        .select("text", "wanted")
        .mapInArrow(fetch, shape)
    )
    pieces, pieces_path = stored(pieces, "pieces")
    by_sort = (
        pieces.where(F.col("kinds") <= most)
        .dropDuplicates(["key", "kind"])
        .select("key", "kind", "place", "bytes")
        .repartition(spread(spark), "key")
        .sortWithinPartitions("key")
        .mapInArrow(lambda batches: _sorted_keys(batches, length), FOUND)
    )

    by_cells = _in_cells(
        pieces.where(F.col("kinds") > most).dropDuplicates(["key", "kind"]).select("key", "kind", "place", "bytes"), length, gram, most
    )
    partly = by_sort.unionByName(by_cells)
    whole = kinds.where("copies > 1").select(
        "key", "kind", F.array(F.struct(F.lit(0).alias("since"), (F.col("one.n") - 1).alias("until"))).alias("ranges")
    )
    alone = kinds.where("copies = 1").select("key", "kind")
    found, _ = stored(whole.unionByName(partly.join(alone, ["key", "kind"], "left_semi")), "repeated")
    shifted = F.transform("ranges", lambda r: F.struct((F.col("start") + r["since"]).alias("since"), (F.col("start") + r["until"]).alias("until")))
    out, _ = stored(
        units.join(found, ["key", "kind"])
        .select("doc_id", "content", F.explode(shifted).alias("r"))
        .groupBy("doc_id", "content")
        .agg(F.array_sort(F.collect_set("r")).alias("ranges")),
        "ranges",
    )
    for path in (units_path, kinds_path, pieces_path):
        discard(spark, path)
    return out


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: the bytes that stay, and the maximal runs (begin, end) of those that go.

    A byte goes if a string of `length` bytes over it also starts elsewhere in the documents, the same text included; strings
    are judged on the whole input. `kept` is binary, as a cut may split a character. Null counts as empty.
    """
    found = repeats(documents, doc_id, text, length, **options)
    found = found.select(F.col("doc_id").alias("its_id"), F.col("content").alias("its_content"), "ranges")
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, words, starts in zip(*batch.columns):
                data = (words.as_py() or "").encode("utf-8", "replace")
                spans = []
                for r in starts.as_py() or ():
                    begin, end = r["since"], r["until"] + length
                    if spans and begin <= spans[-1]["end"]:
                        spans[-1]["end"] = max(end, spans[-1]["end"])
                    else:
                        spans.append({"begin": begin, "end": end})
                edges = [0, *(x for s in spans for x in (s["begin"], s["end"])), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append({"doc_id": key.as_py(), "n_bytes": len(data), "spans": spans, "kept": kept})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    shape = T.StructType.fromDDL(
        f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    )
    schema = to_arrow_schema(shape)
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["its_id"]) & (rows["content"] == found["its_content"]), "left")
    return joined.select(rows["doc_id"], "text", "ranges").mapInArrow(remove, shape)
