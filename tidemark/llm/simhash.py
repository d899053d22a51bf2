"""Near copies by SimHash: one fingerprint of 64 bits per text, linked within a Hamming distance.

Of `radius` + 1 blocks of a fingerprint, one is untouched when at most `radius` bits differ. So the
distinct fingerprints are dealt to shards, one per block and value of the block, and linked ones meet
in a shard. Each shard is a BK-tree: a node's children are keyed by their integer distance to it, and
a search within the radius follows only the edges that the triangle inequality allows. A shard's tree
goes to the task that holds the shard's queries; sending the trees to all tasks would send all
fingerprints to each, which has no bound. A shard larger than `shard_size` is dealt again by blocks of the
bits that it doesn't share yet, so no task gets a group without bound.

A shard answers with a link to one representative per local component, not with all pairs.

Near copies by similarity (`similar`) need more than a fingerprint: at 0.8 two of them differ in 4 to over 14 bits, and
so do those of texts at 0.6. Texts with linked fingerprints are a shard. For the pairs that are farther apart, texts are dealt
to further shards by pairs of minima of their shingles' hashes: two texts with a
similarity of s share one pair with a probability of s * s, and one of `BANDS` with 1 - (1 - s * s) ** BANDS, 0.9997 for
0.8. An edge is one whose two sets of shingle hashes have the similarity, counted exactly. Pairs that edges connect
already aren't compared. A shard is cut to tiles of bounded size, so no task gets a group without bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, spread, stored, unused
from tidemark.llm.components import components
from tidemark.llm.weighted_sampling import _mix
from tidemark.session import runs_on_executors

runs_on_executors(__name__)

SEED = 42
WORDS = 3
RADIUS = 2
SHARD_SIZE = 20_000
WIDE_WORDS, BANDS = 5, 8
# Four fifths: a quotient of whole numbers, so that a pair on the edge is neither lost nor found by rounding.
SIMILARITY = (4, 5)
PIECE, TILE = 500, 1 << 20


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z count as a-z, words are separated by ASCII white space.

    A text of fewer words is one shingle, one without words, null and empty too, has none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), seed)]
    else:
        # All words joined once; a shingle is a slice from a word's start to a later word's end.
        joined = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found])
        starts = [0, *(ends[:-words]).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; zero for no hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    table = hashes.astype(">u8")
    # In slices, so that long texts need no more memory than short ones.
    for i in range(0, len(table), 1 << 16):
        part = table[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(table)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The majority of a text's shingles; zero for texts without words."""
    return majority(shingle_hashes(text, words, seed))


def bands(hashes: np.ndarray, n: int = BANDS) -> list[int]:
    """`n` numbers, each made of two minima over the shingles' hashes; all zero for no hashes.

    Each minimum mixes the hashes fully under a seed of its own, so that no shingle is the smallest of many at once.
    """
    if not len(hashes):
        return [0] * n
    least = [int(_mix(hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)).min()) for k in range(2 * n)]
    return [_signed(xxhash.xxh64_intdigest(b"%d:%d" % (least[2 * i], least[2 * i + 1]), i)) for i in range(n)]


def set_number(hashes: np.ndarray) -> int:
    """A number for a sorted set of hashes; zero for no hashes."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)) if len(hashes) else 0


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) per row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


class BKTree:
    """Integers of 64 bits under the Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The value's node, new unless the value is there already."""
        values, children = self.values, self.children
        if not values:
            values.append(value)
            children.append({})
            return 0
        node = 0
        while True:
            distance = (values[node] ^ value).bit_count()
            if distance == 0:
                return node
            below = children[node].get(distance)
            if below is None:
                children[node][distance] = len(values)
                values.append(value)
                children.append({})
                return len(values) - 1
            node = below

    def within(self, value: int, radius: int) -> list[int]:
        """The nodes at `radius` or less from the value."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            for edge, below in self.children[node].items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(below)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, representative) for the values of a shard that have another one within the radius."""
    tree = BKTree()
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        near = tree.within(value, radius)
        node = tree.add(value)
        if node == len(parent):
            parent.append(node)
        for other in near:
            parent[root(other)] = root(node)
    out = [(tree.values[i], tree.values[root(i)]) for i in range(len(parent))]
    return [(a, b) for a, b in out if a != b]


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [part.tolist() for part in np.array_split(np.array(bits), n)]


def _links_of_shards(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; one shard is held at a time."""

    def answer(values: list[int]) -> pa.RecordBatch:
        links = shard_links([v & 0xFFFFFFFFFFFFFFFF for v in values], radius) if len(values) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([_signed(x[i]) for x in links], pa.int64()) for i in range(2)], names=["a", "b"]
        )

    shard, values = None, []
    for batch in batches:
        keys, fps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for key, fp in zip(keys, fps):
            if key != shard:
                if len(values) > 1:
                    yield answer(values)
                shard, values = key, []
            values.append(fp)
    if len(values) > 1:
        yield answer(values)


def links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Edges (a, b) that connect the fingerprints `fp` at `radius` or fewer bits from each other."""
    spark = distinct.sparkSession
    todo = [(distinct.select("fp", F.lit("").alias("shard")), list(range(64)))]
    edges = None
    while todo:
        rows, bits = todo.pop()
        parts = _blocks(bits, radius + 1)
        choices = F.array(
            *(
                F.concat_ws(
                    ".",
                    "shard",
                    F.lit(str(i)),
                    F.hex(F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in part))))),
                )
                for i, part in enumerate(parts)
            )
        )
        dealt, _ = stored(rows.select("fp", F.posexplode(choices).alias("block", "shard")), "shards")
        rest = min(len(bits) - len(part) for part in parts)

        if rest >= 3 * (radius + 1):
            crowded, _ = stored(
                dealt.groupBy("block", "shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_size), "crowded"
            )
            large = crowded.select(F.col("block").alias("its_block"), F.col("shard").alias("its_shard"))
            on = (F.col("block") == F.col("its_block")) & (F.col("shard") == F.col("its_shard"))
            for (block,) in crowded.select("block").distinct().collect():
                again = dealt.where(F.col("block") == block).join(large, on, "left_semi")
                left_bits = sorted(set(bits) - set(parts[block]))
                todo.append((again.select("fp", "shard"), left_bits))
            dealt = dealt.join(large, on, "left_anti")
        n = spread(spark)
        some = (
            dealt.select("shard", "fp")
            .repartition(n, "shard")
            .sortWithinPartitions("shard")
            .mapInArrow(lambda batches: _links_of_shards(batches, radius), "a bigint, b bigint")
        )
        edges = some if edges is None else edges.unionByName(some)
    return edges


def near_copies(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """One row per document: (doc_id, fp, component_id).

    `component_id` is the smallest doc_id that is reachable over links between fingerprints, the own
    one included. Null, empty and blank texts share the fingerprint zero, and so a component. Equal
    fingerprints are one node, so a group of copies of any size is one row here; rows that repeat a
    doc_id are kept. A null doc_id is smaller than none: a component of such rows only has a null id.
    """
    fps, _ = stored(fingerprints(documents, doc_id, text, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    nodes, nodes_path = stored(nodes, "nodes")
    roots = components(links(nodes.select("fp"), radius, shard_size))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first_id"
    )
    rooted, rooted_path = stored(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named, _ = stored(rooted.join(least, "root").select("fp", "component_id"), "named")
    for path in (nodes_path, rooted_path):
        discard(documents.sparkSession, path)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def similar(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = WIDE_WORDS,
    similarity: tuple[int, int] = SIMILARITY,
    n_bands: int = BANDS,
    tile: int = TILE,
) -> DataFrame:
    """(doc_id, content, group) per row: which texts are near copies by the exact similarity of their shingles.

    `content` is a hash of the text, by which rows of equal ids are told apart. `group` is a number that the members
    share; all texts without words are one group. Texts with the same set of shingles are one node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, fps = [], [], [], []
            for t in batch.column(2):
                t = t.as_py()
                hashes = np.unique(shingle_hashes(t, words))
                fps.append(_signed(fingerprint(t)))
                nodes.append(set_number(hashes))
                sizes.append(len(hashes))
                keys.append(bands(hashes, n_bands) if len(hashes) else [])
            columns = [*(pa.array(x, pa.int64()) for x in (nodes, sizes, fps)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], names=["doc_id", "content", "node", "n_shingles", "fp", "bands"]
            )

    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    seen, _ = stored(
        rows.mapInArrow(run, f"doc_id {kind}, content bigint, node bigint, n_shingles bigint, fp bigint, bands array<bigint>"),
        "similar",
    )
    # Texts whose fingerprints are linked share a shard, and so do those that share a band.
    nodes = seen.where("n_shingles > 0").select("node", "n_shingles", "fp").distinct()
    near, near_path = stored(components(links(nodes.select("fp").distinct())), "near")
    linked = _rooted(nodes, near, "fp", "key").select("node", "n_shingles", F.lit(-1).alias("band"), "key")
    dealt = seen.select("node", "n_shingles", F.posexplode("bands").alias("band", "key")).unionByName(linked).distinct()
    # A shard of one node links nothing.
    shared = dealt.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    dealt, dealt_path = stored(
        dealt.join(shared, ["band", "key"]).select(
            F.concat_ws(".", "band", "key").alias("shard"), "node", "n_shingles", "n", "pivot"
        ),
        "dealt",
    )
    sets, sets_path = stored(_shingle_sets(rows, seen, dealt.select("node").distinct(), words), "sets")

    # Everyone is compared with one of its shards' smallest nodes, then with the others that it isn't connected with yet;
    # a group of copies of any size mostly ends here.
    pieces = F.ceil(F.col("n") / PIECE).alias("pieces")
    pairs = dealt.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"), pieces)
    pairs, pairs_path = stored(pairs.groupBy("a", "b").agg(F.max("pieces").alias("pieces")), "pairs")
    least = pairs.groupBy("a").agg(F.min(F.struct("b", "pieces")).alias("first")).select("a", "first.*")
    edges, edges_path = stored(_alike(least, sets, similarity), "alike")
    roots = components(edges)
    apart = _rooted(_rooted(pairs, roots, "a", "root_a"), roots, "b", "root_b").where("root_a <> root_b")
    more, more_path = stored(_alike(apart.select("a", "b", "pieces"), sets, similarity), "alike")
    edges = edges.unionByName(more)
    roots = components(edges)

    # What a shard's smallest node doesn't connect is compared with all of the shard that has another root.
    members, members_path = stored(
        _rooted(dealt.where("n > 2 and node <> pivot"), roots, "node", "root").select("shard", "node", "n_shingles", "root"),
        "members",
    )
    edges = edges.unionByName(_joined_tiles(_tiles(members, tile), sets, similarity))
    roots = components(edges)
    for path in (near_path, dealt_path, sets_path, pairs_path, edges_path, more_path, members_path):
        discard(spark, path)
    return seen.join(roots, "node", "left").select("doc_id", "content", F.coalesce("root", "node").alias("group"))


def _shingle_sets(rows: DataFrame, seen: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) for the wanted nodes, from the text of one row of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content")
    first = seen.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(order).alias("first"))
    first = first.select("node", F.col("first.doc_id").alias("its_id"), F.col("first.content").alias("its_content"))
    texts = rows.join(first, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("content") == F.col("its_content")))
    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def _rooted(table: DataFrame, roots: DataFrame, column: str, to: str) -> DataFrame:
    """The table with the root of a column's node, which is the node itself if it has no edge."""
    its = roots.select(F.col("node").alias("its_node"), F.col("root").alias("its_root"))
    return table.join(its, F.col(column) == F.col("its_node"), "left").select(
        *table.columns, F.coalesce("its_root", column).alias(to)
    )


def _alike(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those (a, b) of (a, b, pieces) whose sets have the similarity or more; a `b` of many pairs is dealt in pieces."""
    above, below = similarity
    left = pairs.join(sets, F.col("a") == F.col("node")).select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("pieces")).alias("piece"), F.col("shingles").alias("of_a")
    )
    right = (
        pairs.groupBy("b")
        .agg(F.max("pieces").alias("pieces"))
        .join(sets, F.col("b") == F.col("node"))
        .select("b", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("shingles").alias("of_b"))
    )
    common = F.size(F.array_intersect("of_a", "of_b"))
    both = F.size("of_a") + F.size("of_b")
    return left.join(right, ["b", "piece"]).where(common * (above + below) >= both * above).select("a", "b")


def _tiles(members: DataFrame, tile: int) -> DataFrame:
    """(tile, apart, node, root) from (shard, node, n_shingles, root): two members of different roots meet in a tile.

    The members of a shard's largest root needn't be compared with each other; the others are `apart` and are compared
    with everyone. Both sides are cut by hash to parts of about `tile` shingles, and each two parts are a tile.
    """
    weights = members.groupBy("shard", "root").agg(F.sum("n_shingles").alias("weight"))
    largest = F.max(F.struct("weight", "root")).alias("largest")
    mixed = weights.groupBy("shard").agg(F.count("*").alias("n_roots"), F.sum("weight").alias("total"), largest)
    mixed = mixed.where("n_roots > 1").select(
        F.col("shard").alias("its_shard"),
        F.col("largest.root").alias("main"),
        F.ceil(F.col("total") / tile).alias("across"),
        F.ceil((F.col("total") - F.col("largest.weight")) / tile).alias("down"),
    )
    rows = members.join(mixed, F.col("shard") == F.col("its_shard"))
    x, y = (F.pmod(F.xxhash64("node", F.lit(name)), F.col(name)) for name in ("across", "down"))
    key = lambda y, x: F.concat_ws(".", "shard", y, x).alias("tile")
    whole = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("down") - 1)))
    apart = rows.where("root <> main").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("across") - 1)))
    whole = whole.select(key("y", x), F.lit(False).alias("apart"), "node", "root")
    return whole.unionByName(apart.select(key(y, "x"), F.lit(True).alias("apart"), "node", "root"))


def _joined_tiles(tiles: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between the roots of (tile, apart, node, root) that are alike and meet in a tile."""
    return (
        tiles.join(sets, "node")
        .select("tile", "apart", "root", "shingles")
        .repartition(spread(tiles.sparkSession), "tile")
        .sortWithinPartitions("tile")
        .mapInArrow(lambda batches: _links_of_tiles(batches, similarity), "a bigint, b bigint")
    )


def _links_of_tiles(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; one tile is held at a time."""

    def answer(held: list) -> pa.RecordBatch:
        apart, roots, sizes = (np.concatenate([h[i] for h in held]) for i in range(3))
        links = tile_links(apart, roots, sizes, np.concatenate([h[3] for h in held]), similarity)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])

    tile, held = None, []
    for batch in batches:
        keys = np.array(batch.column(0).to_pylist(), object)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for i, j in zip(cuts, cuts[1:]):
            if keys[i] != tile:
                if held:
                    yield answer(held)
                tile, held = keys[i], []
            part = batch.slice(i, j - i)
            held.append(
                (
                    part.column(1).to_numpy(zero_copy_only=False),
                    part.column(2).to_numpy(),
                    part.column(3).value_lengths().to_numpy(),
                    part.column(3).flatten().to_numpy(),
                )
            )
    if held:
        yield answer(held)


def tile_links(
    apart: np.ndarray, roots: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, similarity: tuple[int, int] = SIMILARITY
) -> list[tuple[int, int]]:
    """Pairs of roots that connect the sets `apart` with the others that they have the similarity or more with.

    The sets lie one after the other in `shingles`. A pair that the ones before it connect is left out.
    """
    above, below = similarity
    codes = np.unique(shingles, return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mine = np.repeat(apart, sizes)
    others, other_sizes, other_roots = codes[~mine], sizes[~apart], roots[~apart]
    if not len(other_sizes):
        return []
    other_starts = np.cumsum(other_sizes) - other_sizes
    marked = np.zeros(len(shingles), bool)
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (above_it := parent.get(x, x)) != x:
            parent[x] = parent.get(above_it, above_it)
            x = above_it
        return x

    links = []
    for i in np.flatnonzero(apart).tolist():
        own = codes[starts[i] : starts[i] + sizes[i]]
        marked[own] = True
        common = np.add.reduceat(marked[others], other_starts, dtype=np.int64)
        marked[own] = False
        near = common * (above + below) >= (other_sizes.astype(np.int64) + int(sizes[i])) * above
        for other in np.unique(other_roots[near]).tolist():
            a, b = int(roots[i]), other
            if top(a) != top(b):
                parent[top(a)] = top(b)
                links.append((a, b))
    return links


def one_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without their near copies: of each group the row with the smallest id, then content, stays.

    Rows that are equal in id and text stay as one, too. A row without an id stays only if none of its group has one.
    """
    found = similar(documents, doc_id, text, **options)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content")
    first = found.groupBy("group").agg(F.min(order).alias("first"))
    key, content = unused("kept_id", documents.columns), unused("kept_content", documents.columns)
    first, _ = stored(first.select(F.col("first.doc_id").alias(key), F.col("first.content").alias(content)), "kept")
    kept = documents.join(
        first, documents[doc_id].eqNullSafe(first[key]) & (F.xxhash64(documents[text]) == first[content]), "left_semi"
    )
    return kept.dropDuplicates([doc_id, text])
