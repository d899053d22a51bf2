"""Ranked lexical search over an index whose documents are grouped by length.

A term found tf times in a document of n terms has the impact (10^9 tf) div (1000 tf + 20 m), where the normaliser m depends on
n alone. Documents of one m are a stratum; a large stratum is several blocks. Within a block a term's postings are grouped by tf, so
that an impact is computed once per tf and holds for all documents of the group.

The largest tf of each term bounds what a block's documents can score for a query. The blocks of the highest bounds are visited
first; the k-th score found there rules out the blocks whose bound is below it, and the rest are visited in order of their bounds. All
documents are indexed, and what is left out can't be among the first k.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from tidemark.llm.common import discard, spread, stored
from tidemark.session import runs_on_executors, work_path

runs_on_executors(__name__)

# Documents in a block.
BLOCK = 4_096
# A query looks at so many documents of the highest bounds before it rules out others.
FIRST = 2_000
# Pairs of query and term that go to all tasks at once; more queries than that are searched in turns.
PAIRS_AT_ONCE = 1_000_000

# Bytes of UTF-8 to term bytes: 0-9, a-z and all above 0x7F are themselves, A-Z lower-cased, the rest is white space.
_TERM_BYTES = bytes(c if c > 0x7F else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


class Index(NamedTuple):
    """Where an index is, how many documents with a term it has, and how many terms those have with repeats."""

    path: str
    documents: int
    terms: int


def term_counts(text: str | None) -> Counter:
    """How often each term, as UTF-8, is in a text."""
    return Counter((text or "").encode().translate(_TERM_BYTES).split())


def vectors(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of the rows with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, n, sizes, terms, tfs = [], [], [0], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                counts = term_counts(t)
                if counts:
                    keep.append(i)
                    n.append(counts.total())
                    sizes.append(len(counts))
                    terms.extend(counts)
                    tfs.extend(counts.values())
            ends = pa.array(np.cumsum(sizes), pa.int32())
            columns = [
                batch.column(0).take(pa.array(keep, pa.int32())),
                pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())),
                pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    rows = rows.select(F.col(row_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n bigint, terms array<string>, tfs array<int>")


def impact(tf: Column | np.ndarray, m: Column | int):
    """Whole numbers, rounded down."""
    if isinstance(tf, np.ndarray):
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)
    tf = tf.cast("long")
    return F.call_function("div", tf * 1_000_000_000, tf * 1000 + m * 20)


def _index_schema(doc_type: pa.DataType) -> pa.Schema:
    """A row without a term has the block's documents in order; the others hold places in that list, the largest tf first."""
    whole = pa.list_(pa.int32())
    return pa.schema(
        [("m", pa.int64()), ("block", pa.int64()), ("term", pa.string()), ("n_docs", pa.int32()), ("max_tf", pa.int32()),
         ("tfs", whole), ("ends", whole), ("places", whole), ("docs", pa.list_(doc_type))]
    )


def _block_rows(m: int, block: int, parts: list[pa.RecordBatch], schema: pa.Schema) -> pa.RecordBatch:
    """The index rows of a block's documents (doc_id, terms, tfs)."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    docs, lists = rows.column("doc_id").combine_chunks(), rows.column("terms").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    coded = lists.flatten().dictionary_encode()
    term = coded.indices.to_numpy()
    tf = rows.column("tfs").combine_chunks().flatten().to_numpy()
    place = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    first = np.flatnonzero(np.diff(term, prepend=-1))  # of each term
    group = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(tf, prepend=-1) != 0))  # of each term and tf
    after = np.append(group[1:], len(term))
    n_docs = np.diff(np.append(first, len(term))).astype(np.int32)
    groups = np.append(np.searchsorted(group, first), len(group)).astype(np.int32)
    starts = np.repeat(first, np.diff(groups))
    n = len(first)
    # One row more than terms: that of the documents.
    lists_of = lambda ends, values: pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32())
    )
    none = lambda kind: pa.nulls(1, kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, m), pa.int64()),
            pa.array(np.full(n + 1, block), pa.int64()),
            pa.concat_arrays([none(pa.string()), coded.dictionary.take(pa.array(term[first]))]),
            pa.array(np.concatenate([[len(docs)], n_docs]), pa.int32()),
            pa.concat_arrays([none(pa.int32()), pa.array(tf[first], pa.int32())]),
            lists_of(groups, tf[group]),
            lists_of(groups, after - starts),
            lists_of(np.append(first, len(term)), place),
            pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.nulls(n, schema.field("docs").type)]),
        ],
        schema=schema,
    )


def build_index(documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> Index:
    """Indexes every row with a term at `path`.

    Null and empty texts and those without a term are in no list and not counted. Rows that repeat an id are documents of their own. One
    shuffle, of the documents' terms, by ranges of the hashes of m and of the id: a stratum that holds a third of all rows is spread.
    """
    spark = documents.sparkSession
    rows, rows_path = stored(vectors(documents, doc_id, text), "vectors")
    n_documents, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = F.lit(50).cast("long") + (F.call_function("div", F.col("n") * (50 * n_documents), F.lit(n_terms)) if n_terms else 0)
    schema = _index_schema(to_arrow_type(rows.schema["doc_id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now, held, size = TaskContext.get().partitionId() << 32, None, [], 0
        for batch in batches:
            ms = batch.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.diff(ms, prepend=-1)), len(ms)).tolist()
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if held and (ms[a] != now or size == block):
                        yield _block_rows(now, number, held, schema)
                        number, held, size = number + 1, [], 0
                    now, take = int(ms[a]), min(b - a, block - size)
                    held.append(batch.slice(a, take).select(["doc_id", "terms", "tfs"]))
                    a, size = a + take, size + take
        if held:
            yield _block_rows(now, number, held, schema)

    dealt = rows.select(m.cast("long").alias("m"), "doc_id", "terms", "tfs")
    # By the hash of m, so that the strata of long documents don't all come together.
    dealt = dealt.repartitionByRange(spread(spark), F.xxhash64("m"), F.xxhash64("doc_id")).sortWithinPartitions("m", "doc_id")
    dealt.mapInArrow(run, from_arrow_schema(schema)).write.parquet(path)
    discard(spark, rows_path)
    return Index(path, n_documents, n_terms)


class _Queries(NamedTuple):
    """What tasks need of the queries of a turn: for each term the places of its queries, with its weight; the queries' numbers."""

    numbers: np.ndarray
    terms: dict[str, tuple[np.ndarray, int]]
    least: np.ndarray  # a score below can't be among the first k


def _turn(weights: DataFrame, least: dict[int, int]) -> _Queries:
    table = weights.toArrow()
    numbers, place = np.unique(table.column("item").to_numpy(), return_inverse=True)
    found: dict[str, list[int]] = {}
    weight = {}
    for term, p, w in zip(table.column("term").to_pylist(), place.tolist(), table.column("w").to_pylist()):
        found.setdefault(term, []).append(p)
        weight[term] = w
    terms = {t: (np.array(places), weight[t]) for t, places in found.items()}
    return _Queries(numbers, terms, np.array([max(1, least.get(i, 1)) for i in numbers.tolist()], np.int64))


def _scored(rows: DataFrame, queries: _Queries, k: int) -> DataFrame:
    """(item, doc_id, score): the first k of each query among the documents of the rows' blocks, task by task."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    doc_type = to_arrow_type(rows.schema["docs"].dataType.elementType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, terms, least = shared.value
        least = least.copy()
        best: list[list[tuple]] = [[] for _ in numbers]

        def visit(m: int, docs: pa.Array, postings: list[tuple]) -> None:
            bound = np.zeros(len(numbers), np.int64)
            for term, tfs, _, _ in postings:
                at, w = terms[term]
                bound[at] += w * impact(tfs[:1], m)[0]
            worth = bound >= least
            if not worth.any():
                return
            scores = np.zeros((len(numbers), len(docs)), np.int64)
            for term, tfs, ends, places in postings:
                at, w = terms[term]
                at = at[worth[at]]
                if len(at):
                    scores[at[:, None], places] += np.repeat(w * impact(tfs, m), np.diff(ends, prepend=0))
            for q in np.flatnonzero(worth & (scores.max(axis=1) >= least)).tolist():
                # Places are in the order of ids, which the stable sort keeps among equal scores.
                some = np.flatnonzero(scores[q] >= least[q])
                some = some[np.argsort(-scores[q, some], kind="stable")[:k]]
                for s, d in zip(scores[q, some].tolist(), docs.take(pa.array(some)).to_pylist()):
                    best[q].append((-s, d is not None, d))
                if len(best[q]) > k:
                    best[q] = sorted(best[q])[:k]
                if len(best[q]) == k:
                    least[q] = max(least[q], -max(best[q])[0])

        now, m, docs, postings = None, 0, None, []
        for batch in batches:
            get = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            blocks, ms, names = get["block"].to_pylist(), get["m"].to_pylist(), get["term"].to_pylist()
            lists = {c: (get[c].offsets.to_numpy(), get[c].values.to_numpy()) for c in ("tfs", "ends", "places")}
            for i, (b, term) in enumerate(zip(blocks, names)):
                if b != now:
                    if now is not None:
                        visit(m, docs, postings)
                    now, m, postings = b, ms[i], []
                if term is None:
                    docs = get["docs"][i].values
                else:
                    # Copies, so that no batch is held for a few of its rows.
                    postings.append((term, *(v[o[i] : o[i + 1]].astype(np.int64) for o, v in (lists[c] for c in ("tfs", "ends", "places")))))
        if now is not None:
            visit(m, docs, postings)
        for number, rows in zip(numbers.tolist(), best):
            if rows:
                scores, _, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(rows), pa.int64()), pa.array(ids, doc_type), pa.array([-s for s in scores], pa.int64())],
                    names=["item", "doc_id", "score"],
                )

    kind = rows.schema["docs"].dataType.elementType.simpleString()
    return rows.mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


def _first(scored: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def search(
    spark: SparkSession, index: Index, queries: DataFrame, k: int, item_id: str = "item_id", text: str = "text",
    pairs_at_once: int = PAIRS_AT_ONCE, first: int = FIRST,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the first k documents of each query, highest score first, then the smallest id.

    Every row of `queries` is a query of its own, rows with equal ids too. One without a term that the index has finds nothing.
    """
    rows = spark.read.parquet(index.path)
    asked, _ = stored(vectors(queries, item_id, text), "queries")
    # A number per row, made before the terms become rows.
    asked, _ = stored(asked.withColumn("item", F.monotonically_increasing_id()), "numbered")
    asked = asked.select("item", "doc_id", F.explode("terms").alias("term"))
    postings = rows.where(F.col("term").isNotNull())
    turns = -(-asked.count() // pairs_at_once)
    found = []
    for turn in range(turns):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn)
        # Broadcasts of terms and queries in this loop are bounded by the pairs of a turn.
        df = postings.join(F.broadcast(own.select("term").distinct()), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
        # In doubles; everything else is whole numbers.
        w = F.floor(F.log(F.lit(2 * index.documents + 2).cast("double") / (F.col("df") * 2 + 1).cast("double")) * 1000)
        own, _ = stored(own.join(df, "term").select("item", "term", w.cast("long").alias("w")), "weights")
        most = F.sum(F.col("w") * impact(F.col("max_tf"), F.col("m"))).alias("bound")
        bounds, bounds_path = stored(
            postings.select("m", "block", "term", "max_tf").join(F.broadcast(own), "term").groupBy("item", "block").agg(most), "bounds"
        )
        sizes = rows.where(F.col("term").isNull()).select("block", "n_docs")
        in_order = Window.partitionBy("item").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n_docs").over(in_order), F.lit(0))
        early = bounds.join(sizes, "block").withColumn("before", before).where(F.col("before") < first)
        early, early_path = stored(early.groupBy("block").agg(F.max("bound").alias("order")), "early")
        # The rows of terms that are asked for, and of the documents.
        known = own.select("term").distinct().unionByName(spark.createDataFrame([(None,)], "term string")).withColumnRenamed("term", "known")
        wanted = rows.join(F.broadcast(known), F.col("term").eqNullSafe(F.col("known")), "left_semi")

        def visited(blocks: DataFrame) -> DataFrame:
            dealt = wanted.join(blocks, "block").repartition(spread(spark), "block")
            return dealt.sortWithinPartitions(F.desc("order"), "block", F.asc_nulls_first("term")).select(*rows.columns)

        seen, _ = stored(_first(_scored(visited(early), _turn(own, {}), k), k).select("item", "doc_id", "score"), "seen")
        # One row per query of the turn.
        least = seen.groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        least, least_path = stored(least.select("item", "least"), "least")
        rest = bounds.join(least, "item", "left").where(F.col("bound") >= F.coalesce("least", F.lit(1)))
        rest = rest.groupBy("block").agg(F.max("bound").alias("order")).join(early.select("block"), "block", "left_anti")
        late, _ = stored(_scored(visited(rest), _turn(own, dict(map(tuple, least.collect()))), k), "late")
        found.append(_first(seen.unionByName(late), k))
        for done in (bounds_path, early_path, least_path):
            discard(spark, done)
    names = asked.select("item", F.col("doc_id").alias("item_id")).distinct()
    if not found:
        kind = rows.schema["docs"].dataType.elementType.simpleString()
        found = [spark.createDataFrame([], f"item bigint, doc_id {kind}, score bigint, rank int")]
    ranked = found[0]
    for other in found[1:]:
        ranked = ranked.unionByName(other)
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def index_folder(spark: SparkSession) -> str:
    """A new path below the shared folder for an index."""
    return work_path(spark, "index")
