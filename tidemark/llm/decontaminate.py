"""Benchmark passages in documents, found by winnowed fingerprints.

A passage is a run of `window` words of a benchmark item, or the whole of a shorter item. Each run of
n words has n - k + 1 grams of k words; the smallest of their hashes is kept, on either side. Equal
runs keep equal hashes, so a document that holds a run shares a fingerprint with the item at the same
place in it, and no run is missed. A shared fingerprint is then extended to both sides, on the words
themselves, and counts if it grows to a whole run.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, discard, stored, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
# Bytes of the filter that documents' fingerprints pass before the join. A larger benchmark fills it
# and it lets more through; what the join finds stays the same.
FILTER_SLOTS = 1 << 16

NO_PLACES = (
    "array<struct<run:int,at:int,hash:bigint,gram:array<string>,before:array<string>,after:array<string>>>"
)


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased; an empty array for null."""
    return F.coalesce(
        F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>")
    )


def _places(rows: DataFrame, runs: list[int], passes=None) -> DataFrame:
    """Adds `places`: where the winnowed fingerprints of `words` are, with the words around them.

    One step per column, so that none is computed twice. `passes` says which hashes are worth a look.
    """
    rows = rows.withColumn("each", F.transform("words", lambda w: F.xxhash64(w)))
    found = []
    for run in runs:
        k = min(GRAM, run)
        over, reach = run - k + 1, run - k
        size = F.size("each") - k + 1
        grams = F.transform(
            F.sequence(F.lit(0), size - 1), lambda i: F.xxhash64(*(F.get("each", i + j) for j in range(k)))
        )
        rows = rows.withColumn(f"h{run}", F.when(size > 0, grams).otherwise(F.array().cast("array<bigint>")))
        h = F.col(f"h{run}")
        minima = h
        if over > 1:
            least = F.transform(
                F.sequence(F.lit(0), F.size(h) - over), lambda i: F.least(*(F.get(h, i + j) for j in range(over)))
            )
            minima = F.when(F.size(h) >= over, least).otherwise(F.array().cast("array<bigint>"))
        rows = rows.withColumn(f"kept{run}", F.array_distinct(minima))
        if passes is not None:
            rows = rows.withColumn(f"kept{run}", F.filter(f"kept{run}", lambda x: passes(x)))
        kept = F.col(f"kept{run}")
        at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(kept, F.get(h, i)))
        place = lambda i: F.struct(
            F.lit(run).alias("run"),
            i.alias("at"),
            F.get(h, i).alias("hash"),
            F.slice("words", i + 1, k).alias("gram"),
            F.array(*(F.get("words", i - o) for o in range(1, reach + 1))).cast("array<string>").alias("before"),
            F.array(*(F.get("words", i + k - 1 + o) for o in range(1, reach + 1))).cast("array<string>").alias("after"),
        )
        # Most documents have no fingerprint that passes; only the others look for its places.
        rows = rows.withColumn(
            f"places{run}",
            F.when(F.size(kept) > 0, F.transform(at, place)).otherwise(F.array()).cast(NO_PLACES),
        )
        found.append(F.col(f"places{run}"))
    return rows.withColumn("places", F.concat(*found) if found else F.array().cast(NO_PLACES))


def _items(benchmark: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The different items (item, words, n), and which item_ids have each."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words"))
    rows = rows.where(F.size("words") > 0).select("item_id", "words", F.sha2(F.array_join("words", " "), 256).alias("item"))
    return (
        rows.groupBy("item").agg(F.first("words").alias("words")).withColumn("run", F.least(F.size("words"), F.lit(window))),
        rows.where(F.col("item_id").isNotNull()).select("item", "item_id").distinct(),
    )


def _filter(fingerprints: DataFrame, slots: int):
    """A test of hashes that all of `fingerprints` pass; what it knows fits into `slots` bytes."""
    two = lambda h: (F.pmod(h, F.lit(slots)), F.pmod(F.shiftright(h, 24), F.lit(slots)))
    rows = fingerprints.select(F.explode(F.array(*two(F.col("hash")))).alias("slot")).distinct().collect()
    table = bytearray(slots)
    for (slot,) in rows:
        table[slot] = 1
    known, one = F.lit(bytes(table)), F.lit(b"\x01")

    def passes(h: Column) -> Column:
        first, second = two(h)
        test = lambda slot: F.substring(known, slot.cast("int") + 1, F.lit(1)) == one
        return test(first) & test(second)

    return passes


def _equal_words(ours: str, theirs: str) -> Column:
    """How many leading words two arrays share."""
    differs = F.array_position(F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(differs == 0, F.size(ours)).otherwise(differs.cast("int") - 1)


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: (doc_id, content, n_words, n_hit, item_ids, contaminated).

    `content` is a hash of the text, by which rows with the same doc_id are told apart; rows that are
    equal get equal results. `item_ids` are the items with a run in the document, as strings and
    sorted; an item with a null id makes hits but is not listed. Null and empty texts have no words,
    no hits and no items. Copies of an item are searched once. Fingerprints are joined with those of
    the benchmark by Spark's choice: broadcast if the written table is below the session's
    threshold, by a shuffle beyond.
    """
    spark = documents.sparkSession
    items, names = _items(benchmark, item_id, item_text, window)
    items, items_path = stored(items, "items")
    runs = sorted(r[0] for r in items.select("run").distinct().collect())
    # Written before it is exploded: Spark moves the test for empty arrays that comes with an explode below
    # the steps that make the array, and repeats their expressions there.
    own, own_path = stored(_places(items, runs).select("item", "run", "places"), "item-places")
    own = own.select("item", "run", F.inline("places").alias("r", "at", "hash", "gram", "before", "after"))
    prints, prints_path = stored(
        own.where("r = run").groupBy("run", "hash", "gram", "before", "after").agg(F.collect_set("item").alias("items")), "prints"
    )
    discard(spark, items_path)
    discard(spark, own_path)
    passes = _filter(prints, FILTER_SLOTS)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("content"), words_of(F.col("text")).alias("words"))
    base, _ = stored(
        _places(rows, runs, passes).select("doc_id", "content", F.size("words").cast("long").alias("n_words"), "places"),
        "places",
    )
    places = base.where(F.size("places") > 0).select("doc_id", "content", F.explode("places").alias("p"))
    places = places.select("doc_id", "content", *(F.col("p")[c].alias(c) for c in ("run", "at", "hash", "gram", "before", "after")))
    theirs = prints.select(
        "run", "hash", *(F.col(c).alias(f"item_{c}") for c in ("gram", "before", "after")), "items"
    )
    left, right = _equal_words("before", "item_before"), _equal_words("after", "item_after")
    hits = (
        places.join(theirs, ["run", "hash"])
        .where(F.col("gram") == F.col("item_gram"))
        .select(
            "doc_id",
            "content",
            "run",
            (F.col("at") - left).alias("begin"),
            (F.col("at") + F.size("gram") + right).alias("end"),
            "items",
        )
        .where(F.col("end") - F.col("begin") >= F.col("run"))
    )
    spans = (
        hits.groupBy("doc_id", "content", "begin", "end")
        .agg(F.flatten(F.collect_list("items")).alias("items"))
        .groupBy("doc_id", "content")
        .agg(
            F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["to"], s["end"]).alias("to"),
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["begin"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    spans, _ = stored(spans.select("doc_id", "content", covered.alias("n_hit"), "items"), "hits")
    listed = (
        spans.select("doc_id", "content", F.explode("items").alias("item"))
        .join(names, "item")
        .groupBy("doc_id", "content")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    found = _attach(spans.select("doc_id", "content", "n_hit"), listed)
    return _attach(base.drop("places"), found).select(
        "doc_id",
        "content",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _attach(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join on doc_id, null equal to null, and content."""
    right = right.withColumnsRenamed({"doc_id": "its_doc_id", "content": "its_content"})
    on = left["doc_id"].eqNullSafe(right["its_doc_id"]) & (left["content"] == right["its_content"])
    return left.join(right, on, "left").drop("its_doc_id", "its_content")


def clean(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without a hit, with all their columns."""
    found = contamination(documents, benchmark, doc_id, text, **options).where("contaminated")
    key, content = unused("bad_id", documents.columns), unused("bad_content", documents.columns)
    found, _ = stored(found.select(F.col("doc_id").alias(key), F.col("content").alias(content)).distinct(), "contaminated")
    return documents.join(
        found, documents[doc_id].eqNullSafe(found[key]) & (F.xxhash64(documents[text]) == found[content]), "left_anti"
    )
