"""Exact duplicates by two passes over a Bloom filter: only rows that may be repeated are shuffled.

The first pass looks at a 64-bit hash of each text. A hash picks one word of the filter and `BITS` bits in it. The patterns
that occur twice in a word are set in the filter; it is small enough to go to all tasks. In the second pass a row whose pattern is
not set has no equal and goes straight through. The others are grouped by the SHA-256 of their texts. A set pattern is not proof,
so the groups decide, and a group of one is a row without an equal as well.

Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, discard, stored, unused

BITS = 3
# The filter has a word of 64 bits for each eight rows, and at most this many, which bounds what is broadcast: a row of
# two longs per word in use. Beyond some 30 million different repeated texts it fills up and lets more rows through to the shuffle;
# the result stays the same.
MOST_WORDS = 1 << 22


def normalised(text: Column) -> Column:
    """What equal texts share: A-Z in lower case, null as the empty text."""
    return F.coalesce(ascii_lower(text), F.lit(""))


def _word(h: Column, words: int) -> Column:
    return F.shiftrightunsigned(h, 6 * BITS).bitwiseAND(F.lit(words - 1))


def _pattern(h: Column) -> Column:
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(BITS)]
    pattern = bits[0]
    for b in bits[1:]:
        pattern = pattern.bitwiseOR(b)
    return pattern


def repeated_filter(hashes: DataFrame, words: int) -> DataFrame:
    """The filter as (word, bits): the patterns that two or more rows of `hashes` (h) have. At most `words` rows."""
    patterns = hashes.select(_word(F.col("h"), words).alias("word"), _pattern(F.col("h")).alias("bits"))
    twice = patterns.groupBy("word", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _words_for(rows: int, most: int) -> int:
    return min(most, 1 << max(10, (rows // 8).bit_length()))


def _marked(rows: DataFrame, found: DataFrame, words: int, hash_column: str, maybe: str) -> DataFrame:
    """Adds `maybe`: whether the row's pattern is set in the filter."""
    word, bits = unused("word", rows.columns), unused("bits", rows.columns)
    table = F.broadcast(found.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    pattern = _pattern(F.col(hash_column))
    joined = rows.join(table, _word(F.col(hash_column), words) == F.col(word), "left")
    return joined.withColumn(maybe, F.coalesce(F.col(bits).bitwiseAND(pattern) == pattern, F.lit(False))).drop(word, bits)


def exact_groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are one group, in
    which the row of the largest id stays as in any other. A null id is smaller than any other. Rows that repeat both id and text get equal
    results and count each in `group_size`. An empty table gives an empty one.
    """
    digest = normalised(F.col(text))
    thin = documents.select(F.col(doc_id).alias("doc_id"), digest.alias("own"))
    thin, _ = stored(
        thin.select("doc_id", F.sha2(F.encode("own", "UTF-8"), 256).alias("text_sha256"), F.xxhash64("own").alias("h")), "digests"
    )
    words = _words_for(thin.count(), most_words)
    found, _ = stored(repeated_filter(thin, words), "filter")
    rows = _marked(thin, found, words, "h", "maybe")
    one, alone = F.lit(1).cast("long"), rows.where(~F.col("maybe"))
    through = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # A hot group is one row per map task here, and a skewed key that adaptive execution splits in the join below.
    together = rows.where("maybe").select("doc_id", "text_sha256")
    groups = together.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    grouped = together.join(groups, "text_sha256")
    return through.unionByName(grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """The rows that stay, with all their columns: one of each group, that of the largest id (any one of those that repeat it).

    A row whose hash isn't in the filter isn't shuffled.
    """
    h, maybe, digest, row = (unused(n, documents.columns) for n in ("h", "maybe", "digest", "row"))
    own = normalised(F.col(text))
    hashes, path = stored(documents.select(F.xxhash64(own).alias("h")), "hashes")
    words = _words_for(hashes.count(), most_words)
    found, _ = stored(repeated_filter(hashes, words), "filter")
    discard(documents.sparkSession, path)
    rows = _marked(documents.withColumn(h, F.xxhash64(own)), found, words, h, maybe)
    columns = documents.columns
    together = rows.where(F.col(maybe)).select(F.sha2(F.encode(own, "UTF-8"), 256).alias(digest), F.struct(*columns).alias(row))
    # The order is a struct, so that a null id has its place in it.
    stays = together.groupBy(digest).agg(F.max_by(row, F.struct(F.col(row)[doc_id])).alias(row))
    return rows.where(~F.col(maybe)).select(*columns).unionByName(stays.select(*(F.col(row)[c].alias(c) for c in columns)))
