"""The dealt operators over the synthetic tables, with SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    exact_dedup,
    language_id,
    quality,
    ranked_search,
    repeats,
    secret_scan,
    sentencepieces,
    simhash,
    token_alignment,
    url_filter,
    warc,
    weighted_sampling,
)
from tidemark.llm.common import may_train, prepare, stored, table
from tidemark.session import work_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query(
    "op1_warc",
    """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
            min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
        FROM pages
    )
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
        array_to_string([
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (('0x' || substr(hex, 1 + 10 * (i // 8), 10))::BIGINT >> (5 * (7 - i % 8))::INT & 31)::INT + 1, 1)
            FOR i IN range(32)], '') AS payload_digest,
        CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM p
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc.archive(warc.page_records(table(spark, sf_dir, "pages")), path)
    return warc.described(warc.read_archive(spark, path))


@query(
    "op4_secret_scans",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS (
        SELECT doc_id, t, kind, pattern, regexp_extract_all(t, pattern) AS found,
            CASE WHEN kind = 0 THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern) END AS part
        FROM d, (VALUES
            (0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
            (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (3, '[A-Za-z0-9+/_-]+={0,2}')) AS k(kind, pattern)
    ),
    s AS (
        SELECT doc_id, kind, found, part, string_split_regex(t, pattern) AS gaps FROM m WHERE len(found) > 0
    ),
    e AS (
        SELECT doc_id, kind, unnest(found) AS word, unnest(part) AS part,
            unnest(gaps[1:len(found)]) AS gap, generate_subscripts(found, 1) AS i
        FROM s
    ),
    p AS (
        SELECT doc_id, kind, word, part,
            sum(length(gap) + length(word)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
        FROM e
    ),
    k AS (
        SELECT doc_id, kind, stop - length(word) AS start, stop FROM p
        WHERE kind = 0 AND length(part) >= 12 OR kind = 1 AND length(word) >= 18 OR kind = 2 AND length(word) >= 16
            OR kind = 3 AND length(rtrim(word, '=')) >= 20
                AND NOT regexp_matches(word, '^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$')
                AND NOT regexp_matches(word, '^[0-9+/_-]+$') AND NOT regexp_matches(word, '(?i)example')
                AND list_max([list_entropy(string_split(substr(word, (j + 1)::INT, 20), '')) FOR j IN range(length(word) - 19)])
                    > CASE WHEN regexp_matches(word, '^[0-9a-fA-F]+$') THEN 3.01
                        WHEN regexp_matches(word, '^[A-Za-z/_-]+=*$') THEN 4.11 ELSE 3.61 END
    ),
    n AS (
        SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || stop AS span FROM k
    ),
    g AS (
        SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
            count(*) FILTER (kind = 2) AS n_hex,
            string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
            string_agg(span, ',' ORDER BY start, kind) AS spans
        FROM n GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(
        F.filter("spans", lambda s: s["kind"] == secret_scan.KINDS.index(kind))
    ).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.KINDS.index("entropy"))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(F.encode(secret_scan.span_list(base), "UTF-8"), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"),
    )


@query(
    "op6_benchmark_decontamination",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ),
    b AS (
        SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark
    ),
    runs AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
    ),
    grams AS (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS run
        FROM d, (SELECT DISTINCT n FROM runs) AS k, unnest(range(1, len(w) - n + 2)) AS r(i)
    ),
    hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN runs USING (n, run)),
    words AS (
        SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM hits, unnest(range(n)) AS r(o) GROUP BY doc_id
    ),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) AS h GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


@query("op8_sentencepiece")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepieces.read_vocabulary(MODEL_FILE)
    found = sentencepieces.decode(sentencepieces.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), digest(ids).alias("ids_sha256"), digest("decoded").alias("decoded_sha256")
    )


RULES = (
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
)


@query("op9_url_filters")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    network = quality.train(documents, table(spark, sf_dir, "labels"), may_train(F.col("doc_id")))
    found = quality.score(documents.select("doc_id", "text"), network)
    return found.select(
        "doc_id",
        (~may_train(F.col("doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op7_document_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighted_sampling.edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = language_id.train(documents, may_train(F.col("doc_id")))
    found = language_id.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (~may_train(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


@query("op2_repeated_strings")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeats"),
    )


@query(
    "op12_exact_dedup",
    """
    WITH d AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


A_FILE = "/opt/tokenizers/byte_bpe_50k.json"


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizers = token_alignment.read_tokenizers(A_FILE, MODEL_FILE)
    found = token_alignment.align(table(spark, sf_dir, "documents"), tokenizers)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.encode("groups", "UTF-8"), 256)).otherwise("")
    aligned, _ = stored(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts, _ = stored(token_alignment.pair_counts(aligned), "pairs")
    bound = token_alignment.most_pairs(tokenizers.a_tokens, tokenizers.b_tokens)
    return token_alignment.score_links(aligned, counts, bound).select(
        "doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256"
    )


@query(
    "op13_ranked_search",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM documents
    ),
    b AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ),
    c AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
    p AS (
        SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) AS e
        WHERE term IN (SELECT term FROM b) GROUP BY ALL
    ),
    w AS (
        SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term
    ),
    s AS (
        SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
        FROM b JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id
    ),
    r AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s WHERE score > 0
    )
    SELECT * FROM r WHERE rank <= 50
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents"), ranked_search.index_folder(spark))
    return ranked_search.search(spark, index, table(spark, sf_dir, "benchmark"), 50)
