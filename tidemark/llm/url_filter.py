"""Verdicts on urls: rules by host and path, and trust that spreads over links between hosts.

A rule names a host and the start of a path, and fits the host and its subdomains; the longest one
that fits decides. Where none fits, the host's scores do: personalised PageRank from trusted hosts
along the links, and the same from blocked hosts against them, since who links to a blocked host is
suspect and not who is linked from one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored

# An absolute or scheme-relative link; relative ones stay on their own host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]*)"""

DAMPING = 0.85
# A bound only: on a cycle 0.85 ** n reaches the tolerance after 73 rounds, or later for a host that many seeds add up to.
ROUNDS = 200
TOLERANCE = 1e-6
# Of a blocked seed's own score, which is 1 - DAMPING at least.
THRESHOLD = 0.05


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty where there is no `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruling(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(length, rule, verdict) of the longest rule that fits, the last by name of equal ones."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.host + r.path)).alias("length"),
                F.lit(r.host + r.path).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            ),
        )
        for r in rules
    ]
    none = "array<struct<length:int,rule:string,verdict:string>>"
    return F.array_max(F.array(*fits).cast(none) if fits else F.array().cast(none))


def host_links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst) once for each two hosts of which one links to the other."""
    targets = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))
    return (
        pages.where(F.col(host) != "")
        .select(F.col(host).alias("src"), F.explode(targets).alias("dst"))
        .select("src", F.translate("dst", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("dst"))
        .where((F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .distinct()
    )


def propagate(
    links: DataFrame,
    seeds: DataFrame,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(host, trust, distrust) of each host that a seed reaches.

    `links` has (src, dst), `seeds` has (host, trust, distrust), 1 for a seed of the kind and 0
    otherwise. Each round's table is written to the shared folder, so a lost executor costs a round
    at most; it ends when no score moves by more than `tolerance`, and fails if that takes over `rounds`.
    """
    spark = links.sparkSession
    start = seeds.select(
        "host",
        (F.col("trust") * (1 - damping)).alias("trust"),
        (F.col("distrust") * (1 - damping)).alias("distrust"),
    )
    out = links.groupBy("src").agg(F.count("*").alias("n_out")).withColumnRenamed("src", "a")
    into = links.groupBy("dst").agg(F.count("*").alias("n_in")).withColumnRenamed("dst", "b")
    weighted, weighted_path = stored(
        links.join(out, F.col("src") == F.col("a")).join(into, F.col("dst") == F.col("b")).select("src", "dst", "n_out", "n_in"),
        "links",
    )
    state, path = stored(start, "trust")
    if weighted.isEmpty():
        discard(spark, weighted_path)
        return state
    for _ in range(rounds):
        forward = weighted.join(state, F.col("src") == F.col("host")).select(
            F.col("dst").alias("host"), (damping * F.col("trust") / F.col("n_out")).alias("trust"), F.lit(0.0).alias("distrust")
        )
        backward = weighted.join(state, F.col("dst") == F.col("host")).select(
            F.col("src").alias("host"), F.lit(0.0).alias("trust"), (damping * F.col("distrust") / F.col("n_in")).alias("distrust")
        )
        before = state.select(
            "host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), F.col("trust").alias("t"), F.col("distrust").alias("d")
        )
        after, after_path = stored(
            forward.unionByName(backward)
            .unionByName(start)
            .withColumns({"t": F.lit(0.0), "d": F.lit(0.0)})
            .unionByName(before)
            .groupBy("host")
            .agg(*(F.sum(c).alias(c) for c in ("trust", "distrust", "t", "d"))),
            "trust",
        )
        moved = after.agg(F.max(F.greatest(F.abs(F.col("trust") - F.col("t")), F.abs(F.col("distrust") - F.col("d"))))).first()[0]
        discard(spark, path)
        state, path = after.select("host", "trust", "distrust"), after_path
        if moved is None or moved <= tolerance:
            discard(spark, weighted_path)
            return state
    raise RuntimeError(f"scores still move after {rounds} rounds")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict).

    A host is a trusted seed if rules allow more than half of its pages, a blocked seed if they block
    more than half. Pages without a fitting rule are blocked if their host's distrust is over the
    threshold and over its trust, and allowed otherwise; so are pages without a host, which have no
    scores. Null urls, and urls without `://`, have an empty host and path. Null html has no links.
    Rows with the same page_id are judged one by one. The rules are a list of a few, kept in the
    plan; hosts, links and scores are tables, summed by host before each shuffle.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    own = own.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = own.withColumn("ruling", ruling(F.col("host"), F.col("path"), rules))
    allowed, blocked = (F.count(F.when(F.col("ruling.verdict") == v, 1)) for v in ("allow", "block"))
    seeds = (
        own.where(F.col("host") != "")
        .groupBy("host")
        .agg(F.count("*").alias("n"), allowed.alias("allowed"), blocked.alias("blocked"))
        .select(
            "host",
            (2 * F.col("allowed") > F.col("n")).cast("double").alias("trust"),
            (2 * F.col("blocked") > F.col("n")).cast("double").alias("distrust"),
        )
        .where("trust + distrust > 0")
    )
    links, links_path = stored(host_links(own), "host-links")
    scores = propagate(links, seeds)
    discard(pages.sparkSession, links_path)
    bad = scores.where((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))).select(
        F.col("host").alias("bad_host")
    )
    return own.join(bad, F.col("host") == F.col("bad_host"), "left").select(
        "page_id",
        "host",
        "path",
        F.col("ruling.rule").alias("rule"),
        F.coalesce(F.col("ruling.verdict"), F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )
