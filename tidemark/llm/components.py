"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (a, b): the smallest node that it is connected with.

    Alternating large and small stars: each round points nodes at the smallest neighbour so far, with
    sums per node before the shuffle and one table written per round. The number of edges never
    grows, and rounds are logarithmic in the length of chains in practice. It fails rather than return
    unfinished components.
    """
    spark = edges.sparkSession
    pairs, path = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # Large star: larger neighbours of a node go to the node's smallest one.
        large, large_path = stored(
            both.where("b > a")
            .join(smallest, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct(),
            "large",
        )
        # Small star: smaller neighbours of a node, and itself, go to the smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small, small_path = stored(
            large.join(least, F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct(),
            "small",
        )
        # Done when each node has one edge and no root has one to a smaller node.
        ends = small.select("a").distinct()
        n, n_nodes = small.count(), ends.count()
        tangled = n != n_nodes or not small.join(ends.withColumnRenamed("a", "n"), F.col("b") == F.col("n"), "left_semi").isEmpty()
        discard(spark, path)
        discard(spark, large_path)
        pairs, path = small, small_path
        if not tangled:
            roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError(f"components are not complete after {rounds} rounds")
