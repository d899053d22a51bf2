"""Keyed changes to stored tables: upsert, retention, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import distinct_from


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `changes` insert or wholly replace rows of `base` with the same key."""
    kept = base.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes)


def prune(frame: DataFrame, ts: str, as_of: Column, retention: Column) -> DataFrame:
    """Drop rows older than `retention` at `as_of`. On a partition column this reads nothing."""
    return frame.where(F.col(ts) >= as_of - retention)


def reconcile(mirror: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What makes `mirror` equal to `source`: each row with a `change` label.

    `insert`, `update` and `same` rows carry the source's values, `delete` rows the mirror's.
    The new mirror is everything that is not labelled `delete`.
    """
    keys = list(keys)
    values = [c for c in source.columns if c not in keys]
    old = mirror.select(*keys, F.struct(*values).alias("_old"))
    new = source.select(*keys, F.struct(*values).alias("_new"))
    both = old.join(new, keys, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(distinct_from("_old", "_new"), "update")
        .otherwise("same")
    )
    row = F.coalesce("_new", "_old")
    return both.select(*keys, *[row[c].alias(c) for c in values], change.alias("change"))


def apply_changes(changes: DataFrame) -> DataFrame:
    """The new mirror from the output of `reconcile`."""
    return changes.where(F.col("change") != "delete").drop("change")


