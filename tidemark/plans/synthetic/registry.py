"""Where the queries over the synthetic tables are collected."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare, zoneless

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL to compare it with where there is one."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"there is already a query named {name!r}")

        @functools.wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return zoneless(function(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add
