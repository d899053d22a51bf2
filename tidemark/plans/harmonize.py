"""Tenants' issue tables to one canonical table, and its metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import value_map
from tidemark.schemas import ISSUES, conform

# The tenants' vocabularies.
B_CLOSED = ("closed", "merged")
B_EFFORT = {"high": 8, "medium": 5}
B_EFFORT_DEFAULT = 2


def canonical(
    frame: DataFrame,
    tenant: str,
    issue_id: Column,
    title: Column,
    closed: Column,
    created_on: Column,
    effort: Column,
) -> DataFrame:
    """A tenant's table in canonical columns; `closed` is the tenant's condition for that."""
    return frame.select(
        F.lit(tenant).alias("tenant_id"),
        issue_id.alias("issue_id"),
        title.alias("title"),
        F.when(closed, "closed").otherwise("open").alias("state"),
        created_on.alias("created_on"),
        effort.alias("effort"),
    )


def project_a_issues(raw: DataFrame) -> DataFrame:
    """Only `Done` is closed; story points are the effort."""
    return canonical(
        raw, "project_a", F.col("issue_key"), F.col("summary"), F.col("status") == "Done",
        F.col("created_at"), F.col("story_points"),
    )


def project_b_issues(raw: DataFrame) -> DataFrame:
    """Two states are closed; the priority stands for the effort."""
    return canonical(
        raw, "project_b", F.col("id").cast("string"), F.col("title"),
        F.col("state").isin(*B_CLOSED), F.col("opened"),
        value_map("priority", B_EFFORT, B_EFFORT_DEFAULT),
    )


def project_c_issues(raw: DataFrame) -> DataFrame:
    """Text columns: dates and weights are parsed here."""
    return canonical(
        raw, "project_c", F.col("ticket"), F.col("headline"), F.col("phase") == "resolved",
        F.to_date("logged"), F.col("weight").cast("int"),
    )


def union_tenants(frames: Sequence[DataFrame]) -> DataFrame:
    """All tenants in one table; filters on it reach every tenant's scan."""
    return reduce(DataFrame.unionByName, frames)


def silver_issues(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    models = [project_a_issues(a), project_b_issues(b), project_c_issues(c)]
    return union_tenants([conform(m, ISSUES) for m in models])


def issue_metrics(issues: DataFrame) -> DataFrame:
    """Counts and total effort per tenant."""
    return issues.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("state") == "open").alias("open_issues"),
        F.count_if(F.col("state") == "closed").alias("closed_issues"),
        F.sum("effort").alias("total_effort"),
    )
