"""Issues through time together with the safety class of their component."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import value_map
from tidemark.operators.audits import (
    Audit,
    audit_every_row_is_a_change,
    audit_known_tenant,
    audit_unique,
)
from tidemark.operators.temporal import periods, temporal_join
from tidemark.plans.harmonize import B_CLOSED, B_EFFORT, B_EFFORT_DEFAULT, union_tenants
from tidemark.schemas import RISK_HISTORY, conform

# project_a's states.
A_STATES = {"Done": "closed", "In Progress": "in_progress"}
PAYLOAD = ("state", "effort", "component_id", "safety_class", "owner")


def project_a_risk_history(issues: DataFrame, components: DataFrame) -> DataFrame:
    joined = temporal_join(
        issues, components, "changed_at", "changed_at", "issue_key",
        [("component_key", "component_key")],
    )
    return joined.select(
        F.lit("project_a").alias("tenant_id"),
        F.col("issue_key").alias("issue_id"),
        F.col("ts").alias("valid_from"),
        value_map("lhs.status", A_STATES, "todo").alias("state"),
        F.col("lhs.story_points").alias("effort"),
        F.col("lhs.component_key").alias("component_id"),
        F.col("rhs.safety_class").alias("safety_class"),
        F.col("rhs.owner_team").alias("owner"),
    )


def project_b_risk_history(issues: DataFrame, components: DataFrame) -> DataFrame:
    joined = temporal_join(issues, components, "updated", "updated", "id", [("area", "area")])
    return joined.select(
        F.lit("project_b").alias("tenant_id"),
        F.col("id").cast("string").alias("issue_id"),
        F.col("ts").alias("valid_from"),
        F.when(F.col("lhs.state").isin(*B_CLOSED), "closed").otherwise("todo").alias("state"),
        value_map("lhs.priority", B_EFFORT, B_EFFORT_DEFAULT).alias("effort"),
        F.col("lhs.area").alias("component_id"),
        F.col("rhs.classification").alias("safety_class"),
        F.col("rhs.team").alias("owner"),
    )


def risk_audits() -> Mapping[str, Audit]:
    """What a tenant's risk history has to pass before it is published."""
    return {
        "known tenant": audit_known_tenant,
        "unique": lambda f: audit_unique(f, ["issue_id", "valid_from"]),
        "every row is a change": lambda f: audit_every_row_is_a_change(
            f, "issue_id", "valid_from", PAYLOAD
        ),
    }


def silver_risk_history(*tenants: DataFrame) -> DataFrame:
    return union_tenants([conform(t, RISK_HISTORY) for t in tenants])


def time_in_class(history: DataFrame, as_of: Column) -> DataFrame:
    """Days spent in each safety class per tenant; an item's last period runs to `as_of`."""
    lasting = periods(history, ["tenant_id", "issue_id"], "valid_from", as_of)
    return lasting.groupBy("tenant_id", "safety_class").agg(
        F.count(F.lit(1)).alias("periods"), F.sum("days").alias("days")
    )
