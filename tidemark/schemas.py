"""Declared layouts: the tenants' raw tables, the canonical entities, the statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Tenant table layouts and canonical columns.
PROJECT_A_ISSUES = "issue_key string, summary string, status string, created_at date, story_points int"
PROJECT_B_ISSUES = "id int, title string, state string, opened date, priority string"
PROJECT_C_ISSUES = ("ticket", "headline", "phase", "logged", "weight")

PROJECT_A_ISSUE_HISTORY = (
    "issue_key string, changed_at date, status string, story_points int, component_key string"
)
PROJECT_A_COMPONENT_HISTORY = (
    "component_key string, changed_at date, safety_class string, owner_team string"
)
PROJECT_B_ISSUE_HISTORY = "id int, updated date, state string, priority string, area string"
PROJECT_B_COMPONENT_HISTORY = "area string, updated date, classification string, team string"

ISSUES = {
    "tenant_id": "string",
    "issue_id": "string",
    "title": "string",
    "state": "string",
    "created_on": "date",
    "effort": "int",
}
RISK_HISTORY = {
    "tenant_id": "string",
    "issue_id": "string",
    "valid_from": "date",
    "state": "string",
    "effort": "int",
    "component_id": "string",
    "safety_class": "string",
    "owner": "string",
}

HOST_SAMPLE = (
    "sampled_at timestamp, cpu_usage_usec long, host_nproc int, mem_current_bytes long, "
    "mem_peak_bytes long, host_mem_total_bytes long, io_read_bytes long, io_write_bytes long, "
    "io_read_ios long, io_write_ios long, net_tx_bytes long, net_rx_bytes long, "
    "db_size_bytes long, temp_size_bytes long, volume_size_bytes long"
)
QUERY_SAMPLE = (
    "sampled_at timestamp, queryid long, query string, calls long, total_exec_time double, "
    "rows long, shared_blks_hit long, shared_blks_read long, temp_blks_read long, "
    "temp_blks_written long"
)
TABLE_SAMPLE = (
    "sampled_at timestamp, schemaname string, relname string, seq_scan long, seq_tup_read long, "
    "idx_scan long, idx_tup_fetch long, n_live_tup long, n_dead_tup long, heap_blks_read long, "
    "idx_blks_read long"
)


def conform(frame: DataFrame, contract: dict[str, str], times_as: str | None = None) -> DataFrame:
    """Check that a frame has exactly the contract's columns and types, in its order.

    `times_as` replaces the contract's `date` type for tenants with finer times.
    """
    expected = {c: times_as if times_as and t == "date" else t for c, t in contract.items()}
    actual = dict(frame.dtypes)
    if actual != expected:
        raise TypeError(f"columns do not match the contract: {actual} instead of {expected}")
    return frame.select(*expected)
