"""The server's own statistics: hourly rollup and the dashboard queries.

Each dashboard query takes the samples, the series columns that tell hosts apart, and the time
range. The columns carry the panels' labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import QUERY_TEXT_LENGTH, in_window
from tidemark.operators.series import (
    Rollup,
    counter_rate,
    forward_fill,
    growth_per_day,
    latest_non_null,
    top_k,
    window_total,
)
from tidemark.operators.slices import AUTO, Cuts

HOST_ROLLUP = Rollup(
    gauges={"mem_bytes": "mem_current_bytes"},
    peaks={
        "db_size_bytes": "db_size_bytes",
        "temp_size_bytes": "temp_size_bytes",
        "volume_size_bytes": "volume_size_bytes",
    },
    counters={
        c: c
        for c in (
            "io_read_bytes", "io_write_bytes", "io_read_ios", "io_write_ios",
            "net_tx_bytes", "net_rx_bytes",
        )
    },
    rates={"cpu_cores": ("cpu_usage_usec", 1e6)},
)

TOP = 20


def lookback() -> Column:
    """How far before the window the first predecessor may lie."""
    return F.expr("INTERVAL 1 HOUR")


def available_cores(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    latest = latest_non_null(samples, series, "sampled_at", "host_nproc")
    return latest.withColumnRenamed("host_nproc", "Cores")


def available_memory(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    latest = latest_non_null(samples, series, "sampled_at", "host_mem_total_bytes")
    return latest.withColumnRenamed("host_mem_total_bytes", "Memory")


def traffic_sent(samples, series, t_from, t_to, reach: Column | None = None) -> DataFrame:
    return window_total(
        samples, series, "sampled_at", "net_tx_bytes", t_from, t_to, _or_hour(reach)
    ).withColumnRenamed("total", "Sent")


def traffic_received(samples, series, t_from, t_to, reach: Column | None = None) -> DataFrame:
    return window_total(
        samples, series, "sampled_at", "net_rx_bytes", t_from, t_to, _or_hour(reach)
    ).withColumnRenamed("total", "Received")


def cpu_cores_used(samples, series, t_from, t_to, reach: Column | None = None) -> DataFrame:
    return _rates(
        samples, series, t_from, t_to, reach, {"cpu_usage_usec": "CPU cores busy"}, 1e6
    )


def disk_throughput(samples, series, t_from, t_to, reach: Column | None = None) -> DataFrame:
    labels = {"io_read_bytes": "Read", "io_write_bytes": "Write"}
    return _rates(samples, series, t_from, t_to, reach, labels)


def network_throughput(samples, series, t_from, t_to, reach: Column | None = None) -> DataFrame:
    labels = {"net_tx_bytes": "Sent", "net_rx_bytes": "Received"}
    return _rates(samples, series, t_from, t_to, reach, labels)


def memory_used(samples: DataFrame, series: Sequence[str], t_from, t_to) -> DataFrame:
    shown = samples.where(in_window("sampled_at", t_from, t_to)).select(
        *series, F.col("sampled_at").alias("time"), F.col("mem_current_bytes").alias("Memory used")
    )
    return shown.orderBy("time", *series)


def storage_used(
    samples, series, t_from, t_to, reach: Column | None = None, cuts: Cuts | None = AUTO
) -> DataFrame:
    labels = {
        "db_size_bytes": "Database",
        "volume_size_bytes": "All volumes",
        "temp_size_bytes": "Temp/spill",
    }
    near = _near(samples, series, t_from, t_to, reach, list(labels))
    filled = forward_fill(near, series, "sampled_at", list(labels), cuts)
    return _shown(filled, series, t_from, t_to, labels)


def top_tables(samples: DataFrame, t_from: Column, t_to: Column, k: int = TOP) -> DataFrame:
    counters = ["seq_scan", "idx_scan", "heap_blks_read", "idx_blks_read"]
    keys = ["schemaname", "relname"]
    live = F.max("n_live_tup").alias("live")
    grown = growth_per_day(samples, keys, "sampled_at", counters, t_from, t_to, [live])
    total = F.col("seq_scan_growth") + F.col("idx_scan_growth")
    return top_k(grown.withColumn("total", total), "total", k, keys).select(
        F.concat_ws(".", *keys).alias("Table"),
        F.col("seq_scan_growth").alias("Seq scans"),
        F.col("idx_scan_growth").alias("Index scans"),
        F.col("total").alias("Total scans"),
        F.round(F.col("total") / F.col("days"), 3).alias("Scans/day"),
        F.col("live").alias("Live rows"),
        F.col("heap_blks_read_growth").alias("Heap blocks read"),
        F.col("idx_blks_read_growth").alias("Index blocks read"),
    )


def top_queries(samples: DataFrame, t_from: Column, t_to: Column, k: int = TOP) -> DataFrame:
    keys = ["queryid", "query"]
    grown = growth_per_day(samples, keys, "sampled_at", ["calls", "total_exec_time"], t_from, t_to)
    runs, seconds = F.col("calls_growth"), F.col("total_exec_time_growth") / 1000
    return top_k(grown, runs, k, keys).select(
        F.left("query", F.lit(QUERY_TEXT_LENGTH)).alias("Query"),
        runs.alias("Runs"),
        F.round(seconds, 3).alias("Time sec"),
        F.round(runs / F.col("days"), 3).alias("Runs/day"),
        F.round(seconds / F.col("days"), 3).alias("Time sec/day"),
        F.when(runs > 0, F.round(seconds / runs, 3)).alias("Avg sec"),
    )


def _or_hour(reach: Column | None) -> Column:
    return lookback() if reach is None else reach


def _near(samples, series, t_from, t_to, reach, columns) -> DataFrame:
    """The window and what lies shortly before it, only the columns asked for."""
    return samples.where(in_window("sampled_at", t_from - _or_hour(reach), t_to)).select(
        *series, "sampled_at", *columns
    )


def _shown(frame, series, t_from, t_to, labels) -> DataFrame:
    columns = [F.col(c).alias(label) for c, label in labels.items()]
    return (
        frame.where(in_window("sampled_at", t_from, t_to))
        .select(*series, F.col("sampled_at").alias("time"), *columns)
        .orderBy("time", *series)
    )


def _rates(samples, series, t_from, t_to, reach, labels, scale: float = 1.0) -> DataFrame:
    near = _near(samples, series, t_from, t_to, reach, list(labels))
    rated = counter_rate(near, series, "sampled_at", list(labels), scale, "")
    return _shown(rated, series, t_from, t_to, labels)
