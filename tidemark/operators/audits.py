"""Data audits: each returns the offending rows, and a table with any is not published."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import any_of, distinct_from
from tidemark.operators.slices import AUTO, Cuts, find_cuts, sliced
from tidemark.sinks import versions


class AuditFailed(Exception):
    """A table broke an audit and was not published."""


def audit_unique(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations that occur more than once, with their `rows`."""
    counted = frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    return counted.where(F.col("rows") > 1)


def audit_not_null(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.where(any_of(F.col(c).isNull() for c in columns))


def audit_known_tenant(frame: DataFrame) -> DataFrame:
    """Rows that cannot be attributed to a tenant and an item."""
    return audit_not_null(frame, ["tenant_id", "issue_id"])


def audit_every_row_is_a_change(
    frame: DataFrame,
    key: str,
    ts: str,
    payload: Sequence[str],
    cuts: Cuts | None = AUTO,
) -> DataFrame:
    """Rows whose payload equals that of the item's previous row."""
    if cuts is AUTO:
        cuts = find_cuts(frame, [key], ts)
    columns = [f"_p_{c}" for c in payload]
    thin = frame.select(key, ts, *[F.col(c).alias(p) for c, p in zip(payload, columns)])
    # Only a carry row needs the row before as one value.
    thin = thin.withColumn("_now", F.struct(ts, *columns)) if cuts else thin
    s = sliced(thin, [key], [ts], ["_now"], cuts)
    was = lambda c: F.lag("_now").over(s.window())[c] if s.split else F.lag(c).over(s.window())
    changed = any_of(distinct_from(p, was(p)) for p in columns)
    return (
        s.done(s.rows.withColumn("previous", was(ts)).withColumn("_changed", changed))
        .where(~F.col("_changed") & F.col("previous").isNotNull())
        .select(key, ts, "previous")
    )


Audit = Callable[[DataFrame], DataFrame]


def publish(frame: DataFrame, audits: Mapping[str, Audit], path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `frame` beside the versioned table at `path`, audit what was written, and only then make it the table.

    The candidate is computed and written once: the audits read the files that then count, and a reader sees either the table
    before or the whole new one. Raises AuditFailed with a few of the offending rows, leaving the table as it was.
    """
    spark = frame.sparkSession
    commit = versions.write_rows(frame, path, partition_by)
    candidate = versions.read_commits(spark, path, [commit]).select(*frame.columns)
    for name, audit in audits.items():
        offending = audit(candidate).limit(5).collect()
        if offending:
            versions.discard_rows(spark, path, commit)
            raise AuditFailed(f"{name}: {[r.asDict() for r in offending]}")
    return versions.read_version(spark, path, versions.add_version(spark, path, commit)).select(*frame.columns)
