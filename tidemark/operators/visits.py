"""Page visits: filter noise, parse the log, count and time sessions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import (
    NO_SESSION,
    client_address,
    col,
    dashboard_uid,
    is_json,
    log_timestamp,
    session_hash,
)
from tidemark.operators.slices import AUTO, Cuts, sliced

LOG_LINE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("ts", "app", "path", "status", "ip", "xff", "ua")]
)


@dataclass(frozen=True)
class PathRules:
    """Which paths are page visits: regular expressions in order, the first match decides.

    An empty app drops the request.
    """

    rules: tuple[tuple[str, str], ...]

    @classmethod
    def standard(cls, dashboards: str = "dashboards", admin: str = "admin") -> PathRules:
        """Single panels and dashboards are visits, and so are admin pages but for their assets."""
        return cls(
            (
                (f"^/{dashboards}/d-solo/", dashboards),
                (f"^/{dashboards}/d/", dashboards),
                (f"^/{admin}/static/", ""),
                (f"^/{admin}/", admin),
            )
        )

    def app(self, path: Column | str) -> Column:
        chosen = F
        for pattern, app in self.rules:
            chosen = chosen.when(col(path).rlike(pattern), F.lit(app))
        return chosen.otherwise(F.lit(""))


def page_views(requests: DataFrame, method: str, path: str, rules: PathRules) -> DataFrame:
    """The GET requests that are page visits, with their `app`."""
    return (
        requests.where(F.col(method) == "GET")
        .withColumn("app", rules.app(path))
        .where(F.col("app") != "")
    )


def parse_visits(
    lines: DataFrame, line: str = "value", cookies: Sequence[str] = ("dashboard_session", "admin_session")
) -> tuple[DataFrame, DataFrame]:
    """Log lines to (visits, quarantine).

    A visit has its time, app, path, dashboard, client address, session hash, status and agent;
    the session cookies are hashed here and go no further. Empty lines are no visits. A line that
    is no JSON object, or whose time or status cannot be read, goes to the quarantine with a
    `reason` instead of failing the batch.
    """
    schema = T.StructType([*LOG_LINE.fields, *[T.StructField(c, T.StringType()) for c in cookies]])
    # Unpacked by a generator, a line is parsed once; field by field it would be once per field.
    raw = lines.where(F.col(line) != "").select(
        F.col(line).alias("line"), F.inline(F.array(F.from_json(F.col(line), schema)))
    )
    status = F.nullif(F.col("status"), F.lit(""))
    parsed = raw.select(
        "line",
        log_timestamp("ts").alias("visited_at"),
        "app",
        F.col("path").alias("url_path"),
        dashboard_uid("path").alias("dashboard_uid"),
        client_address("xff", "ip").alias("client_ip"),
        session_hash(*cookies).alias("session_hash"),
        status.try_cast("int").alias("status"),
        F.col("ua").alias("user_agent"),
        F.when(~is_json("line"), "not JSON")
        .when(~F.col("line").rlike(r"^\s*\{"), "not an object")
        .when(log_timestamp("ts").isNull(), "bad ts")
        .when(status.isNotNull() & status.try_cast("int").isNull(), "bad status")
        .alias("reason"),
    )
    visits = parsed.where(F.col("reason").isNull()).drop("line", "reason")
    return visits, parsed.where(F.col("reason").isNotNull()).select("line", "reason")


def valid_json(lines: DataFrame, line: str) -> DataFrame:
    """The lines that hold something and parse as JSON."""
    return lines.where((F.col(line) != "") & is_json(line))


def visits_by(visits: DataFrame, *what: Column) -> DataFrame:
    """Visit counts by dashboard, hour of day, weekday or whatever else is given."""
    return visits.groupBy(*what).agg(F.count(F.lit(1)).alias("visits"))


def distinct_sessions(
    visits: DataFrame, by: Sequence[str], session: str, approximate: bool = False
) -> DataFrame:
    """Number of sessions per group. Visits without a cookie share one hash and are left out.

    The exact count first reduces to distinct (group, session) pairs, so that no group has to
    fit into one task.
    """
    known = visits.where(F.col(session) != NO_SESSION)
    if approximate:
        return known.groupBy(*by).agg(F.approx_count_distinct(session).alias("sessions"))
    pairs = known.select(*by, session).distinct()
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("sessions"))


def sessions_dwell(
    visits: DataFrame, session: str, ts: str, tie: Sequence[str] = (), cuts: Cuts | None = AUTO
) -> DataFrame:
    """Add `dwell`: seconds until the session's next visit, NULL on its last one.

    `session` may be any type; visits without a cookie are left out, as they are not one session.
    """
    known = visits.where(F.col(session).cast("string") != NO_SESSION)
    stamped = known.withColumn("_at", F.col(ts))
    s = sliced(stamped, [session], [ts, *tie], ["_at"], cuts, reverse=True)
    following = F.lag("_at").over(s.window())
    dwell = (F.unix_micros(following) - F.unix_micros(ts)) / F.lit(1e6)
    return s.done(s.rows.withColumn("dwell", dwell)).drop("_at")
