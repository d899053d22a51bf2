"""The streaming jobs, run over tables as far as those go; the results are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import host
from tidemark.plans.synthetic.hosts import REPLACE, ROLLUP_SQL, ROUNDED, SERIES, rounded, samples
from tidemark.plans.synthetic.registry import query
from tidemark.plans.synthetic.visiting import log_lines
from tidemark.session import STATE_STORE, load, work_path
from tidemark.streaming.rollup import gauge_stream, hourly_table, rollup_stream
from tidemark.streaming.sets import assemble_stream
from tidemark.streaming.visits import log_stream, store_visits


def streamed(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """A table as a stream: written to a folder that is then read file by file."""
    path = work_path(spark, name)
    frame.write.parquet(path)
    return spark.readStream.schema(frame.schema).parquet(path)


def finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@query(
    "r1_v6_visit_stream",
    """SELECT event_type, count(*) AS visits FROM events
       WHERE event_type IN ('view', 'click', 'purchase') GROUP BY event_type""",
)
def visit_stream(spark, sf):
    logs, visits, bad = (work_path(spark, n) for n in ("logs", "visits", "quarantine"))
    log_lines(spark, sf).write.text(logs)
    finish(store_visits(log_stream(spark, logs), visits, bad, work_path(spark, "state"), once=True))
    kind = (
        F.when(F.col("url_path").contains("/d/"), "view")
        .when(F.col("url_path").contains("/d-solo/"), "click")
        .otherwise("purchase")
    )
    stored = spark.read.parquet(visits)
    return stored.groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("visits"))


@query("r2_rollup_stream", f"SELECT * REPLACE ({REPLACE}) FROM ({ROLLUP_SQL})")
def rolled(spark, sf):
    path = work_path(spark, "rollup")
    stream = streamed(spark, samples(spark, sf), "samples")
    finish(
        rollup_stream(
            stream, SERIES, "sampled_at", host.HOST_ROLLUP, path, work_path(spark, "state"), once=True
        )
    )
    return rounded(hourly_table(spark, path), *ROUNDED)


# An hour is out once the watermark, two days behind the latest sample, has passed it.
@query(
    "r2_gauge_stream",
    """SELECT * FROM (SELECT user_id AS host, date_trunc('hour', ts) AS bucket, count(*) AS samples,
         round(avg(CAST(round(value * 100) AS BIGINT) * 1024), 6) AS mem_bytes_avg,
         max(CAST(round(value * 100) AS BIGINT) * 1024) AS mem_bytes_max FROM events GROUP BY 1, 2)
       WHERE bucket + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""",
)
def gauges(spark, sf):
    out = work_path(spark, "gauges")
    stream = streamed(spark, samples(spark, sf), "samples")
    hours = gauge_stream(stream, SERIES, "sampled_at", host.HOST_ROLLUP.gauges, "2 days")
    finish(
        hours.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", work_path(spark, "state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    return rounded(spark.read.schema(hours.schema).parquet(out), "mem_bytes_avg")


# A conversation is a set and its turns are the parts; the third turn brings the commit. When all is read, a part and a second
# commit come for each committed set.
TURN_AT = "TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 10 + turn AS BIGINT))"


@query(
    "r3_d11_d12_assembly_stream",
    f"""WITH s AS (SELECT conv_id, count(*) AS parts, max({TURN_AT}) AS last_part, bool_or(turn = 2) AS committed,
          bool_or(length(text) > 800) AS cut FROM conversations GROUP BY conv_id),
        m AS (SELECT max({TURN_AT}) + INTERVAL 1 MINUTE AS after FROM conversations)
        SELECT CAST(conv_id AS VARCHAR) AS set_id, parts, last_part,
          CASE WHEN committed AND cut THEN 'truncated' WHEN committed THEN 'complete' ELSE 'abandoned' END AS status
        FROM s, m WHERE committed OR last_part + INTERVAL 1 HOUR < after - INTERVAL 10 MINUTE
        UNION ALL SELECT CAST(conv_id AS VARCHAR), 1, after, 'late' FROM s, m WHERE committed""",
)
def assembly(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    minute = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(
        mins=(F.col("conv_id") * 10 + F.col("turn")).cast("int")
    )
    parts = load(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("set_id"), minute.alias("at"), F.lit("part").alias("kind"),
        (F.length("text") > 800).alias("truncated"), "turn",
    )
    commits = parts.where(F.col("turn") == 2).withColumn("kind", F.lit("commit"))
    after = parts.agg((F.max("at") + F.expr("INTERVAL 1 MINUTE")).alias("at"))
    kinds = F.explode(F.array(F.lit("part"), F.lit("commit"))).alias("kind")
    late = commits.select("set_id", kinds, "truncated").join(F.broadcast(after)).select("set_id", "at", "kind", "truncated")

    source, out, state = (work_path(spark, n) for n in ("messages", "sets", "state"))
    for messages in (parts.unionByName(commits).drop("turn"), late):
        messages.write.mode("append").parquet(source)
        # The second run goes on from the state of the first.
        stream = spark.readStream.schema(messages.schema).parquet(source)
        statuses = assemble_stream(stream, 3600, "10 minutes", remember_seconds=10 * 366 * 86_400)
        finish(
            statuses.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", state)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
    return spark.read.schema(statuses.schema).parquet(out)
