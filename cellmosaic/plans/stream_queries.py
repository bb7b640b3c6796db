"""Streaming jobs run over the event table until it is used up, with their batch meaning in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.runtime import scratch
from ..streaming import jobs
from .registry import query, r6
from .views import table


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return jobs.file_stream(spark, d, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _places(spark):
    """Output and checkpoint folders in the shared folder that the cluster names."""
    base = scratch(spark, "spark-stream-")
    return f"{base}/out", f"{base}/state"


@query("incremental_intake", "SELECT user_id, COUNT(*) AS n FROM (SELECT DISTINCT user_id FROM events) t GROUP BY 1")
def _(spark, d):
    out, state = _places(spark)
    jobs.intake(_stream(spark, d).select("user_id", "event_type"), "user_id", out, state).start().awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_duplicates", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT md5(concat_ws(':', event_type, props)) FROM events) t")
def _(spark, d):
    out, state = _places(spark)
    hashed = _stream(spark, d).withColumn("content", F.md5(F.concat_ws(":", "event_type", "props")))
    jobs.run_to_table(jobs.suppress_duplicates(hashed, "content", delay="60 days"), out, state)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))


@query("windowed_rates", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, COUNT(*) AS n, COUNT(*) FILTER (WHERE value < 20) AS n_false,
  round(COUNT(*) FILTER (WHERE value < 20) / CAST(COUNT(*) AS DOUBLE), 6) AS false_rate
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def _(spark, d):
    out, state = _places(spark)
    rated = _stream(spark, d).withColumn("good", F.col("value") >= 20)
    jobs.run_to_table(jobs.windowed_rates(rated, label="good", by="event_type"), out, state)
    return spark.read.parquet(out).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "n_false", r6("false_rate")
    )


@query("streaming_best", """
SELECT user_id AS run, event_id AS epoch, value AS val_mean FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) t
WHERE b IS NULL OR value > b""")
def _(spark, d):
    out, state = _places(spark)
    runs = _stream(spark, d).select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("val_mean"))
    jobs.streaming_best(runs, out, state).start().awaitTermination()
    return spark.read.parquet(out).select("run", "epoch", "val_mean")


@query("running_occupancy", """
SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS cell, COUNT(DISTINCT user_id) AS n_cases FROM events GROUP BY 1, 2""")
def _(spark, d):
    out, state = _places(spark)
    cells = _stream(spark, d).withColumn("cell", F.floor(F.col("value") / 10))
    jobs.run_to_changes(jobs.running_occupancy(cells, ["event_type", "cell"], "user_id", delay="60 days"), out, state)
    return jobs.latest_rows(spark, out, ["event_type", "cell"]).select("event_type", "cell", "n_cases")


@query("streaming_bursts", """
WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, SUM(n) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g),
s AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, COUNT(*) AS n_events FROM b GROUP BY user_id, burst)
SELECT user_id, epoch_us(first_ts) AS first_us, epoch_us(last_ts) AS last_us, n_events FROM s
WHERE last_ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(spark, d):
    out, state = _places(spark)
    jobs.run_to_table(jobs.streaming_bursts(_stream(spark, d), entity="user_id", gap="6 hours"), out, state)
    return spark.read.parquet(out).select(
        "user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n_events"
    )
