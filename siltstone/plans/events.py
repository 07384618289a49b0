"""Queries in event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.plans.similarity import rounded
from siltstone.runtime import scratch, table
from siltstone.streaming import incremental as inc


def events(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")


def tumbling_counts(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = inc.windowed_counts(rows, "ts", ["event_type"], "value", "1 hour")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), places=4)


def sliding_counts(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = inc.windowed_counts(rows, "ts", [], "value", "2 hours", "1 hour")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), places=4)


def user_sessions(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return inc.sessions(rows, "ts", "user_id", "6 hours").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def first_deliveries(spark, sf_dir):
    return inc.first_deliveries(events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"])


def incremental_best(spark, sf_dir):
    """The best of the first half of the events merged with the second half, as a stream would do it."""
    rows = events(spark, sf_dir).select("event_type", "event_id", "value")
    half = rows.where("event_id % 2 = 0")
    empty = half.where("false")
    first = inc.merged_best(empty, half, "event_type", "event_id", "value", 5)
    return inc.merged_best(first, rows.where("event_id % 2 = 1"), "event_type", "event_id", "value", 5)


def stream_of(spark, sf_dir, *columns):
    """The events as a stream, with a watermark on ts."""
    schema = table(spark, sf_dir, "events", *columns).schema
    return inc.event_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")


def streamed_counts(spark, sf_dir):
    """The tumbling counts by a streaming query with a watermark."""
    folder = scratch(spark)
    counts = inc.windowed_counts(stream_of(spark, sf_dir, "event_id", "ts", "event_type", "value"), "ts", ["event_type"], "value", "1 hour")
    inc.written_whole(counts, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.schema(counts.schema).parquet(f"{folder}/counts")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), places=4)


def streamed_best(spark, sf_dir):
    """The five greatest events of each type, kept by a streaming query."""
    folder = scratch(spark)
    stream = stream_of(spark, sf_dir, "event_id", "ts", "event_type", "value")
    inc.keep_best(stream, f"{folder}/best", f"{folder}/checkpoint", "event_type", "event_id", "value", 5).awaitTermination()
    return inc.newest_version(spark, f"{folder}/best")


ORACLE = {
    "tumbling_counts": "SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_counts": "WITH w AS (SELECT unnest([date_trunc('hour', ts)::TIMESTAMP, date_trunc('hour', ts)::TIMESTAMP - INTERVAL 1 HOUR]) AS start, value FROM events) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1",
    "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s",
    "first_deliveries": "SELECT DISTINCT user_id, event_type FROM events",
    "incremental_best": "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 5",
}
ORACLE["streamed_counts"] = ORACLE["tumbling_counts"]
ORACLE["streamed_best"] = ORACLE["incremental_best"]
QUERIES = {name: globals()[name] for name in ORACLE}
