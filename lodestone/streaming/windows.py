"""Structured Streaming forms of ledger queries: counts by window, duplicate delivery, evidence order and sessions.

Each takes a streaming (or batch) frame of events, so tests hold a stream's result against the batch query's. Event time is `ts` as a
timestamp; a watermark bounds the state, and the batch queries stay the truth for what comes later than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 day"


def event_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Events read from a folder of Parquet files as they come; files are the log, in any order."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def rate_window_stream(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """(window_start, event_type, n, most) by tumbling windows."""
    g = timed(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "most")


def deduplicated_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def latest_state_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """(day, job_id, profile, last_action, event_id): each day's last action in evidence order, a maximum, so late and repeated events cannot turn it back.

    The watermark ends a day's state; `latest_of` folds the days that were emitted.
    """
    rows = timed(events, late).select("ts", "event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("job_id"), (F.col("user_id") % 5).alias("profile"))
    g = rows.groupBy(F.window("ts", "1 day").alias("w"), "job_id", "profile").agg(F.max_by("event_type", "event_id").alias("last_action"), F.max("event_id").alias("event_id"))
    return g.select(F.col("w.start").alias("day"), "job_id", "profile", "last_action", "event_id")


def latest_of(days: DataFrame) -> DataFrame:
    """(job_id, profile, last_action, event_id) over the days of `latest_state_stream`."""
    return days.groupBy("job_id", "profile").agg(F.max_by("last_action", "event_id").alias("last_action"), F.max("event_id").alias("event_id"))


def session_stream(events: DataFrame, idle: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(user_id, start, end, n): sessions that an idle time ends."""
    g = timed(events, late).groupBy(F.session_window("ts", idle).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_available(stream: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> None:
    """Run a stream over what is there now, into an in-memory table: for tests and small reports."""
    stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
