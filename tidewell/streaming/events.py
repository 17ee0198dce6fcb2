"""Event windows that serve batch frames and streams alike, and an incremental log reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def window_totals(events: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """at, event_type, n, total by window of event time; a stream drops what comes later than `late`."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("at"), "event_type", "n", "total"
    )


def session_totals(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """user_id, at, n by session: a session ends where no event follows within the gap."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = F.session_window("ts", gap)
    return events.groupBy("user_id", s.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("at"), "n")


def follow_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of a folder of Parquet event files."""
    return spark.readStream.schema(schema).parquet(path)
