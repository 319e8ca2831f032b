"""Streams of events: windowed counts with watermarks, and the latest value of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """With a watermark; times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total for each window; state older than the watermark is dropped. Works on tables too."""
    w = _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding_mean(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = _timed(events, late).groupBy(F.window("ts", width, slide)).agg(F.avg("value").alias("mean"))
    return w.select(F.col("window.start").alias("start"), "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    w = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
