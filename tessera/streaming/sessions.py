"""Structured Streaming forms of two batch operators; extensions, with the batch operators as their reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def session_counts(plays: DataFrame, gap_seconds: int, late: str = "1 hour", min_listened: float = 30.0) -> DataFrame:
    """Plays and seconds of each user's session in a stream with ts, user_id, listened; state is dropped at the watermark.

    Like the batch operator a gap of exactly ``gap_seconds`` stays inside a session: windows merge if they touch.
    """
    kept = plays.where(F.col("listened") >= min_listened).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.session_window("ts", f"{gap_seconds} seconds")
    return kept.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("plays"), F.sum("listened").alias("secs")).select("user_id", F.col("w.start").alias("start"), "plays", "secs")


def window_counts(plays: DataFrame, days: int, late: str = "1 day") -> DataFrame:
    """Plays and listeners (approximate) of tumbling windows of days."""
    w = F.window(F.col("ts").cast("timestamp"), f"{days} days")
    stamped = plays.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(w.alias("w")).agg(F.count("*").alias("plays"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "plays", "users")
