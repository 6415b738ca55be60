"""Structured Streaming variants: records that repeat, and evaluation records that arrive as training records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """The first record of each key within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def repeated_counts(stream: DataFrame, key: str, time_col: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Keys that occur more than once in a window of event time."""
    windowed = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window), F.col(key)).agg(F.count("*").alias("n"))
    return windowed.where("n > 1").select(F.col("window.start").alias("window_start"), key, "n")


def stream_overlap(training: DataFrame, evaluation: DataFrame, key: str, time_col: str, within: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Training and evaluation records of equal key that arrive within a span of each other."""
    t = training.withWatermark(time_col, delay).alias("t")
    e = evaluation.withWatermark(time_col, delay).alias("e")
    near = F.expr(f"t.{key} = e.{key} AND e.{time_col} BETWEEN t.{time_col} - INTERVAL {within} AND t.{time_col} + INTERVAL {within}")
    return t.join(e, near).select(F.col(f"t.{key}").alias(key), F.col(f"t.{time_col}").alias("training_time"), F.col(f"e.{time_col}").alias("evaluation_time"))
