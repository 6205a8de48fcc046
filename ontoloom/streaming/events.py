"""Event-time operators: the same functions run over a table and over a stream.

The first argument of each is a DataFrame with a timestamp column; for a stream, `watermarked` comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def watermarked(df: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """df with a zoned timestamp and, if it is a stream, a watermark on it."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, delay) if df.isStreaming else df


def tumbling(df: DataFrame, width: str, *by: str) -> DataFrame:
    out = df.groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(df: DataFrame, width: str, step: str, *by: str) -> DataFrame:
    out = df.groupBy(F.window("ts", width, step), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(df: DataFrame, gap: str, *by: str) -> DataFrame:
    """Stretches of events less than a gap apart."""
    out = df.groupBy(F.session_window("ts", gap).alias("s"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("s.start").alias("start"), *by, "n", "total")


def over_limit(df: DataFrame, width: str, limit: int, *by: str) -> DataFrame:
    """Windows with more events than allowed."""
    return tumbling(df, width, *by).where(F.col("n") > limit).select("start", *by, "n")


def first_only(df: DataFrame, *key: str) -> DataFrame:
    """One event for each key: in a stream within the watermark, in a table the first by time."""
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark(list(key))
    from ..operators.relational import latest

    return latest(df, list(key), F.col("ts"), F.col("event_id"))


def with_static(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    return df.join(table, on)


def daily_moments(df: DataFrame, *by: str) -> DataFrame:
    """Counts and sums by day, from which any longer window follows."""
    return tumbling(df, "1 day", *by).withColumn("mean", F.col("total") / F.col("n"))
