"""Tumbling counts, in batch and over a stream; offered because Spark has them, not because a scan needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of windows of event time; the totals are exact decimals."""
    at = F.window(F.col("ts"), width)
    total = F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total")
    counted = events.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), total)
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_tumbling(spark: SparkSession, path: str, schema, width: str = "1 hour", late: str = "2 hours") -> DataFrame:  # noqa: ANN001
    """The same over a folder of Parquet files as they come; events later than `late` are dropped with their window's state."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return tumbling(events.withWatermark("ts", late), width)
