"""Trailing means over a stream of events: the streaming form of the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trailing_means(events: DataFrame, ts: str, value: str, *, days: int = 7, late: str = "1 day") -> DataFrame:
    """day (the last of each window) and the mean of the `days` days up to it; events that are late by more than
    `late` are left out, and state is dropped behind the watermark."""
    stream = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    w = stream.groupBy(F.window("_ts", f"{days} days", "1 day").alias("w")).agg(F.avg(value).alias("trailing_mean"), F.count(value).alias("n"))
    return w.select(F.date_sub(F.to_date("w.end"), 1).alias("day"), "trailing_mean", "n")


def first_seen(events: DataFrame, ts: str, key: str, *, late: str = "1 day") -> DataFrame:
    """key and its first event, updated as events arrive."""
    stream = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return stream.groupBy(key).agg(F.min("_ts").alias("first_seen"))
