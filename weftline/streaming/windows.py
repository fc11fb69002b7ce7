"""Structured Streaming variants of the hour bucketing and of response counts (an extension: the
batch operators are the pipeline's own). Late events beyond the watermark are dropped by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_activity(events: DataFrame, entity: str, ts: str, late: str = "2 hours") -> DataFrame:
    """(entity, hour, events): clock-hour counts of a stream or a batch; ``ts`` is a timestamp."""
    e = events.where(F.col(entity).isNotNull()).withWatermark(ts, late)
    return e.groupBy(F.window(ts, "1 hour").alias("w"), entity).agg(F.count("*").alias("events")).select(entity, F.col("w.start").alias("hour"), "events")


def sessions(events: DataFrame, entity: str, ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(entity, start, end, events): bursts of activity separated by gaps."""
    e = events.where(F.col(entity).isNotNull()).withWatermark(ts, late)
    return e.groupBy(F.session_window(ts, gap).alias("w"), entity).agg(F.count("*").alias("events")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def distinct_events(events: DataFrame, event: str, ts: str, late: str = "2 hours") -> DataFrame:
    """The stream without repeated event ids; state is kept only as long as the watermark allows."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([event])


def append(df: DataFrame, path: str, checkpoint: str):
    """Writes a stream to Parquet exactly once, everything available now, and waits for the end."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
