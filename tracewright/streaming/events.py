"""Event aggregates that run alike on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and value sums per event type and time window; on a stream, state is dropped behind the watermark."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    out = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str, late: str = "1 hour") -> StreamingQuery:
    """Write each event once, by its key within the watermark; runs on what there is, then stops."""
    timed = stream.withColumn("_at", F.col("ts").cast("timestamp")).withWatermark("_at", late)
    once = timed.dropDuplicatesWithinWatermark([key]).drop("_at")
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
