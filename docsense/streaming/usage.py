"""Structured Streaming twins of the windowed usage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Event files as a stream, ``files`` at a time, with event time for watermarks."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("event_time", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Sliding counts and means of each event type; state older than the watermark is dropped."""
    w = F.window("event_time", width, slide)
    out = events.withWatermark("event_time", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select("w.start", "w.end", "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    s = F.session_window("event_time", gap)
    return events.withWatermark("event_time", late).groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("s.start", "s.end", "user_id", "n")


def unique_within(events: DataFrame, keys: list[str], late: str = "30 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all available input into Parquet and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
