"""Sinks: validated usage events, search index and reference files, benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsense.operators.usage import USAGE_TYPES


def append_events(events: DataFrame, path: str) -> None:
    """Append usage events of known types, partitioned by date and sorted by standard and time; others are dropped.

    Readers that filter by date skip folders, and by standard skip row groups.
    """
    known = events.where(F.col("usage_type").isin(*USAGE_TYPES)).withColumn("date", F.to_date("ts"))
    known.repartition("date").sortWithinPartitions("date", "standard_id", "ts").write.mode("append").partitionBy("date").parquet(path)


def read_events(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Events from a date on (the whole log without one)."""
    events = spark.read.parquet(path)
    return events.where(F.col("date") >= F.lit(since).cast("date")) if since else events


def save_references(edges: DataFrame, concepts: DataFrame, folder: str) -> None:
    """References and concepts as JSON lines; written anew each time, so that a second run doubles nothing."""
    edges.write.mode("overwrite").json(f"{folder}/references")
    concepts.write.mode("overwrite").json(f"{folder}/concepts")


def load_references(spark: SparkSession, folder: str, edges: str, concepts: str) -> tuple[DataFrame, DataFrame]:
    """What ``save_references`` wrote, with the given schemas."""
    return spark.read.schema(edges).json(f"{folder}/references"), spark.read.schema(concepts).json(f"{folder}/concepts")


def import_index(spark: SparkSession, path: str, schema: str, indexed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Documents of an exported index (JSON lines), without those that are indexed already."""
    rows = spark.read.schema(schema).json(path)
    return rows.join(indexed.select(key), key, "left_anti") if indexed is not None else rows


def save_results(results: DataFrame, path: str) -> None:
    """Benchmark results as JSON lines, a folder for each benchmark."""
    results.write.mode("append").partitionBy("benchmark").json(path)


def load_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All saved results; the benchmark comes from the folder's name."""
    return spark.read.schema(schema).json(path)
