"""Table loaders and the mapping of driver tables onto the engine's entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: End of the event window; queries never read the clock.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events: standard_id, usage_type, ts, session_id, value."""
    return table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").alias("standard_id"),
        F.col("event_type").alias("usage_type"),
        "ts",
        F.col("user_id").alias("session_id"),
        "value",
        "event_id",
    )


#: The same in DuckDB SQL.
USAGE_SQL = "u AS (SELECT json_extract_string(props, '$.k') AS standard_id, event_type AS usage_type, ts, user_id AS session_id, value, event_id FROM events)"
SINCE_SQL = f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"
