"""What users can add: analysers by language, health checks, thresholds and handlers of finished batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANALYSERS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {}
HEALTH: dict[str, Callable[[DataFrame], Column]] = {}


def analyser(language: str):
    """Register a function (files, key, text) -> findings for a language; findings have key, rule_id and line."""

    def register(f):
        ANALYSERS[language] = f
        return f

    return register


def analyse(files: DataFrame, key: str, language: str, text: str) -> DataFrame:
    """Findings of every file by the analyser of its language; files of other languages give none."""
    parts = [f(files.where(F.col(language) == name), key, text).select(F.col(key), F.lit(name).alias("language"), "rule_id", "line") for name, f in sorted(ANALYSERS.items())]
    if not parts:
        raise ValueError("no analyser is registered")
    return reduce(DataFrame.unionByName, parts)


def health_check(name: str):
    """Register a function that gives an aggregate column: whether a table is healthy."""

    def register(f):
        HEALTH[name] = f
        return f

    return register


def health(df: DataFrame) -> DataFrame:
    """One row for each registered check: check, healthy; unknown (null) where nothing can be said."""
    row = df.agg(*[f(df).alias(name) for name, f in sorted(HEALTH.items())])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("healthy")) for n in sorted(HEALTH)])))


#: Limits of metrics (metric, level, comparison, limit).
THRESHOLDS = [
    ("cpu_usage", "warning", "gt", 70.0), ("cpu_usage", "critical", "gt", 90.0), ("memory_usage", "warning", "gt", 80.0), ("memory_usage", "critical", "gt", 95.0),
    ("response_time", "warning", "gt", 1.0), ("response_time", "critical", "gt", 5.0), ("error_rate", "warning", "gt", 5.0), ("error_rate", "critical", "gt", 10.0),
    ("cache_hit_rate", "warning", "lt", 70.0), ("cache_hit_rate", "critical", "lt", 50.0), ("disk_usage", "warning", "gt", 80.0), ("disk_usage", "critical", "gt", 95.0),
]


def exceeded(points: DataFrame, metric: str, value: str, thresholds=THRESHOLDS) -> DataFrame:
    """Points past a limit, with its level; a table of limits is a fixed list of any length."""
    hit = [F.when((F.col(metric) == m) & (F.col(value) > limit if way == "gt" else F.col(value) < limit if way == "lt" else F.abs(F.col(value) - limit) < 0.001), F.struct(F.lit(level).alias("level"), F.lit(limit).alias("limit"))) for m, level, way, limit in thresholds]
    return points.select("*", F.inline(F.array_compact(F.array(*hit))))


def on_batches(stream: DataFrame, checkpoint: str, *handlers: Callable[[DataFrame, int], None]) -> None:
    """Give every micro-batch of a stream to handlers (export, alerts) until the available input is used up."""

    def each(batch: DataFrame, number: int) -> None:
        for handler in handlers:
            handler(batch, number)

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
