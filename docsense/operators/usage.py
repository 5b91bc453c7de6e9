"""Usage analytics: windowed counts, popularity, trends, gaps and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsense.operators.orderstats import placed

USAGE_TYPES = ("click", "error", "purchase", "signup", "view")
RANGES = {"7d": 7, "30d": 30, "90d": 90, "1y": 365}


def window_days(time_range: str) -> int:
    """Days of a range such as 7d, 2w, 3m, 1y, 12h (at least one day); anything else is 30 days."""
    unit = {"d": 1.0, "w": 7.0, "m": 30.0, "y": 365.0, "h": 1 / 24}
    if time_range in RANGES:
        return RANGES[time_range]
    if time_range[:-1].isdigit() and time_range[-1:] in unit:
        return max(1, int(int(time_range[:-1]) * unit[time_range[-1]]))
    return 30


def within(events: DataFrame, end: Column, time_range: str = "30d") -> DataFrame:
    return events.where(F.col("ts") >= end - F.make_dt_interval(F.lit(window_days(time_range))))


def by_type(events: DataFrame) -> DataFrame:
    """Per standard and usage type: uses, distinct sessions, first and last use."""
    return events.groupBy("standard_id", "usage_type").agg(
        F.count(F.lit(1)).alias("uses"), F.countDistinct("session_id").alias("sessions"), F.min("ts").alias("first_used"), F.max("ts").alias("last_used")
    )


def rollup(events: DataFrame) -> DataFrame:
    """Per standard: total use, sessions summed over types, exact distinct sessions, true first and last use, and the first
    and last use of its most frequent type (ties to the smaller name)."""
    typed = by_type(events).withColumn("lead", F.struct(-F.col("uses"), "usage_type"))
    sums = typed.groupBy("standard_id").agg(
        F.sum("uses").alias("total_usage"),
        F.sum("sessions").alias("sessions_sum"),
        F.min("first_used").alias("first_used"),
        F.max("last_used").alias("last_used"),
        F.min_by("usage_type", "lead").alias("top_type"),
        F.min_by("first_used", "lead").alias("first_used_top_type"),
    )
    exact = events.groupBy("standard_id").agg(F.countDistinct("session_id").alias("unique_sessions"))
    return sums.join(exact, "standard_id")


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy("standard_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("uses"))


def trend(days: DataFrame) -> DataFrame:
    """Least-squares slope of daily uses over the ordinal of days with data; rising or falling beyond 0.1."""
    order = Window.partitionBy("standard_id").orderBy("day")
    numbered = days.withColumn("i", (F.row_number().over(order) - 1).cast("double"))
    fitted = numbered.groupBy("standard_id").agg(F.count(F.lit(1)).alias("days"), F.regr_slope(F.col("uses").cast("double"), "i").alias("raw"))
    slope = F.round(F.when(F.col("days") < 2, 0.0).otherwise(F.coalesce("raw", F.lit(0.0))), 6)
    return fitted.select(
        "standard_id",
        "days",
        slope.alias("slope"),
        F.when(slope > 0.1, "rising").when(slope < -0.1, "falling").otherwise("stable").alias("direction"),
        F.round(F.when(F.col("days") < 2, 0.0).otherwise(F.least(F.col("days") / 14, F.lit(1.0))), 6).alias("confidence"),
    )


def popularity(events: DataFrame, end: Column) -> DataFrame:
    """Weighted score .4 use + .3 sessions + .2 recency + .1 trend, each against the maximum, ranked."""
    joined = rollup(events).join(trend(daily(events)), "standard_id")
    # The maxima are one row whatever the number of standards.
    top = joined.agg(F.max("total_usage").alias("most_used"), F.max("sessions_sum").alias("most_sessions"))
    days = F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col("last_used").cast("timestamp"))) / F.lit(86_400_000_000))
    scored = joined.crossJoin(F.broadcast(top)).select(
        "standard_id",
        "total_usage",
        F.col("sessions_sum").alias("unique_sessions"),
        F.coalesce(F.try_divide(F.col("total_usage").cast("double"), "most_used"), F.lit(0.0)).alias("u"),
        F.coalesce(F.try_divide(F.col("sessions_sum").cast("double"), "most_sessions"), F.lit(0.0)).alias("s"),
        F.greatest(F.lit(0.0), 1 - days / 30.0).alias("r"),
        F.when(F.col("direction") == "rising", 0.8).when(F.col("direction") == "falling", 0.2).otherwise(0.5).alias("t"),
    )
    score = F.round(0.4 * F.col("u") + 0.3 * F.col("s") + 0.2 * F.col("r") + 0.1 * F.col("t"), 6)
    parts = [F.round(c, 6).alias(n) for c, n in (("u", "usage_score"), ("s", "session_score"), ("r", "recency_score"), ("t", "trend_score"))]
    final = scored.select("standard_id", "total_usage", "unique_sessions", *parts, score.alias("popularity_score"))
    return placed(final.withColumn("_down", -F.col("popularity_score")), ["_down", "standard_id"], "rank").drop("_down")


def under_represented(counts: DataFrame, value: str, share: float) -> DataFrame:
    """Groups whose count lies under ``share`` of the mean count."""
    mean = counts.agg(F.avg(value).alias("mean_count"))
    return counts.crossJoin(F.broadcast(mean)).where(F.col(value) < share * F.col("mean_count"))


def catalogue_shortage(counts: DataFrame, key: str, wanted: list[str], least: int = 2) -> DataFrame:
    """Wanted names that occur fewer than ``least`` times, absent ones included."""
    names = counts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("name"))
    joined = names.join(counts, F.col("name") == F.col(key), "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    return joined.where(F.col("n") < least)
