"""Metric summaries, percentiles, outliers, moving statistics, trends, forecasts and regressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.operators.orderstats import BLOCK, Rank, blocked, deviations, numbered, of_keys, percentiles
from docsense.operators.staging import staged

def summary_nearest_rank(points: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, min, max, mean and nearest-rank percentiles: elements int(n p / 100), clamped, of the sorted values."""
    ranks = percentiles(points, [key], value, [Rank(f"p{p}", p / 100, linear=False) for p in (50, 95, 99)])
    basic = points.groupBy(key).agg(F.round(F.sum(value), 4).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))
    return of_keys(ranks, basic, [key]).select(key, "n", "total", "low", "high", "mean", "p50", "p95", "p99")


def summary_linear(points: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, median, sample deviation (0 for one point), variation, IQR and linear percentiles."""
    ranks = percentiles(points, [key], value, [Rank(f"q{p}", p / 100) for p in (25, 50, 75, 90, 95, 99)])
    basic = points.groupBy(key).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    q = lambda p: F.round(f"q{p}", 6)
    return of_keys(ranks, basic, [key]).select(
        key,
        "n",
        F.round("mean", 6).alias("mean"),
        q(50).alias("median"),
        F.round("sd", 6).alias("sd"),
        F.round(F.coalesce(F.try_divide("sd", "mean"), F.lit(0.0)), 6).alias("cv"),
        F.round(F.col("q75") - F.col("q25"), 6).alias("iqr"),
        q(90).alias("p90"),
        q(95).alias("p95"),
        q(99).alias("p99"),
    )


def outliers(points: DataFrame, key: str, value: str) -> DataFrame:
    """Flags by quartile fences, z-score (3) and modified z-score (3.5); zero spread flags nothing."""
    ranks = staged(percentiles(points, [key], value, [Rank("q1", 0.25), Rank("median", 0.5), Rank("q3", 0.75)]).drop("n"), "quartiles")
    basic = points.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    limits = of_keys(of_keys(ranks, basic, [key]), deviations(points, [key], value, ranks, "median"), [key])
    around = of_keys(points, limits, [key])
    v = F.col(value)
    spread = F.col("q3") - F.col("q1")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return around.withColumns(
        {
            "by_iqr": flag((spread > 0) & ((v < F.col("q1") - 1.5 * spread) | (v > F.col("q3") + 1.5 * spread))),
            "by_z": flag((F.col("sd") > 0) & (F.abs(F.try_divide(v - F.col("mean"), "sd")) > 3)),
            "by_mad": flag((F.col("mad") > 0) & (F.abs(F.try_divide(0.6745 * (v - F.col("median")), "mad")) > 3.5)),
        }
    )


def zscores(points: DataFrame, key: str, value: str, limit: float = 3.0, least: int = 10) -> DataFrame:
    """Points more than ``limit`` sample deviations from the mean of their key, with z; keys of ``least`` points and more that
    have spread."""
    spread = points.groupBy(key).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= least) & (F.col("_sd") > 0))
    z = (F.col(value) - F.col("_mean")) / F.col("_sd")
    return points.join(spread, key).where(F.abs(z) > limit).withColumn("z", F.round(z, 6)).drop("_mean", "_sd", "_n")


def moving_average(points: DataFrame, key: str, order: str, value: str, width: int = 5, block: int = BLOCK) -> DataFrame:
    """Means of full windows only; the width is clipped to the number of points. Orders are distinct within a key."""
    dealt, by, own = blocked(points, [key], [order], 0, width - 1, block)
    out = dealt.withColumn("ma", F.round(F.avg(value).over(by.rowsBetween(0, width - 1)), 6)).where(own).drop("_block")
    return out.where(F.col("i") <= F.greatest(F.col("n") - width + 1, F.lit(1)))


def exponential_average(points: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """The last exponential moving average of each series, as a closed weighted sum: no ordered fold is needed."""
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(alpha)
    return numbered(points, [key], [order]).groupBy(key).agg(F.round(F.sum(weight * F.col(value)), 6).alias("ema"))


def trend_direction(points: DataFrame, key: str, order: str, value: str, width: int = 5) -> DataFrame:
    """Last against first ``width`` moving averages, beyond 5 %; fewer than two widths of points don't suffice."""
    ma = moving_average(points, key, order, value, width)
    m = F.col("n") - width + 1
    sides = ma.groupBy(key).agg(F.max("n").alias("n"), F.avg(F.when(F.col("i") <= width, F.col("ma"))).alias("early"), F.avg(F.when(F.col("i") > m - width, F.col("ma"))).alias("late"))
    change = F.try_divide(F.col("late") - F.col("early"), "early")
    return sides.select(key, "n", F.when(F.col("n") < 2 * width, "insufficient_data").when(change > 0.05, "increasing").when(change < -0.05, "decreasing").otherwise("stable").alias("direction"))


def half_split_trend(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    halves = numbered(points, [key], [order]).withColumn("early", F.col("i") <= F.floor(F.col("n") / 2))
    sides = halves.groupBy(key).agg(F.round(F.avg(F.when(F.col("early"), F.col(value))), 6).alias("early_mean"), F.round(F.avg(F.when(~F.col("early"), F.col(value))), 6).alias("late_mean"))
    return sides.withColumn("direction", F.when(F.col("late_mean") > 1.1 * F.col("early_mean"), "increasing").when(F.col("late_mean") < 0.9 * F.col("early_mean"), "decreasing").otherwise("stable"))


def neighbour_anomalies(points: DataFrame, key: str, order: str, value: str, limit: float = 0.5, block: int = BLOCK) -> DataFrame:
    dealt, by, own = blocked(points, [key], [order], 1, 1, block)
    near = dealt.withColumns({"before": F.lag(value).over(by), "after": F.lead(value).over(by)}).where(own).withColumn("expected", (F.col("before") + F.col("after")) / 2)
    return near.where((F.col("expected") > 0) & (F.abs(F.col(value) - F.col("expected")) > limit * F.col("expected")))


def change_points(points: DataFrame, key: str, order: str, value: str, width: int = 5, limit: float = 0.2, least: int = 20, block: int = BLOCK) -> DataFrame:
    dealt, by, own = blocked(points, [key], [order], width, width - 1, block)
    out = dealt.withColumns({"before": F.avg(value).over(by.rowsBetween(-width, -1)), "after": F.avg(value).over(by.rowsBetween(0, width - 1))}).where(own).drop("_block")
    inner = (F.col("n") >= least) & (F.col("i") > width) & (F.col("i") <= F.col("n") - width + 1)
    return out.where(inner & (F.col("before") > 0) & (F.abs(F.col("after") - F.col("before")) > limit * F.col("before")))


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation over the rows where both are given; null without spread (where ``corr`` fails)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def linear_trend(points: DataFrame, key: str, x: str, value: str) -> DataFrame:
    return points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.regr_slope(value, x), 6).alias("slope"), F.round(F.regr_intercept(value, x), 6).alias("intercept"), F.round(correlation(value, x), 6).alias("r")
    )


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: the regularised incomplete beta function at df / (df + t^2), by its continued fraction."""
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        a, b, x, flipped = b, a, 1 - x, True
    else:
        flipped = False
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz's method: odd and even coefficients in turn.
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    value = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + term * d)
            c = 1.0 + term / c
            value *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return 1 - front * value if flipped else front * value


def trend_significance(points: DataFrame, key: str, x: str, value: str, level: float = 0.05) -> DataFrame:
    """Slope, correlation and the p-value of a linear trend; one row per key, so the tail runs on aggregates only.

    The p-value is null for fewer than three points or without spread, 0 for an exact line.
    """

    @F.pandas_udf("double")
    def tail(r: pd.Series, n: pd.Series) -> pd.Series:
        one = lambda c, k: None if k < 3 or c != c else 0.0 if abs(c) >= 1 else t_tail(c * math.sqrt((k - 2) / (1 - c * c)), k - 2)
        return pd.Series([one(c, k) for c, k in zip(r.astype("float64"), n)], dtype="float64")

    fitted = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(value, x).alias("slope"), correlation(value, x).alias("r"))
    return fitted.select(key, "n", F.round("slope", 6).alias("slope"), F.round("r", 6).alias("r"), F.round(tail("r", "n"), 9).alias("p")).withColumn("significant", F.coalesce(F.col("p") < level, F.lit(False)))


def forecast(points: DataFrame, key: str, order: str, value: str, steps: int = 3, a_step: int = 24) -> DataFrame:
    """Linear forecast of hourly points, ``steps`` days ahead, not below zero, with two deviations of the values that widen
    by a tenth a step. Points are numbered 0 to n - 1 in their order; day d is x = n + 24 d. Five points at least."""
    placed = numbered(points, [key], [order]).withColumn("x", (F.col("i") - 1).cast("double")).drop("n")
    fit = placed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(value, "x").alias("b"), F.regr_intercept(value, "x").alias("a"), F.stddev_samp(value).alias("sd")).where("n >= 5")
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    mean = F.greatest(F.col("a") + F.col("b") * (F.col("n") + a_step * F.col("step")), F.lit(0.0))
    half = 2 * F.col("sd") * (1 + 0.1 * F.col("step"))
    return ahead.select(key, "step", F.round(mean, 4).alias("forecast"), F.round(F.greatest(mean - half, F.lit(0.0)), 4).alias("low"), F.round(mean + half, 4).alias("high"))


def percent_change(baseline: Column, current: Column) -> Column:
    return F.when(baseline == 0, F.when(current > 0, 100.0).otherwise(0.0)).otherwise((current - baseline) / baseline * 100)


def regressions(baseline: DataFrame, current: DataFrame, key: str, warn: float = 10.0, critical: float = 20.0) -> DataFrame:
    """Full outer comparison of two runs (columns key and value): new, removed, unchanged, improvement or regression."""
    a, b = baseline.select(key, F.col("value").alias("was")), current.select(key, F.col("value").alias("now"))
    change = percent_change(F.col("was"), F.col("now"))
    status = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.abs(change) < 5, "unchanged").when(change >= critical, "critical").when(change >= warn, "regression").when(change <= -warn, "improvement").otherwise("unchanged")
    )
    return a.join(b, key, "full_outer").select(key, F.round("was", 4).alias("was"), F.round("now", 4).alias("now"), F.round(change, 4).alias("change"), status.alias("status"))


def compare(points: DataFrame, group: str, left: str, right: str, value: str) -> DataFrame:
    """Mean difference, ratio and Cohen's d of two groups, with its usual label."""
    pick = lambda f, g: f(F.when(F.col(group) == g, F.col(value)))
    row = points.agg(pick(F.avg, left).alias("m1"), pick(F.avg, right).alias("m2"), pick(F.var_samp, left).alias("v1"), pick(F.var_samp, right).alias("v2"))
    d = F.abs(F.try_divide(F.col("m2") - F.col("m1"), F.sqrt((F.col("v1") + F.col("v2")) / 2)))
    label = F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").otherwise("large")
    return row.select(F.round(F.col("m2") - F.col("m1"), 6).alias("difference"), F.round(F.try_divide("m2", "m1"), 6).alias("ratio"), F.round(d, 6).alias("cohens_d"), label.alias("effect"))


def histogram(points: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """Counts by the first bound that a value doesn't exceed, else ``inf``; not cumulative."""
    bucket = F.lit("inf")
    for bound in reversed(bounds):
        bucket = F.when(F.col(value) <= bound, F.lit(f"{bound:g}")).otherwise(bucket)
    return points.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
