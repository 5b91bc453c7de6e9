"""Dashboards, request and cache statistics, load levels, benchmark comparison and alert rules over metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsense.operators.orderstats import Rank, of_keys, percentiles


def share(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """A ratio that is ``otherwise`` where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(otherwise))


def dashboard(calls: DataFrame, error: Column, hit: Column, miss: Column) -> DataFrame:
    """One row: total calls, error and cache-hit percentages (0 without calls or lookups), distinct connections."""
    hits, misses = F.count_if(hit), F.count_if(miss)
    n = F.count(F.lit(1))
    return calls.agg(
        n.alias("total_calls"),
        F.round(share(100 * F.count_if(error), n), 2).alias("error_rate"),
        F.round(share(100 * hits, hits + misses), 2).alias("cache_hit_rate"),
        F.count_distinct("session_id").alias("active_connections"),
    )


def ranked_percentiles(points: DataFrame, keys: list[str], value: str, percents: tuple[float, ...]) -> DataFrame:
    """n, mean, low, high and elements int(n p) of the sorted values, one row a key."""
    ranks = percentiles(points, keys, value, [Rank(f"p{round(100 * p)}", p, linear=False) for p in percents])
    basic = points.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return of_keys(ranks, basic, keys).select(*keys, "n", "mean", "low", "high", *[f"p{round(100 * p)}" for p in percents])


def tool_performance(points: DataFrame, tool: str, labels: str, value: str) -> DataFrame:
    """Calls of a tool summed over its label sets; mean and percentiles are those of its last label set."""
    each = ranked_percentiles(points, [tool, labels], value, (0.95, 0.99))
    last = lambda c: F.max_by(c, labels)
    return each.groupBy(tool).agg(F.sum("n").alias("calls"), last("mean").alias("avg_duration"), last("p95").alias("p95_duration"), last("p99").alias("p99_duration"))


def cache_by_tool(lookups: DataFrame, tool: str, hit: Column, miss: Column, value: str) -> DataFrame:
    """Hits, misses, hit rate in per cent and mean time of hits and misses of each tool."""
    hits, misses = F.count_if(hit), F.count_if(miss)
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(c, F.col(value))), F.lit(0.0)), 6)
    return lookups.groupBy(tool).agg(hits.alias("hits"), misses.alias("misses"), F.round(share(100 * hits, hits + misses), 4).alias("hit_rate"), mean(hit).alias("avg_hit_ms"), mean(miss).alias("avg_miss_ms"))


def cache_tiers(lookups: DataFrame, l1: tuple[Column, Column], l2: tuple[Column, Column], check: tuple[Column, Column]) -> DataFrame:
    """Hit rates of two tiers, their weighted efficiency, and the health checks that succeeded (1 without checks)."""
    rate = lambda pair, none: share(F.count_if(pair[0]), F.count_if(pair[0]) + F.count_if(pair[1]), none)
    row = lookups.agg(rate(l1, 0.0).alias("l1"), rate(l2, 0.0).alias("l2"), rate(check, 1.0).alias("health"))
    efficiency = 0.7 * F.col("l1") + 0.3 * F.col("l2")
    return row.select(F.round("l1", 6).alias("l1_hit_rate"), F.round("l2", 6).alias("l2_hit_rate"), F.round(efficiency, 6).alias("efficiency"), F.round("health", 6).alias("health_success_rate"))


def load_levels(requests: DataFrame, level: str, success: Column, value: str, timeout: float) -> DataFrame:
    """Requests of each load level: successes, failures, time-outs, rates and percentiles of successful times.

    A request that failed after ``timeout`` or later timed out. Levels without a success have times of zero.
    """
    late = F.col(value) >= timeout
    counts = requests.groupBy(level).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(success).alias("successful"), F.count_if(~success & ~late).alias("failed"), F.count_if(~success & late).alias("timeouts")
    )
    times = ranked_percentiles(requests.where(success), [level], value, (0.5, 0.95, 0.99)).select(level, F.col("mean").alias("mean_latency"), *[F.col(p).alias(f"{p}_latency") for p in ("p50", "p95", "p99")])
    joined = counts.join(times, level, "left").na.fill(0.0, ["mean_latency", "p50_latency", "p95_latency", "p99_latency"])
    total = F.col("total_requests")
    return joined.withColumns({"failure_rate": F.round(share(F.col("failed") + F.col("timeouts"), total), 6), "timeout_rate": F.round(share(F.col("timeouts"), total), 6)})


def breaking(levels: DataFrame, failure: float, timeout: float) -> DataFrame:
    """Whether a level breaks: failures, 30 % time-outs, or a 95th percentile near the time-out."""
    return levels.withColumn("breaks", (F.col("failure_rate") >= failure) | (F.col("timeout_rate") >= 0.3) | (F.col("p95_latency") >= 0.8 * timeout))


def scalability(levels: DataFrame, users: str) -> DataFrame:
    """One row over levels (users, throughput, error_rate): the best load, where errors pass 5 %, and last over first.

    The best load is the smallest of highest throughput; without a level of many errors it is the saturation point too.
    """
    row = levels.agg(
        F.min_by(users, F.struct(-F.col("throughput"), users)).alias("optimal_load"),
        F.min(F.when(F.col("error_rate") > 0.05, F.col(users))).alias("errors_from"),
        F.max("throughput").alias("max_throughput"),
        F.min_by("throughput", users).alias("first"),
        F.max_by("throughput", users).alias("last"),
        F.count(F.lit(1)).alias("n"),
    )
    factor = F.when(F.col("n") < 2, 1.0).otherwise(share(F.col("last"), F.col("first")))
    return row.select("optimal_load", F.coalesce("errors_from", "optimal_load").alias("saturation_point"), F.round("max_throughput", 6).alias("max_throughput"), F.round(factor, 6).alias("scalability_factor"))


def saturated(levels: DataFrame, users: str, series: str) -> DataFrame:
    """Whether a level is saturated: errors over 10 %, a 95th percentile over 2, or three throughputs within 5 %.

    The first level of a series is never saturated.
    """
    by = Window.partitionBy(series).orderBy(users)
    three = by.rowsBetween(-2, 0)
    i = F.row_number().over(by)
    flat = F.max("throughput").over(three) - F.min("throughput").over(three) < 0.05 * F.max("throughput").over(three)
    return levels.withColumn("saturated", (i > 1) & ((F.col("error_rate") > 0.1) | (F.col("p95") > 2.0) | ((i >= 3) & flat)))


def first_last(points: DataFrame, key: str, order: str, value: str) -> DataFrame:
    first, last = F.min_by(value, order), F.max_by(value, order)
    return points.groupBy(key).agg(first.alias("first"), last.alias("last"), F.round(share(100 * (last - first), first), 4).alias("change_percent"))


def monotone(points: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Whether a series never falls; true for one point."""
    step = F.col(value) >= F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return points.withColumn("step", F.coalesce(step, F.lit(True))).groupBy(key).agg(F.bool_and("step").alias("increasing"))


def compare_runs(baseline: DataFrame, current: DataFrame, name: str, time: float = 0.1, memory: float = 0.1, throughput: float = 0.1) -> DataFrame:
    """Regression report of two benchmark runs (name, mean, sd, memory, throughput, growing).

    Limits are shares. A change is significant beyond twice the mean coefficient of variation; a baseline of zero is no
    change and never significant. Causes are joined by semicolons, ``Unknown`` without one.
    """
    fields = ("mean", "sd", "memory", "throughput", "growing")
    both = baseline.select(name, *[F.col(c).alias(f"was_{c}") for c in fields]).join(current.select(name, *[F.col(c).alias(f"now_{c}") for c in fields]), name)
    change = lambda c: share(F.col(f"now_{c}") - F.col(f"was_{c}"), F.col(f"was_{c}"))
    cv = lambda side: share(F.col(f"{side}_sd"), F.col(f"{side}_mean"))
    out = both.withColumns({"by_time": change("mean") > time, "by_memory": change("memory") > memory, "by_throughput": -change("throughput") > throughput})
    cause = F.concat_ws(
        "; ",
        F.when(F.col("by_time") & (cv("now") > 1.5 * cv("was")), "Increased performance variability"),
        F.when(F.col("by_time") & F.col("by_memory"), "Possible memory pressure affecting performance"),
        F.when(F.col("by_memory") & F.col("now_growing"), "Possible memory leak detected"),
        F.when(F.col("by_throughput") & F.col("by_time"), "Overall performance degradation"),
    )
    return out.select(
        name,
        *[F.round(100 * change(c), 4).alias(f"{c}_change") for c in ("mean", "memory", "throughput")],
        F.col("by_time").alias("time_regression"),
        F.col("by_memory").alias("memory_regression"),
        F.col("by_throughput").alias("throughput_regression"),
        ((F.col("was_mean") != 0) & (F.abs(change("mean")) > cv("was") + cv("now"))).alias("significant"),
        F.coalesce(F.nullif(cause, F.lit("")), F.lit("Unknown")).alias("likely_cause"),
    )


def limits_graded(both: DataFrame, metric: str, was: str, now: str, warn: dict[str, float], critical: dict[str, float]) -> DataFrame:
    """Status of each metric's change in per cent; a limit below zero is one of falling (throughput)."""
    change = F.col("change")
    status = F.lit("ok")
    for limits, label in ((warn, "warning"), (critical, "critical")):
        for name, limit in limits.items():
            past = change > limit if limit > 0 else change < limit
            status = F.when((F.col(metric) == name) & past, label).otherwise(status)
    return both.withColumn("change", F.round(share(100 * (F.col(now) - F.col(was)), F.col(was)), 4)).withColumn("status", status)


#: Default alert rules (name, metric, condition, severity, window in seconds).
ALERT_RULES = [
    ("high_cpu_usage", "system_cpu_percent", "> 80", "warning", 60),
    ("critical_cpu_usage", "system_cpu_percent", "> 95", "critical", 60),
    ("high_memory_usage", "system_memory_percent", "> 85", "warning", 60),
    ("memory_growth_rate", "system_memory_rss_mb", "rate > 10", "warning", 300),
    ("high_response_time", "mcp_request_duration_ms", "> 500", "warning", 60),
    ("slo_violation", "mcp_request_duration_ms", "> 1000", "error", 60),
    ("high_error_rate", "mcp_error_count", "rate > 10", "error", 60),
    ("low_cache_hit_rate", "cache_hit_rate", "< 50", "warning", 60),
]


def holds(condition: Column, value: Column) -> Column:
    """Whether ``value`` meets conditions such as ``> 80``, ``>= 80``, ``< 5`` or ``rate > 10``, given as text."""
    part = lambda i: F.regexp_extract(condition, r"^(?:rate\s*)?(>=|<=|==|>|<)\s*(-?[0-9.]+)$", i)
    limit = part(2).try_cast("double")
    cases = {">=": value >= limit, "<=": value <= limit, "==": F.abs(value - limit) < 0.001, ">": value > limit, "<": value < limit}
    out = F.lit(False)
    for sign, case in cases.items():
        out = F.when(part(1) == sign, case).otherwise(out)
    return F.coalesce(out, F.lit(False))


def check_rules(points: DataFrame, rules: DataFrame, metric: str, ts: str, value: str) -> DataFrame:
    """One row for each rule and window with points: name, severity, start, value (mean, or points a minute for a rate)
    and whether the rule fires. Rules are few rows and are joined by the metric's name."""
    width = F.col("window_seconds")
    start = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / width) * width
    joined = points.select(F.col(metric).alias("metric"), ts, value).join(rules, "metric").withColumn("start", start.cast("long"))
    grouped = joined.groupBy("name", "condition", "severity", "window_seconds", "start").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    measured = F.when(F.col("condition").startswith("rate"), F.col("n") / (width / 60)).otherwise(F.col("mean"))
    return grouped.select("name", "severity", "start", F.round(measured, 6).alias("value"), holds(F.col("condition"), measured).alias("fires"))


def alert_summary(fired: DataFrame, now: int, severities: tuple[str, ...] = ("info", "warning", "error", "critical")) -> DataFrame:
    """One row over fired alerts (name, severity, start in seconds): counts by severity, of the last hour, and the five
    most frequent of the last day (ties by name)."""
    recent = fired.where(F.col("start") > now - 86400).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(5)
    often = recent.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "name"))), lambda x: F.concat(x["name"], F.lit("="), (-x["k"]).cast("string"))), ",").alias("most_frequent"))
    counts = fired.agg(F.count(F.lit(1)).alias("active_count"), F.count_if(F.col("start") > now - 3600).alias("recent_count"), *[F.count_if(F.col("severity") == s).alias(s) for s in severities])
    return counts.crossJoin(often)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Growth of counts between two snapshots (key, n), over the keys of either; unchanged keys are left out."""
    a, b = before.select(key, F.col("n").alias("was")), after.select(key, F.col("n").alias("now"))
    both = a.join(b, key, "full_outer").na.fill(0, ["was", "now"])
    return both.withColumn("growth", F.col("now") - F.col("was")).where("growth <> 0")


def exposition(points: DataFrame, metric: str, ts: str, value: str, prefix: str) -> DataFrame:
    """Text exposition: HELP and TYPE, a counter, the latest value, and a histogram's count, sum and three quantiles."""
    rows = ranked_percentiles(points, [metric], value, (0.5, 0.95, 0.99)).join(points.groupBy(metric).agg(F.round(F.sum(value), 4).alias("total"), F.max_by(value, ts).alias("latest")), metric)
    name = F.concat(F.lit(f"{prefix}_"), metric)
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    lines = F.array(
        line("# HELP ", name, " points of ", F.col(metric)),
        line("# TYPE ", name, " histogram"),
        line(name, "_total ", F.col("n").cast("string")),
        line(name, "_latest ", number("latest")),
        line(name, "_count ", F.col("n").cast("string")),
        line(name, "_sum ", number("total")),
        *[line(name, '{quantile="', q, '"} ', number(c)) for q, c in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99"))],
    )
    return rows.select(F.explode(lines).alias("line"))
