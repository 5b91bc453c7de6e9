"""Monitoring queries over events: dashboards, caches, load levels, benchmark runs and alerts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsense.operators import monitoring, orderstats, stats
from docsense.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _is(kind: str):
    return F.col("event_type") == kind


def _calls(spark, d):
    """Events as tool calls: tool, labels, session_id, second."""
    events = table(spark, d, "events")
    tool = F.get_json_object("props", "$.k")
    return events.withColumns({"tool": tool, "labels": F.concat(F.lit("tool="), tool, F.lit(",type="), "event_type"), "session_id": F.col("user_id"), "level": tool.cast("int") % 10 * 10 + 10})


_C = "c AS (SELECT *, json_extract_string(props, '$.k') AS tool, 'tool=' || json_extract_string(props, '$.k') || ',type=' || event_type AS labels, json_extract_string(props, '$.k')::INTEGER % 10 * 10 + 10 AS level FROM events)"


def _ratio(part: str, whole: str, none: str = "0e0") -> str:
    return f"coalesce({part} / nullif({whole}, 0), {none})"


def _n(kind: str) -> str:
    return f"count(*) FILTER (event_type = '{kind}')::DOUBLE"


def _ranked(source: str, keys: str, percents: tuple[int, ...]) -> str:
    at = ", ".join(f"max(value) FILTER (i = least(floor(m * {p}e0 / 100), m - 1)) AS p{p}" for p in percents)
    return f"SELECT {keys}, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, {at} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS m FROM {source}) GROUP BY {keys}"


@query(f"SELECT count(*) AS total_calls, round({_ratio('100 * ' + _n('error'), 'count(*)')}, 2) AS error_rate, round({_ratio('100 * ' + _n('view'), _n('view') + ' + ' + _n('click'))}, 2) AS cache_hit_rate, count(DISTINCT user_id) AS active_connections FROM events")
def dashboard_summary(spark, d):
    return monitoring.dashboard(_calls(spark, d), _is("error"), _is("view"), _is("click"))


@query(f"WITH {_C}, e AS ({_ranked('c', 'tool, labels', (95, 99))}) SELECT tool, sum(n)::BIGINT AS calls, arg_max(mean, labels) AS avg_duration, arg_max(p95, labels) AS p95_duration, arg_max(p99, labels) AS p99_duration FROM e GROUP BY 1")
def tool_performance(spark, d):
    return monitoring.tool_performance(_calls(spark, d), "tool", "labels", "value")


@query(f"WITH {_C} SELECT level AS tier, count(*) FILTER (value > 50) AS rate_limit_hits, count(*) FILTER (event_type IN ('signup', 'error')) AS attempts, round({_ratio('100 * ' + _n('signup'), _n('signup') + ' + ' + _n('error'), '100e0')}, 2) AS success_rate FROM c GROUP BY 1")
def rate_auth_stats(spark, d):
    """Rate-limit hits of each tier, and authentication attempts with their success rate (100 without attempts)."""
    good, bad = F.count_if(_is("signup")), F.count_if(_is("error"))
    return _calls(spark, d).groupBy(F.col("level").alias("tier")).agg(F.count_if(F.col("value") > 50).alias("rate_limit_hits"), (good + bad).alias("attempts"), F.round(monitoring.share(100 * good, good + bad, 100.0), 2).alias("success_rate"))


@query(f"WITH {_C} SELECT tool, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses, round({_ratio('100 * ' + _n('view'), _n('view') + ' + ' + _n('click'))}, 4) AS hit_rate, round(coalesce(avg(value) FILTER (event_type = 'view'), 0), 6) AS avg_hit_ms, round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 6) AS avg_miss_ms FROM c GROUP BY 1")
def cache_by_tool(spark, d):
    return monitoring.cache_by_tool(_calls(spark, d), "tool", _is("view"), _is("click"), "value")


@query(f"WITH r AS (SELECT {_ratio(_n('view'), _n('view') + ' + ' + _n('click'))} AS l1, {_ratio(_n('purchase'), _n('purchase') + ' + ' + _n('click'))} AS l2, {_ratio(_n('signup'), _n('signup') + ' + ' + _n('error'), '1e0')} AS h FROM events) SELECT round(l1, 6) AS l1_hit_rate, round(l2, 6) AS l2_hit_rate, round(0.7e0 * l1 + 0.3e0 * l2, 6) AS efficiency, round(h, 6) AS health_success_rate FROM r")
def cache_tiers(spark, d):
    return monitoring.cache_tiers(table(spark, d, "events"), (_is("view"), _is("click")), (_is("purchase"), _is("click")), (_is("signup"), _is("error")))


@query(f"WITH s AS ({_ranked('events', 'event_type', (50, 95, 99))}), f AS (SELECT event_type, count(*) FILTER (value > 90) AS failures FROM events GROUP BY 1) SELECT s.*, failures, round(100e0 * failures / n, 4) AS failure_percent, round(n / (mean * n) * 1000, 4) AS throughput FROM s JOIN f USING (event_type)")
def request_stats(spark, d):
    """Request statistics of each task: count, failures, times and throughput of one worker."""
    points = table(spark, d, "events")
    ranked = monitoring.ranked_percentiles(points, ["event_type"], "value", (0.5, 0.95, 0.99))
    failed = points.groupBy("event_type").agg(F.count_if(F.col("value") > 90).alias("failures"))
    out = ranked.join(failed, "event_type")
    return out.withColumns({"failure_percent": F.round(monitoring.share(100 * F.col("failures"), F.col("n")), 4), "throughput": F.round(F.col("n") / (F.col("mean") * F.col("n")) * 1000, 4)})


_LEVELS = f"""{_C}, k AS (SELECT level, count(*) AS total_requests, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error' AND value < 60) AS failed, count(*) FILTER (event_type = 'error' AND value >= 60) AS timeouts FROM c GROUP BY 1),
t AS ({_ranked("(SELECT * FROM c WHERE event_type <> 'error')", 'level', (50, 95, 99))}),
levels AS (SELECT k.*, coalesce(mean, 0) AS mean_latency, coalesce(p50, 0) AS p50_latency, coalesce(p95, 0) AS p95_latency, coalesce(p99, 0) AS p99_latency, round((failed + timeouts)::DOUBLE / total_requests, 6) AS failure_rate, round(timeouts::DOUBLE / total_requests, 6) AS timeout_rate FROM k LEFT JOIN t USING (level))"""


def _levels(spark, d):
    return monitoring.load_levels(_calls(spark, d), "level", ~_is("error"), "value", 60.0)


@query(f"WITH {_LEVELS} SELECT *, failure_rate >= 0.25 OR timeout_rate >= 0.3 OR p95_latency >= 48 AS breaks FROM levels")
def load_level_breaks(spark, d):
    return monitoring.breaking(_levels(spark, d), 0.25, 60.0)


_SCALE = f"{_LEVELS}, th AS (SELECT level, total_requests / (mean_latency * 10) AS throughput, failure_rate AS error_rate, p95_latency / 30 AS p95, level % 20 AS series FROM levels)"


def _throughput(spark, d):
    rows = _levels(spark, d).withColumn("throughput", F.col("total_requests") / (F.col("mean_latency") * 10))
    return rows.select("level", "throughput", F.col("failure_rate").alias("error_rate"), (F.col("p95_latency") / 30).alias("p95"), (F.col("level") % 20).alias("series"))


@query(f"WITH {_SCALE} SELECT arg_min(level, (-throughput, level)) AS optimal_load, coalesce(min(level) FILTER (error_rate > 0.05), arg_min(level, (-throughput, level))) AS saturation_point, round(max(throughput), 6) AS max_throughput, round(arg_max(throughput, level) / arg_min(throughput, level), 6) AS scalability_factor FROM th")
def scalability(spark, d):
    return monitoring.scalability(_throughput(spark, d), "level")


@query(f"""WITH {_SCALE}, w AS (SELECT *, row_number() OVER o AS i, max(throughput) OVER f AS hi, min(throughput) OVER f AS lo FROM th WINDOW o AS (PARTITION BY series ORDER BY level), f AS (PARTITION BY series ORDER BY level ROWS 2 PRECEDING))
SELECT level, series, i > 1 AND (error_rate > 0.1 OR p95 > 2 OR (i >= 3 AND hi - lo < 0.05 * hi)) AS saturated FROM w""")
def saturation(spark, d):
    return monitoring.saturated(_throughput(spark, d), "level", "series").select("level", "series", "saturated")


_DAYS = "s AS (SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS v, round(max(value), 6) AS top, count(*) AS n FROM events GROUP BY ALL)"


def _days(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"), F.round(F.max("value"), 6).alias("top"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DAYS}, f AS (SELECT event_type, arg_min(v, day) AS first, arg_max(v, day) AS last FROM s GROUP BY 1) SELECT *, round({_ratio('100 * (last - first)', 'first')}, 4) AS change_percent FROM f")
def first_last_change(spark, d):
    return monitoring.first_last(_days(spark, d), "event_type", "day", "v")


@query("SELECT user_id, coalesce(bool_and(up), true) AS increasing FROM (SELECT user_id, value >= lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up FROM events) GROUP BY 1")
def monotone_series(spark, d):
    return monitoring.monotone(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


_RUN = "SELECT l_suppkey, round(avg(l_extendedprice), 4)::DOUBLE AS mean, round(coalesce(stddev_samp(l_extendedprice), 0), 4)::DOUBLE AS sd, max(l_quantity)::DOUBLE AS memory, count(*)::DOUBLE AS throughput, coalesce(bool_and(up), true) AS growing FROM (SELECT *, l_quantity >= lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS up FROM lineitem WHERE year(l_shipdate) = {year}) GROUP BY 1"


def _run(spark, d, year: int):
    items = table(spark, d, "lineitem").where(F.year("l_shipdate") == year)
    up = F.col("l_quantity") >= F.lag("l_quantity").over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber"))
    price = F.col("l_extendedprice").cast("double")
    return items.withColumn("up", F.coalesce(up, F.lit(True))).groupBy("l_suppkey").agg(
        F.round(F.avg(price), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(price), F.lit(0.0)), 4).alias("sd"), F.max("l_quantity").cast("double").alias("memory"), F.count(F.lit(1)).cast("double").alias("throughput"), F.bool_and("up").alias("growing")
    )


@query(f"""WITH a AS ({_RUN.format(year=1996)}), b AS ({_RUN.format(year=1997)}),
j AS (SELECT l_suppkey, (b.mean - a.mean) / a.mean AS t, (b.memory - a.memory) / a.memory AS m, (b.throughput - a.throughput) / a.throughput AS p, a.sd / a.mean AS cva, b.sd / b.mean AS cvb, b.growing FROM a JOIN b USING (l_suppkey))
SELECT l_suppkey, round(100 * t, 4) AS mean_change, round(100 * m, 4) AS memory_change, round(100 * p, 4) AS throughput_change, t > 0.1 AS time_regression, m > 0.1 AS memory_regression, -p > 0.1 AS throughput_regression, abs(t) > cva + cvb AS significant,
  coalesce(nullif(concat_ws('; ', CASE WHEN t > 0.1 AND cvb > 1.5 * cva THEN 'Increased performance variability' END, CASE WHEN t > 0.1 AND m > 0.1 THEN 'Possible memory pressure affecting performance' END,
    CASE WHEN m > 0.1 AND growing THEN 'Possible memory leak detected' END, CASE WHEN -p > 0.1 AND t > 0.1 THEN 'Overall performance degradation' END), ''), 'Unknown') AS likely_cause FROM j""")
def compare_runs(spark, d):
    return monitoring.compare_runs(_run(spark, d, 1996), _run(spark, d, 1997), "l_suppkey")


@query(f"""WITH a AS ({_RUN.format(year=1996)}), b AS ({_RUN.format(year=1997)}),
u AS (SELECT l_suppkey, 'time' AS metric, a.mean AS was, b.mean AS now FROM a JOIN b USING (l_suppkey) UNION ALL SELECT l_suppkey, 'memory', a.memory, b.memory FROM a JOIN b USING (l_suppkey) UNION ALL SELECT l_suppkey, 'throughput', a.throughput, b.throughput FROM a JOIN b USING (l_suppkey)),
c AS (SELECT *, round(100 * (now - was) / was, 4) AS change FROM u)
SELECT *, CASE metric WHEN 'time' THEN CASE WHEN change > 20 THEN 'critical' WHEN change > 10 THEN 'warning' ELSE 'ok' END WHEN 'memory' THEN CASE WHEN change > 25 THEN 'critical' WHEN change > 15 THEN 'warning' ELSE 'ok' END ELSE CASE WHEN change < -20 THEN 'critical' WHEN change < -10 THEN 'warning' ELSE 'ok' END END AS status FROM c""")
def metric_limits(spark, d):
    """Changes of time, memory and throughput against warning and critical limits."""
    names = {"time": "mean", "memory": "memory", "throughput": "throughput"}
    unpivot = lambda run, as_: run.select("l_suppkey", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).alias(as_)) for k, c in names.items()])))
    both = unpivot(_run(spark, d, 1996), "was").join(unpivot(_run(spark, d, 1997), "now"), ["l_suppkey", "metric"])
    return monitoring.limits_graded(both, "metric", "was", "now", {"time": 10, "memory": 15, "throughput": -10}, {"time": 20, "memory": 25, "throughput": -20})


_TREND3 = " UNION ALL ".join(f"SELECT event_type, day, '{k}' AS series, {c}::DOUBLE AS v FROM s" for k, c in (("time", "v"), ("memory", "top"), ("throughput", "n")))


@query(f"""WITH {_DAYS}, u AS ({_TREND3}), o AS (SELECT *, event_type || '/' || series AS key, row_number() OVER (PARTITION BY event_type, series ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type, series) AS n FROM u),
ma AS (SELECT *, round(avg(v) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 6) AS ma FROM o),
e AS (SELECT key, max(n) AS n, avg(ma) FILTER (i <= 5) AS early, avg(ma) FILTER (i > n - 9) AS late FROM ma WHERE i <= n - 4 GROUP BY 1),
r AS (SELECT key, avg(v) FILTER (i > n - 5) AS recent, avg(v) FILTER (i <= n - 5 AND i > n - 10) AS older FROM o GROUP BY 1)
SELECT key, e.n, CASE WHEN n < 10 THEN 'insufficient_data' WHEN (late - early) / early > 0.05 THEN 'increasing' WHEN (late - early) / early < -0.05 THEN 'decreasing' ELSE 'stable' END AS direction, round((recent - older) / older, 6) AS score FROM e JOIN r USING (key)""")
def run_trends(spark, d):
    """Trends of time, memory and throughput over runs, and the change of the last five runs against the five before."""
    rows = _days(spark, d).select("event_type", "day", F.inline(F.array(*[F.struct(F.lit(k).alias("series"), F.col(c).cast("double").alias("v")) for k, c in (("time", "v"), ("memory", "top"), ("throughput", "n"))])))
    keyed = rows.withColumn("key", F.concat_ws("/", "event_type", "series"))
    w = Window.partitionBy("key")
    placed = keyed.withColumns({"i": F.row_number().over(w.orderBy("day")), "of": F.count(F.lit(1)).over(w)})
    recent, older = F.avg(F.when(F.col("i") > F.col("of") - 5, F.col("v"))), F.avg(F.when((F.col("i") <= F.col("of") - 5) & (F.col("i") > F.col("of") - 10), F.col("v")))
    scores = placed.groupBy("key").agg(F.round((recent - older) / older, 6).alias("score"))
    return stats.trend_direction(keyed, "key", "day", "v").join(scores, "key")


@query("""WITH m AS (SELECT event_type, unnest(['value', 'k']) AS metric, unnest([value, json_extract_string(props, '$.k')::DOUBLE]) AS x FROM events)
SELECT event_type, metric, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, min(x) AS low, max(x) AS high, round(coalesce(stddev_samp(x), 0), 6) AS sd FROM m GROUP BY ALL""")
def custom_metrics(spark, d):
    """Numeric members of a map of custom metrics, aggregated by name."""
    made = F.create_map(F.lit("value"), F.col("value"), F.lit("k"), F.get_json_object("props", "$.k").cast("double"))
    rows = table(spark, d, "events").select("event_type", F.explode(made).alias("metric", "x"))
    basic = rows.groupBy("event_type", "metric").agg(F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("low"), F.max("x").alias("high"), F.round(F.coalesce(F.stddev_samp("x"), F.lit(0.0)), 6).alias("sd"))
    median = orderstats.percentiles(rows, ["event_type", "metric"], "x", [orderstats.Rank("median", 0.5)])
    return orderstats.of_keys(basic, median, ["event_type", "metric"]).select("event_type", "metric", "mean", F.round("median", 6).alias("median"), "low", "high", "sd")


#: Event types as the metrics of the default rules, scaled to their units.
_AS_METRIC = {"click": "system_cpu_percent", "error": "mcp_error_count", "purchase": "system_memory_percent", "signup": "cache_hit_rate", "view": "mcp_request_duration_ms"}
_SCALE_OF = {"view": 10.0}


def _metric_points(spark, d):
    events = table(spark, d, "events")
    named = F.create_map(*[F.lit(x) for pair in _AS_METRIC.items() for x in pair])[F.col("event_type")]
    return events.select(named.alias("metric"), "ts", (F.col("value") * F.when(_is("view"), 10.0).otherwise(1.0)).alias("value"))


def _rules(spark):
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r, ("name", "metric", "condition", "severity", "window_seconds"))]) for r in monitoring.ALERT_RULES])))


_RULE_ROWS = ", ".join(f"('{n}', '{m}', '{c}', '{s}', {w})" for n, m, c, s, w in monitoring.ALERT_RULES)
_FIRED = f"""p AS (SELECT CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _AS_METRIC.items())} END AS metric, ts, value * CASE WHEN event_type = 'view' THEN 10e0 ELSE 1e0 END AS value FROM events),
r(name, metric, condition, severity, w) AS (VALUES {_RULE_ROWS}),
g AS (SELECT name, condition, severity, w, (floor(floor(epoch(ts)) / w) * w)::BIGINT AS start, avg(value) AS mean, count(*) AS n FROM p JOIN r USING (metric) GROUP BY ALL),
v AS (SELECT *, CASE WHEN starts_with(condition, 'rate') THEN n / (w / 60e0) ELSE mean END AS value, regexp_extract(condition, '([-0-9.]+)$', 1)::DOUBLE AS lim FROM g),
checked AS (SELECT name, severity, start, round(value, 6) AS value, CASE WHEN contains(condition, '>') THEN value > lim ELSE value < lim END AS fires FROM v)"""


@query(f"WITH {_FIRED} SELECT * FROM checked")
def alert_rule_checks(spark, d):
    """The default alert rules over their windows."""
    return monitoring.check_rules(_metric_points(spark, d), _rules(spark), "metric", "ts", "value")


_NOW = 1706659200  # 2024-01-31


@query(f"""WITH {_FIRED}, f AS (SELECT * FROM checked WHERE fires), o AS (SELECT name, count(*) AS n FROM f WHERE start > {_NOW} - 86400 GROUP BY 1 ORDER BY n DESC, name LIMIT 5)
SELECT count(*) AS active_count, count(*) FILTER (start > {_NOW} - 3600) AS recent_count, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'critical') AS critical,
(SELECT coalesce(string_agg(name || '=' || n, ',' ORDER BY n DESC, name), '') FROM o) AS most_frequent FROM f""")
def alert_summary(spark, d):
    checked = monitoring.check_rules(_metric_points(spark, d), _rules(spark), "metric", "ts", "value")
    return monitoring.alert_summary(checked.where("fires"), _NOW)


@query(f"""WITH h AS (SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h),
x AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS current, round(avg(value) FILTER (i <= n // 2), 6) AS a, round(avg(value) FILTER (i > n // 2), 6) AS b, count(*) FILTER (value > 50) AS alerts FROM o GROUP BY 1)
SELECT event_type, n, current, alerts, CASE WHEN a IS NULL THEN 'stable' WHEN b > 1.1 * a THEN 'increasing' WHEN b < 0.9 * a THEN 'decreasing' ELSE 'stable' END AS trend FROM x""")
def dashboard_last_hour(spark, d):
    """Statistics of the last hour of points: mean, trend of the halves and points over the alert limit."""
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").alias("last"))
    recent = events.crossJoin(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 1 HOUR"))
    w = Window.partitionBy("event_type")
    placed = recent.withColumns({"i": F.row_number().over(w.orderBy("ts", "event_id")), "of": F.count(F.lit(1)).over(w)})
    half = lambda early: F.round(F.avg(F.when((F.col("i") <= F.floor(F.col("of") / 2)) if early else (F.col("i") > F.floor(F.col("of") / 2)), F.col("value"))), 6)
    rows = placed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("current"), F.count_if(F.col("value") > 50).alias("alerts"), half(True).alias("a"), half(False).alias("b"))
    trend = F.when(F.col("a").isNull(), "stable").when(F.col("b") > 1.1 * F.col("a"), "increasing").when(F.col("b") < 0.9 * F.col("a"), "decreasing").otherwise("stable")
    return rows.select("event_type", "n", "current", "alerts", trend.alias("trend"))


@query("""SELECT json_extract_string(props, '$.k')::INTEGER % 10 AS benchmark, count(*) AS runs, round(100e0 * count(*) FILTER (event_type <> 'error') / count(*), 4) AS success_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99,
round(count(*) / sum(value) * 1000, 6) AS throughput FROM events GROUP BY 1""")
def micro_benchmarks(spark, d):
    """Success rate, linear percentiles and throughput of benchmark runs."""
    n = F.count(F.lit(1))
    rows = table(spark, d, "events").withColumn("benchmark", F.get_json_object("props", "$.k").cast("int") % 10)
    basic = rows.groupBy("benchmark").agg(n.alias("runs"), F.round(monitoring.share(100 * F.count_if(~_is("error")), n), 4).alias("success_rate"), F.round(n / F.sum("value") * 1000, 6).alias("throughput"))
    names = {f"p{p}": p / 100 for p in (50, 90, 95, 99)}
    ranks = orderstats.percentiles(rows, ["benchmark"], "value", [orderstats.Rank(name, share) for name, share in names.items()])
    return orderstats.of_keys(basic, ranks, ["benchmark"]).select("benchmark", "runs", "success_rate", *[F.round(name, 6).alias(name) for name in names], "throughput")


@query("""SELECT user_id, count(*) AS iterations, round((arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / count(*), 6) AS growth_per_iteration, arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)) > 10 AS leak FROM events GROUP BY 1""")
def memory_growth(spark, d):
    """Growth of a sampled size over iterations; more than ten units count as a leak."""
    at = F.struct("ts", "event_id")
    grown = F.max_by("value", at) - F.min_by("value", at)
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("iterations"), F.round(grown / F.count(F.lit(1)), 6).alias("growth_per_iteration"), (grown > 10).alias("leak"))


@query("""WITH a AS (SELECT user_id, count(*) AS was FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, count(*) AS now FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT user_id, coalesce(was, 0) AS was, coalesce(now, 0) AS now, coalesce(now, 0) - coalesce(was, 0) AS growth FROM a FULL JOIN b USING (user_id) WHERE coalesce(now, 0) <> coalesce(was, 0)""")
def object_growth(spark, d):
    events = table(spark, d, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    count = lambda rows: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return monitoring.snapshot_diff(count(events.where(F.col("ts") < cut)), count(events.where(F.col("ts") >= cut)), "user_id")


_X = ", ".join(f"'events_' || event_type || '{{quantile=\"{q}\"}} ' || printf('%.4f', {c})" for q, c in (("0.5", "p50"), ("0.95", "p95"), ("0.99", "p99")))


@query(f"""WITH s AS ({_ranked('events', 'event_type', (50, 95, 99))}), t AS (SELECT event_type, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY 1), j AS (SELECT * FROM s JOIN t USING (event_type))
SELECT unnest(['# HELP events_' || event_type || ' points of ' || event_type, '# TYPE events_' || event_type || ' histogram', 'events_' || event_type || '_total ' || n, 'events_' || event_type || '_latest ' || printf('%.4f', latest), 'events_' || event_type || '_count ' || n, 'events_' || event_type || '_sum ' || printf('%.4f', total), {_X}]) AS line FROM j""")
def exposition_lines(spark, d):
    """Metrics in text exposition form, with histograms and their quantiles."""
    points = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return monitoring.exposition(points, "event_type", "at", "value", "events")


@query("SELECT event_id, to_json(struct_pack(metric := event_type, value := value)) AS point FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 5 MINUTE")
def metric_snapshot(spark, d):
    """The points of the last five minutes, as JSON rows for a snapshot file."""
    events = table(spark, d, "events")
    recent = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("last")))).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 5 MINUTE"))
    return recent.select("event_id", F.to_json(F.struct(F.col("event_type").alias("metric"), "value")).alias("point"))
