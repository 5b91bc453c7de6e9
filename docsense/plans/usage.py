"""Usage, query-log and metric queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsense.operators import stats, usage
from docsense.sources.tables import AS_OF, SINCE_SQL, USAGE_SQL, as_of, table, usage_events

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _recent(spark, d):
    return usage.within(usage_events(spark, d), as_of())


_U = f"{USAGE_SQL}, r AS (SELECT * FROM u WHERE {SINCE_SQL})"
_TYPED = f"{_U}, t AS (SELECT standard_id, usage_type, count(*) AS uses, count(DISTINCT session_id) AS sessions, min(ts) AS first_used, max(ts) AS last_used FROM r GROUP BY ALL)"


@query(f"WITH {_TYPED} SELECT * FROM t")
def usage_by_standard_type(spark, d):
    return usage.by_type(_recent(spark, d))


_ROLL = f"""{_TYPED}, x AS (SELECT standard_id, count(DISTINCT session_id) AS unique_sessions FROM r GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY standard_id ORDER BY uses DESC, usage_type) AS rn FROM t),
roll AS (SELECT standard_id, sum(uses)::BIGINT AS total_usage, sum(sessions)::BIGINT AS sessions_sum, min(first_used) AS first_used, max(last_used) AS last_used,
  max(usage_type) FILTER (rn = 1) AS top_type, max(first_used) FILTER (rn = 1) AS first_used_top_type, any_value(unique_sessions) AS unique_sessions FROM k JOIN x USING (standard_id) GROUP BY 1)"""


@query(f"WITH {_ROLL} SELECT * FROM roll")
def usage_rollup(spark, d):
    return usage.rollup(_recent(spark, d))


_TREND = """dd AS (SELECT standard_id, ts::DATE AS day, count(*) AS uses FROM r GROUP BY ALL),
di AS (SELECT *, (row_number() OVER (PARTITION BY standard_id ORDER BY day) - 1)::DOUBLE AS i FROM dd),
ds AS (SELECT standard_id, count(*) AS days, round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(regr_slope(uses::DOUBLE, i), 0) END, 6) AS slope FROM di GROUP BY 1),
trend AS (SELECT *, CASE WHEN slope > 0.1 THEN 'rising' WHEN slope < -0.1 THEN 'falling' ELSE 'stable' END AS direction,
  round(CASE WHEN days < 2 THEN 0 ELSE least(days / 14.0, 1.0) END, 6)::DOUBLE AS confidence FROM ds)"""


@query(f"WITH {_U}, {_TREND} SELECT * FROM trend")
def usage_daily_trend(spark, d):
    return usage.trend(usage.daily(_recent(spark, d)))


@query(f"""WITH {_ROLL}, {_TREND}, m AS (SELECT max(total_usage) AS mu, max(sessions_sum) AS ms FROM roll),
s AS (SELECT standard_id, total_usage, sessions_sum AS unique_sessions, total_usage::DOUBLE / mu AS a, sessions_sum::DOUBLE / ms AS b,
  greatest(0e0, 1e0 - floor(epoch(TIMESTAMP '{AS_OF}' - last_used) / 86400e0) / 30e0) AS c, CASE direction WHEN 'rising' THEN 0.8e0 WHEN 'falling' THEN 0.2e0 ELSE 0.5e0 END AS e
  FROM roll JOIN trend USING (standard_id), m),
p AS (SELECT standard_id, total_usage, unique_sessions, round(a, 6) AS usage_score, round(b, 6) AS session_score, round(c, 6) AS recency_score, round(e, 6) AS trend_score,
  round(0.4e0 * a + 0.3e0 * b + 0.2e0 * c + 0.1e0 * e, 6) AS popularity_score FROM s)
SELECT *, row_number() OVER (ORDER BY popularity_score DESC, standard_id)::INTEGER AS rank FROM p""")
def usage_popularity(spark, d):
    return usage.popularity(_recent(spark, d), as_of())


@query(f"WITH {_U}, c AS (SELECT standard_id, count(*) AS uses FROM r GROUP BY 1) SELECT standard_id, uses, round((SELECT avg(uses) FROM c), 6) AS mean_count FROM c WHERE uses < 0.9 * (SELECT avg(uses) FROM c)")
def usage_low_recommend(spark, d):
    counts = _recent(spark, d).groupBy("standard_id").agg(F.count(F.lit(1)).alias("uses"))
    return usage.under_represented(counts, "uses", 0.9).withColumn("mean_count", F.round("mean_count", 6))


@query(f"WITH {_U}, c AS (SELECT standard_id, count(*) AS uses FROM r GROUP BY 1) SELECT standard_id, uses, round((SELECT avg(uses) FROM c), 6) AS mean_count FROM c WHERE uses < 0.3 * (SELECT avg(uses) FROM c)")
def usage_underused(spark, d):
    """Standards with less than three tenths of the mean use."""
    counts = _recent(spark, d).groupBy("standard_id").agg(F.count(F.lit(1)).alias("uses"))
    return usage.under_represented(counts, "uses", 0.3).withColumn("mean_count", F.round("mean_count", 6))


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT lang, n FROM c WHERE n < 0.5 * (SELECT avg(n) FROM c)")
def usage_domain_gaps(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return usage.under_represented(counts, "n", 0.5).select("lang", "n")


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT name, coalesce(n, 0) AS n FROM (VALUES ('en'), ('fr'), ('it'), ('pt'), ('nl')) w(name) LEFT JOIN c ON lang = name WHERE coalesce(n, 0) < 2")
def usage_catalog_shortage(spark, d):
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return usage.catalogue_shortage(counts, "lang", ["en", "fr", "it", "pt", "nl"])


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in usage.USAGE_TYPES) + " FROM events GROUP BY 1")
def usage_type_pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", list(usage.USAGE_TYPES)).count().na.fill(0)


@query(f"WITH {_U} SELECT coalesce(standard_id, 'all') AS standard_id, coalesce(usage_type, 'all') AS usage_type, count(*) AS uses, grouping(standard_id, usage_type)::INTEGER AS level FROM r GROUP BY ROLLUP (standard_id, usage_type)")
def usage_totals(spark, d):
    rolled = _recent(spark, d).rollup("standard_id", "usage_type").agg(F.count(F.lit(1)).alias("uses"), F.grouping_id().cast("int").alias("level"))
    return rolled.select(F.coalesce("standard_id", F.lit("all")).alias("standard_id"), F.coalesce("usage_type", F.lit("all")).alias("usage_type"), "uses", "level")


@query("""WITH c AS (SELECT lower(trim(text)) AS query, count(*) AS n, round(avg(length(text)), 6) AS mean_length FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT sha256(query) AS query_key, n, mean_length FROM c ORDER BY n DESC, query LIMIT 10""")
def popular_queries(spark, d):
    said = table(spark, d, "conversations").where("role = 'user'").withColumn("query", F.lower(F.trim("text")))
    counts = said.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))
    return counts.orderBy(F.desc("n"), "query").limit(10).select(F.sha2(F.col("query").cast("binary"), 256).alias("query_key"), "n", "mean_length")


_NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace('SELECT * FROM ' || event_type || ' WHERE k = ' || json_extract_string(props, '$.k') || ' AND  note = ''n' || user_id || '''', '''[^'']*''', '?', 'g'), '\b[0-9]+\b', '?', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT {_NORMAL} AS pattern, count(*) AS n, count(*) FILTER (value > 50) AS slow, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1")
def querylog_patterns(spark, d):
    """Query texts with literals masked, counted with their slow share."""
    text = F.concat(F.lit("SELECT * FROM "), "event_type", F.lit(" WHERE k = "), F.get_json_object("props", "$.k"), F.lit(" AND  note = 'n"), F.col("user_id").cast("string"), F.lit("'"))
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "'[^']*'", "?"), r"\b[0-9]+\b", "?"), r"\s+", " ")
    return table(spark, d, "events").groupBy(F.lower(masked).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("slow"), F.round(F.avg("value"), 6).alias("mean_ms"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS slow, round(100e0 * count(*) FILTER (value > 50) / count(*), 4) AS slow_percent, round(avg(value), 6) AS mean_ms FROM events GROUP BY 1")
def querylog_slow_stats(spark, d):
    slow = F.count_if(F.col("value") > 50)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), slow.alias("slow"), F.round(100 * slow / F.count(F.lit(1)), 4).alias("slow_percent"), F.round(F.avg("value"), 6).alias("mean_ms"))


@query("SELECT event_id, value, ts FROM events WHERE value > 50 ORDER BY ts DESC, event_id DESC LIMIT 100")
def querylog_recent_slow(spark, d):
    return table(spark, d, "events").where("value > 50").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "value", "ts")


_RANKED = "k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"
_AT = ", ".join(f"max(value) FILTER (i = least(floor(n * {p} / 100), n - 1)) AS p{p}" for p in (50, 95, 99))


@query(f"WITH {_RANKED} SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, {_AT} FROM k GROUP BY 1")
def metric_summary_nearest_rank(spark, d):
    return stats.summary_nearest_rank(table(spark, d, "events"), "event_type", "value")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(coalesce(stddev_samp(value), 0) / avg(value), 6) AS cv,
round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def metric_stats_linear(spark, d):
    return stats.summary_linear(table(spark, d, "events"), "event_type", "value")


@query("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS high, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY ALL""")
def metric_window_hourly(spark, d):
    w = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("event_type", w.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("high"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("SELECT event_type, CASE WHEN value <= 5 THEN '5' WHEN value <= 10 THEN '10' WHEN value <= 25 THEN '25' WHEN value <= 50 THEN '50' WHEN value <= 100 THEN '100' ELSE 'inf' END AS bucket, count(*) AS n FROM events GROUP BY ALL")
def latency_histogram(spark, d):
    return stats.histogram(table(spark, d, "events"), "event_type", "value", [5, 10, 25, 50, 100])


_OUT = """b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1),
m AS (SELECT event_type, quantile_cont(abs(value - med), 0.5) AS mad FROM events JOIN b USING (event_type) GROUP BY 1),
f AS (SELECT event_id, event_type, q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS by_iqr, sd > 0 AND abs((value - mean) / sd) > 3 AS by_z, mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.5 AS by_mad FROM events JOIN b USING (event_type) JOIN m USING (event_type))"""


@query(f"WITH {_OUT} SELECT * FROM f WHERE by_iqr OR by_z OR by_mad")
def metric_outliers(spark, d):
    flagged = stats.outliers(table(spark, d, "events"), "event_type", "value")
    return flagged.where("by_iqr OR by_z OR by_mad").select("event_id", "event_type", "by_iqr", "by_z", "by_mad")


def _series(spark, d):
    """Hourly mean of each event type: a series to smooth and to extrapolate."""
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v")).withColumn("x", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("double"))


_S = "s AS (SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS v, date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS x FROM events GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM s)"
_MA = f"{_S}, ma AS (SELECT *, round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 6) AS ma FROM o)"


@query(f"WITH {_MA} SELECT event_type, day, ma FROM ma WHERE i <= greatest(n - 4, 1)")
def moving_average(spark, d):
    return stats.moving_average(_series(spark, d), "event_type", "day", "v").select("event_type", "day", "ma")


@query(f"WITH {_S} SELECT event_type, round(sum(pow(0.7, n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.3 END * v), 6) AS ema FROM o GROUP BY 1")
def exponential_average(spark, d):
    return stats.exponential_average(_series(spark, d), "event_type", "day", "v")


@query(f"WITH {_MA}, e AS (SELECT event_type, max(n) AS n, avg(ma) FILTER (i <= 5) AS early, avg(ma) FILTER (i > n - 9) AS late FROM ma WHERE i <= n - 4 GROUP BY 1) SELECT event_type, n, CASE WHEN n < 10 THEN 'insufficient_data' WHEN (late - early) / early > 0.05 THEN 'increasing' WHEN (late - early) / early < -0.05 THEN 'decreasing' ELSE 'stable' END AS direction FROM e")
def trend_direction(spark, d):
    return stats.trend_direction(_series(spark, d), "event_type", "day", "v")


@query(f"WITH {_S}, h AS (SELECT event_type, round(avg(v) FILTER (i <= n // 2), 6) AS early_mean, round(avg(v) FILTER (i > n // 2), 6) AS late_mean FROM o GROUP BY 1) SELECT *, CASE WHEN late_mean > 1.1 * early_mean THEN 'increasing' WHEN late_mean < 0.9 * early_mean THEN 'decreasing' ELSE 'stable' END AS direction FROM h")
def half_split_trend(spark, d):
    return stats.half_split_trend(_series(spark, d), "event_type", "day", "v")


@query(f"WITH {_S}, nb AS (SELECT *, (lag(v) OVER w + lead(v) OVER w) / 2 AS expected FROM o WINDOW w AS (PARTITION BY event_type ORDER BY day)) SELECT event_type, day, round(expected, 6) AS expected FROM nb WHERE expected > 0 AND abs(v - expected) > 0.1 * expected")
def neighbour_anomalies(spark, d):
    return stats.neighbour_anomalies(_series(spark, d), "event_type", "day", "v", 0.1).select("event_type", "day", F.round("expected", 6).alias("expected"))


@query(f"WITH {_S}, c AS (SELECT *, avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM o) SELECT event_type, day, round(b, 6) AS before, round(a, 6) AS after FROM c WHERE n >= 20 AND i > 5 AND i <= n - 4 AND b > 0 AND abs(a - b) > 0.05 * b")
def change_points(spark, d):
    return stats.change_points(_series(spark, d), "event_type", "day", "v", limit=0.05).select("event_type", "day", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query(f"WITH {_S} SELECT event_type, count(*) AS n, round(regr_slope(v, x), 6) AS slope, round(regr_intercept(v, x), 6) AS intercept, round(corr(v, x), 6) AS r FROM s GROUP BY 1")
def linear_trend(spark, d):
    return stats.linear_trend(_series(spark, d), "event_type", "x", "v")


@query()
def trend_significance(spark, d):
    return stats.trend_significance(_series(spark, d), "event_type", "x", "v")


_HOURLY = "hs AS (SELECT event_type, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS v FROM events GROUP BY ALL), ho AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1)::DOUBLE AS x FROM hs)"


@query(f"WITH {_HOURLY}, f AS (SELECT event_type, count(*) AS n, regr_slope(v, x) AS b, regr_intercept(v, x) AS a, stddev_samp(v) AS sd FROM ho GROUP BY 1), g AS (SELECT event_type, step::INTEGER AS step, greatest(a + b * (n + 24 * step), 0e0) AS mean, 2 * sd * (1 + 0.1e0 * step) AS half FROM f, range(1, 4) t(step) WHERE n >= 5) SELECT event_type, step, round(mean, 4) AS forecast, round(greatest(mean - half, 0e0), 4) AS low, round(mean + half, 4) AS high FROM g")
def forecast(spark, d):
    """Hourly means, three days ahead."""
    hourly = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.round(F.avg("value"), 6).alias("v"))
    return stats.forecast(hourly, "event_type", "hour", "v")



@query("WITH s AS (SELECT avg(value) FILTER (event_type = 'view') AS m1, avg(value) FILTER (event_type = 'click') AS m2, var_samp(value) FILTER (event_type = 'view') AS v1, var_samp(value) FILTER (event_type = 'click') AS v2 FROM events), e AS (SELECT *, abs((m2 - m1) / sqrt((v1 + v2) / 2)) AS c FROM s) SELECT round(m2 - m1, 6) AS difference, round(m2 / m1, 6) AS ratio, round(c, 6) AS cohens_d, CASE WHEN c < 0.2 THEN 'negligible' WHEN c < 0.5 THEN 'small' WHEN c < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM e")
def compare_distributions(spark, d):
    return stats.compare(table(spark, d, "events"), "event_type", "view", "click", "value")


@query("""WITH a AS (SELECT l_suppkey, avg(l_extendedprice) AS was FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1), b AS (SELECT l_suppkey, avg(l_extendedprice) AS now FROM lineitem WHERE year(l_shipdate) = 1997 GROUP BY 1),
j AS (SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, was, now, CASE WHEN was = 0 THEN CASE WHEN now > 0 THEN 100e0 ELSE 0e0 END ELSE (now - was) / was * 100 END AS c FROM a FULL JOIN b USING (l_suppkey))
SELECT l_suppkey, round(was, 4) AS was, round(now, 4) AS now, round(c, 4) AS change, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'removed' WHEN abs(c) < 5 THEN 'unchanged' WHEN c >= 20 THEN 'critical' WHEN c >= 10 THEN 'regression' WHEN c <= -10 THEN 'improvement' ELSE 'unchanged' END AS status FROM j""")
def regression_full_outer(spark, d):
    items = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.avg("l_extendedprice").alias("value"))
    return stats.regressions(items.where("y = 1996"), items.where("y = 1997"), "l_suppkey")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(avg(value) - 1.96e0 * stddev_samp(value) / sqrt(count(*)), 6) AS low, round(avg(value) + 1.96e0 * stddev_samp(value) / sqrt(count(*)), 6) AS high FROM events GROUP BY 1")
def confidence_interval(spark, d):
    half = 1.96 * F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("value") - half, 6).alias("low"), F.round(F.avg("value") + half, 6).alias("high"))


@query("SELECT 'k=' || json_extract_string(props, '$.k') || ',type=' || event_type AS label_key, count(*) AS n FROM events GROUP BY 1")
def label_key_metrics(spark, d):
    """Metric series named by their sorted labels."""
    labels = F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    key = F.array_join(F.array_sort(F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, d, "events").groupBy(key.alias("label_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'events_' || event_type || '_total ' || count(*) AS line FROM events GROUP BY event_type UNION ALL SELECT 'events_' || event_type || '_max ' || printf('%.3f', max(value)) FROM events GROUP BY event_type")
def prometheus_lines(spark, d):
    """Metric lines in text exposition form."""
    row = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("v"))
    lines = F.array(F.format_string("events_%s_total %d", "event_type", "n"), F.format_string("events_%s_max %.3f", "event_type", "v"))
    return row.select(F.explode(lines).alias("line"))


@query("SELECT user_id, round(100e0 * count(*) FILTER (event_type = 'error') / count(*), 2) AS error_percent, CASE WHEN 100e0 * count(*) FILTER (event_type = 'error') / count(*) > 25 THEN 'unhealthy' WHEN 100e0 * count(*) FILTER (event_type = 'error') / count(*) > 20 THEN 'degraded' ELSE 'healthy' END AS health FROM events GROUP BY 1")
def health_rollup(spark, d):
    share = 100.0 * F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(share, 2).alias("error_percent"), F.when(share > 25, "unhealthy").when(share > 20, "degraded").otherwise("healthy").alias("health"))
