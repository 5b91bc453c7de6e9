"""Standards quality, coverage, recommendations, search analytics and version queries, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsense.operators import analytics, usage
from docsense.sources.tables import AS_OF, SINCE_SQL, USAGE_SQL, as_of, table, usage_events

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _standards(spark, d):
    """Documents as standards; every seventh creation date is not a date."""
    text = F.col("text")
    date = F.when(F.col("doc_id") % 7 == 0, "unknown").otherwise(F.concat(F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    return table(spark, d, "documents").select(
        "doc_id",
        F.trim(F.substring(text, 1, 40)).alias("title"),
        text.alias("description"),
        F.when(F.col("lang") != "es", F.col("lang")).alias("domain"),
        date.alias("created_date"),
        text.contains("!").alias("examples"),
        text.contains(",").alias("guidelines"),
        text.contains("@").alias("implementation_guides"),
        text.contains("=").alias("code_examples"),
        "lang",
        "source",
    )


_STD = """std AS (SELECT doc_id, trim(substr(text, 1, 40), ' ') AS title, text AS description, CASE WHEN lang <> 'es' THEN lang END AS domain,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE DATE '2020-01-01' + (doc_id % 2000)::INTEGER END AS created, contains(text, '!') AS examples, contains(text, ',') AS guidelines, contains(text, '@') AS guides, contains(text, '=') AS code, lang, source FROM documents),
given AS (SELECT *, coalesce(title <> '', false) AS has_title, coalesce(description <> '', false) AS has_description, coalesce(domain <> '', false) AS has_domain, date_diff('day', created, DATE '2024-01-31') AS days, length(coalesce(description, '')) AS len FROM std)"""
_Q = f"""{_STD}, parts AS (SELECT doc_id, least((has_title::INTEGER + has_description::INTEGER + has_domain::INTEGER + 1 + 0.5e0 * (examples::INTEGER + guidelines::INTEGER + guides::INTEGER + code::INTEGER)) / 6e0, 1e0) AS completeness,
  CASE WHEN created IS NULL THEN 0.8e0 ELSE 1e0 END AS consistency, CASE WHEN len < 50 THEN 0.3e0 WHEN len < 200 THEN 0.7e0 ELSE 1e0 END AS clarity, CASE WHEN code THEN 0.4e0 ELSE 0e0 END + CASE WHEN guides THEN 0.4e0 ELSE 0e0 END + CASE WHEN examples THEN 0.2e0 ELSE 0e0 END AS actionability,
  0.8e0 AS coverage, CASE WHEN days > 365 THEN greatest(0.5e0, 1 - (days - 365) / 1000e0) ELSE 1e0 END AS maintenance FROM given),
q AS (SELECT doc_id, round(completeness, 6) AS completeness, round(consistency, 6) AS consistency, round(clarity, 6) AS clarity, round(actionability, 6) AS actionability, round(coverage, 6) AS coverage, round(maintenance, 6) AS maintenance,
  round(completeness * 0.25e0 + consistency * 0.2e0 + clarity * 0.2e0 + actionability * 0.15e0 + coverage * 0.1e0 + maintenance * 0.1e0, 6) AS quality FROM parts),
i AS (SELECT doc_id, unnest(list_filter([CASE WHEN NOT has_title THEN ['completeness', 'Missing title', 'low', 'Add a clear, descriptive title'] END, CASE WHEN NOT has_description THEN ['completeness', 'Missing description', 'low', 'Add a comprehensive description'] END,
  CASE WHEN NOT has_domain THEN ['completeness', 'Missing domain', 'low', 'Specify the domain or category'] END, CASE WHEN len < 100 THEN ['clarity', 'Description is too brief', 'medium', 'Expand description with more detail'] END,
  CASE WHEN NOT code AND NOT guides THEN ['actionability', 'Lacks practical examples', 'medium', 'Add code examples'] END], lambda x: x IS NOT NULL)) AS x FROM given),
issues AS (SELECT doc_id, x[1] AS aspect, x[2] AS issue, x[3] AS effort, x[4] AS step FROM i)"""


@query(f"WITH {_Q} SELECT * FROM q")
def quality_score(spark, d):
    """All six weighted parts of a standard's quality."""
    return analytics.quality_scores(_standards(spark, d), "doc_id", as_of().cast("timestamp"))


@query(f"WITH {_Q} SELECT * FROM issues")
def quality_issues(spark, d):
    return analytics.quality_issues(_standards(spark, d), "doc_id")


_QR = f"{_Q}, w AS (SELECT doc_id, quality FROM q WHERE quality < 0.7 ORDER BY quality, doc_id LIMIT 20), qr AS (SELECT doc_id, quality, aspect, issue, effort, CASE WHEN quality < 0.5 THEN 'high' ELSE 'medium' END AS priority FROM w JOIN issues USING (doc_id))"


@query(f"WITH {_QR} SELECT * FROM qr")
def quality_recommendations(spark, d):
    s = _standards(spark, d)
    return analytics.quality_recommendations(analytics.quality_scores(s, "doc_id", as_of().cast("timestamp")), analytics.quality_issues(s, "doc_id"), "doc_id")


_COV = "v AS (SELECT 'domain' AS kind, lang AS value FROM documents UNION ALL SELECT 'technology', source FROM documents UNION ALL SELECT 'technology', lang || '-' || source FROM documents), cov AS (SELECT kind, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL), sparse AS (SELECT kind, value, n, round(m, 6) AS mean FROM cov JOIN (SELECT kind, avg(n) AS m FROM cov GROUP BY 1) USING (kind) WHERE n < 0.5 * m)"


def _coverage(spark, d):
    kinds = {"domain": F.array("lang"), "technology": F.array("source", F.concat("lang", F.lit("-"), "source"))}
    return analytics.coverage_counts(table(spark, d, "documents"), kinds)


@query(f"WITH {_COV} SELECT * FROM cov")
def coverage_counts(spark, d):
    """Domains and technologies, counted over exploded arrays."""
    return _coverage(spark, d)


@query(f"WITH {_COV} SELECT * FROM sparse")
def coverage_gaps(spark, d):
    return analytics.sparse_values(_coverage(spark, d))


_LOW = f"{USAGE_SQL}, r AS (SELECT * FROM u WHERE {SINCE_SQL}), uc AS (SELECT standard_id, count(*) AS uses FROM r GROUP BY 1), low AS (SELECT standard_id, uses FROM uc WHERE uses < 0.3 * (SELECT avg(uses) FROM uc))"


@query(f"""WITH {_QR}, {_COV}, {_LOW} SELECT 'quality' AS kind, doc_id::VARCHAR AS subject, priority, issue AS reason FROM qr UNION ALL
SELECT 'gap', value, 'medium', kind || ' has ' || n FROM sparse UNION ALL SELECT 'usage', standard_id, 'low', 'used ' || uses || ' times' FROM low""")
def all_recommendations(spark, d):
    """Quality, gap and usage recommendations in one table (usage: under 30 % of the mean)."""
    s = _standards(spark, d)
    quality = analytics.quality_recommendations(analytics.quality_scores(s, "doc_id", as_of().cast("timestamp")), analytics.quality_issues(s, "doc_id"), "doc_id")
    counts = usage.within(usage_events(spark, d), as_of()).groupBy("standard_id").agg(F.count(F.lit(1)).alias("uses"))
    return analytics.recommendations(
        quality=quality.select(F.col("doc_id").alias("subject"), "priority", F.col("issue").alias("reason")),
        gap=analytics.sparse_values(_coverage(spark, d)).select(F.col("value").alias("subject"), F.lit("medium").alias("priority"), F.concat("kind", F.lit(" has "), F.col("n").cast("string")).alias("reason")),
        usage=usage.under_represented(counts, "uses", 0.3).select(F.col("standard_id").alias("subject"), F.lit("low").alias("priority"), F.concat(F.lit("used "), F.col("uses").cast("string"), F.lit(" times")).alias("reason")),
    )


@query(f"""WITH {_Q}, {_COV}, {_LOW} SELECT 'usage' AS section, to_json({{'standard_id': standard_id, 'uses': uses}})::VARCHAR AS record FROM uc UNION ALL SELECT 'coverage', to_json({{'kind': kind, 'value': value, 'n': n}})::VARCHAR FROM cov
UNION ALL SELECT 'gaps', to_json({{'kind': kind, 'value': value, 'n': n}})::VARCHAR FROM sparse UNION ALL SELECT 'issues', to_json({{'doc_id': doc_id, 'issue': issue}})::VARCHAR FROM issues UNION ALL SELECT 'summary', to_json({{'standards': count(*)}})::VARCHAR FROM q""")
def analytics_report(spark, d):
    """The sections of an analytics report, a JSON record a row."""
    s = _standards(spark, d)
    counts = usage.within(usage_events(spark, d), as_of()).groupBy("standard_id").agg(F.count(F.lit(1)).alias("uses"))
    cover = _coverage(spark, d)
    return analytics.report(
        usage=counts,
        coverage=cover,
        gaps=analytics.sparse_values(cover).select("kind", "value", "n"),
        issues=analytics.quality_issues(s, "doc_id").select("doc_id", "issue"),
        summary=s.agg(F.count(F.lit(1)).alias("standards")),
    )


@query("""WITH q AS (SELECT lower(trim(c.text, ' ')) AS query, length(c.text) AS results, e.value AS ms, e.event_type FROM conversations c JOIN events e ON e.event_id = c.conv_id * 20 + c.turn WHERE c.role = 'user')
SELECT sha256(query) AS query_key, count(*) AS n, round(avg(ms), 6) AS latency, round(avg(results), 6) AS mean_results, round(100e0 * count(*) FILTER (event_type = 'view') / count(*), 4) AS hit_rate, count(*) FILTER (event_type = 'error') AS failures FROM q GROUP BY query""")
def search_analytics(spark, d):
    """Latency, hit rate, mean results and failures of each query text (times from the event of its number)."""
    said = table(spark, d, "conversations").where("role = 'user'").withColumn("event_id", F.col("conv_id") * 20 + F.col("turn"))
    rows = said.join(table(spark, d, "events").select("event_id", "value", "event_type"), "event_id").withColumn("query", F.lower(F.trim("text")))
    n = F.count(F.lit(1))
    out = rows.groupBy("query").agg(n.alias("n"), F.round(F.avg("value"), 6).alias("latency"), F.round(F.avg(F.length("text")), 6).alias("mean_results"), F.round(100 * F.count_if(F.col("event_type") == "view") / n, 4).alias("hit_rate"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return out.select(F.sha2(F.col("query").cast("binary"), 256).alias("query_key"), *out.columns[1:])


@query("SELECT user_id, string_agg(json_extract_string(props, '$.k'), ',' ORDER BY ts, event_id) AS clicked FROM events WHERE event_type = 'click' GROUP BY 1")
def click_through(spark, d):
    """The results that a session clicked, in order."""
    clicks = table(spark, d, "events").where("event_type = 'click'")
    kept = clicks.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.get_json_object("props", "$.k").alias("k")))).alias("c"))
    return kept.select("user_id", F.array_join(F.transform("c", lambda x: x["k"]), ",").alias("clicked"))


@query("SELECT lang AS category, count(*) AS n, list_aggregate(list_sort(list(DISTINCT source)), 'string_agg', ',') AS tags FROM documents GROUP BY 1")
def category_listing(spark, d):
    """Categories with counts and their distinct sorted tags."""
    return table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("tags"))


@query("""WITH a AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS v, count(*) FILTER (l_linestatus = 'F') AS mandatory FROM lineitem GROUP BY 1)
SELECT l_orderkey, n AS requirements, mandatory, round(least(v::DOUBLE / n, 1e0), 6) AS compliance FROM a""")
def compliance_scores(spark, d):
    """Verified over all requirements (an order's items; not returned is verified), with mandatory ones by status."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus")).alias("items"))
    verified = F.filter("items", lambda x: x["l_returnflag"] == "N")
    return items.select("l_orderkey", F.size("items").cast("long").alias("requirements"), F.size(F.filter("items", lambda x: x["l_linestatus"] == "F")).cast("long").alias("mandatory"), F.round(analytics.compliance_score(verified, F.col("items")), 6).alias("compliance"))


@query("SELECT o_orderkey, l_linenumber AS requirement, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_linenumber IN (1, 3, 5) AND l_returnflag = 'R'")
def requirement_filter(spark, d):
    """Requirements of active standards by id subset and category."""
    open_ = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    items = table(spark, d, "lineitem").where(F.col("l_linenumber").isin(1, 3, 5) & (F.col("l_returnflag") == "R"))
    return items.join(open_, items["l_orderkey"] == open_["o_orderkey"]).select("o_orderkey", F.col("l_linenumber").alias("requirement"), "l_partkey")


@query(f"WITH u AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN event_id % 3 = 1 THEN 'soon' ELSE NULL END AS said, ts FROM events) SELECT event_id, CASE WHEN event_id % 3 = 0 THEN floor(epoch(TIMESTAMP '{AS_OF}' - date_trunc('second', ts)) / 86400)::BIGINT END AS days_since FROM u")
def parsed_dates(spark, d):
    """ISO texts with Z as dates, what can't be read as null, and whole days since."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(F.col("event_id") % 3 == 1, "soon")
    rows = table(spark, d, "events").select("event_id", analytics.parsed_date(said).alias("at"))
    return rows.select("event_id", F.floor((F.unix_seconds(as_of().cast("timestamp")) - F.unix_seconds("at")) / 86400).alias("days_since"))


@query("""WITH c AS (SELECT upper(lang) || '_' || doc_id AS id, doc_id, source FROM documents), w(asked) AS (SELECT lower(lang) || '-' || (doc_id) FROM documents WHERE source = 'src3')
SELECT asked, doc_id, source FROM w JOIN c ON lower(replace(asked, '_', '-')) = lower(replace(id, '_', '-'))""")
def point_lookup(spark, d):
    """Ids looked up whatever their case and separators, through one normalised key."""
    norm = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("-")))
    docs = table(spark, d, "documents")
    known = docs.select("doc_id", "source", norm(F.concat(F.upper("lang"), F.lit("_"), F.col("doc_id").cast("string"))).alias("key"))
    asked = docs.where("source = 'src3'").select(F.concat(F.lower("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("asked"))
    return asked.join(known, norm(F.col("asked")) == F.col("key")).select("asked", "doc_id", "source")


@query("""WITH c AS (SELECT lang || '-' || source AS k, list(DISTINCT lang || '_' || (doc_id % 5)) AS tags FROM documents GROUP BY 1)
SELECT a.k AS a, b.k AS b, len(list_intersect(a.tags, b.tags)) AS shared, round(least(0.2e0 * len(list_intersect(a.tags, b.tags)), 1e0), 6) AS score FROM c a JOIN c b ON a.k < b.k AND split_part(a.k, '-', 1) = split_part(b.k, '-', 1)""")
def tag_overlap(spark, d):
    """Shared tags of two collections of one language, 0.2 each and at most 1."""
    tags = table(spark, d, "documents").groupBy("lang", F.concat("lang", F.lit("-"), "source").alias("k")).agg(F.collect_set(F.concat("lang", F.lit("_"), (F.col("doc_id") % 5).cast("string"))).alias("tags"))
    b = tags.select("lang", F.col("k").alias("b"), F.col("tags").alias("other"))
    shared = F.size(F.array_intersect("tags", "other"))
    return tags.join(b, "lang").where("k < b").select(F.col("k").alias("a"), "b", shared.alias("shared").cast("long"), F.round(F.least(0.2 * shared, F.lit(1.0)), 6).alias("score"))


@query(f"""WITH {USAGE_SQL} SELECT standard_id, max(ts) AS last_access, row_number() OVER (ORDER BY max(ts) DESC, standard_id)::INTEGER AS place FROM u GROUP BY 1 ORDER BY last_access DESC, standard_id LIMIT 25""")
def warm_by_recency(spark, d):
    """Candidates to keep warm by last access."""
    seen = usage_events(spark, d).groupBy("standard_id").agg(F.max("ts").alias("last_access"))
    best = seen.orderBy(F.desc("last_access"), "standard_id").limit(25)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_access"), "standard_id")))


@query(f"WITH {USAGE_SQL} SELECT standard_id, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, standard_id LIMIT 25")
def warm_by_frequency(spark, d):
    return usage_events(spark, d).groupBy("standard_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "standard_id").limit(25)


@query(f"WITH {USAGE_SQL}, a AS (SELECT session_id, standard_id, max(ts) AS seen FROM u GROUP BY ALL) SELECT session_id, arg_min(standard_id, (seen, standard_id)) AS victim FROM a GROUP BY 1")
def lru_victim(spark, d):
    """The least recently used entry of each session's cache."""
    last = usage_events(spark, d).groupBy("session_id", "standard_id").agg(F.max("ts").alias("at"))
    return last.groupBy("session_id").agg(F.min_by("standard_id", F.struct("at", "standard_id")).alias("victim"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN least(1e0 * (event_id % 8 + 1), 5e0) ELSE least(1e0 * pow(2, event_id % 8), 60e0) END AS delay, round((json_extract_string(props, '$.k')::INTEGER * 60e0) / 100, 6) AS wait FROM events""")
def retry_delays(spark, d):
    """Retry delays (constant, linear, exponential, each capped) and the estimated wait of a queue."""
    n = F.col("event_id") % 8
    kind = F.col("event_id") % 3
    delay = F.when(kind == 0, 1.0).when(kind == 1, F.least((n + 1).cast("double"), F.lit(5.0))).otherwise(F.least(F.pow(F.lit(2.0), n.cast("double")), F.lit(60.0)))
    return table(spark, d, "events").select("event_id", delay.alias("delay"), F.round(F.get_json_object("props", "$.k").cast("int") * 60.0 / 100, 6).alias("wait"))
