"""Exports, defaults, vector index statistics, approximate search by hashing, thresholds and registries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsense.functions import markup
from docsense.operators import graphindex, registry, scan, stats, usage, vectors
from docsense.operators.staging import staged
from docsense.sources.tables import SINCE_SQL, USAGE_SQL, as_of, table, usage_events

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("SELECT doc_id, to_json({'id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars})::VARCHAR AS record FROM documents")
def bulk_export(spark, d):
    """Every document as a JSON record, a line each."""
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", "source", "n_chars")).alias("record"))


@query("""WITH w AS (SELECT DISTINCT p_brand AS id FROM part UNION SELECT 'missing-' || r_regionkey || '_item' FROM region), k AS (SELECT p_brand AS id, count(*) AS n FROM part GROUP BY 1)
SELECT w.id, coalesce(CASE WHEN k.id IS NOT NULL THEN 'Known ' || w.id END, 'Missing ' || split_part(split_part(w.id, '-', 2), '_', 1) || ' Item') AS title, coalesce(n, 0) AS n FROM w LEFT JOIN k USING (id)""")
def details_with_defaults(spark, d):
    """Selected standards with their details; where there are none a title is made of the id."""
    known = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("known", F.concat(F.lit("Known "), "id"))
    missing = table(spark, d, "region").select(F.concat(F.lit("missing-"), F.col("r_regionkey").cast("string"), F.lit("_item")).alias("id"))
    wanted = table(spark, d, "part").select(F.col("p_brand").alias("id")).unionByName(missing).distinct()
    return wanted.join(known, "id", "left").select("id", F.coalesce("known", markup.title_from_id(F.col("id"))).alias("title"), F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT label, count(*) AS vectors, max(len(embedding))::INTEGER AS dimension, count(*) * max(len(embedding)) * 4 AS bytes, round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 4) AS mean_norm FROM embeddings GROUP BY 1")
def vector_index_stats(spark, d):
    """What an index of each label holds."""
    rows = table(spark, d, "embeddings").select("label", F.size("embedding").alias("size"), vectors.norm(F.col("embedding").cast("array<double>")).alias("norm"))
    n = F.count(F.lit(1))
    return rows.groupBy("label").agg(n.alias("vectors"), F.max("size").alias("dimension"), (n * F.max("size") * 4).alias("bytes"), F.round(F.avg("norm"), 4).alias("mean_norm"))


_Z = "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n, user_id FROM events GROUP BY user_id) SELECT event_id, user_id, round((value - m) / sd, 6) AS z FROM events JOIN s USING (user_id) WHERE n >= 10 AND sd > 0 AND abs((value - m) / sd) > "


@query(_Z + "2")
def zscore_anomalies(spark, d):
    """Points over two deviations from the mean of their series, in series of ten points and more."""
    return stats.zscores(table(spark, d, "events"), "user_id", "value", 2).select("event_id", "user_id", "z")


@query(_Z + "3")
def zscore_outliers(spark, d):
    """The same over three deviations."""
    return stats.zscores(table(spark, d, "events"), "user_id", "value").select("event_id", "user_id", "z")


#: Luhn's rule over the digits of a number, the last one first: each second one doubled, less nine where that passes nine.
_LUHN = "list_sum(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse(s), i, 1)::INTEGER ELSE 2 * substr(reverse(s), i, 1)::INTEGER - CASE WHEN substr(reverse(s), i, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0"


@query(f"SELECT o_orderkey, {_LUHN} AS valid FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS s FROM orders)")
def luhn_numbers(spark, d):
    """Order numbers whose last digit checks the others."""
    return table(spark, d, "orders").select("o_orderkey", scan.luhn_valid(F.col("o_orderkey").cast("string")).alias("valid"))


@query()
def principal_components(spark, d):
    """Vectors on their first eight principal components."""
    return vectors.principal_components(table(spark, d, "embeddings"), 8)


_ASK = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0)"


@query(f"WITH {_ASK}, s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings ON vec_id <> query_id) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 10")
def semantic_topk(spark, d):
    """The ten best of each query by cosine alone: scores above zero, no second ranking."""
    v = table(spark, d, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 100 = 0"), 10, "cosine").where("score > 0").select("query_id", "vec_id", "score", "rank")


@query()
def graph_search(spark, d):
    """Approximate neighbours by a layered graph over each shard of vectors, merged."""
    v = table(spark, d, "embeddings")
    return graphindex.search(staged(graphindex.build(v), "graph-index"), v.where("vec_id % 100 = 0"), 10)


@query()
def lsh_search(spark, d):
    """Approximate neighbours by random projections, Spark's own hashing."""
    v = table(spark, d, "embeddings")
    return vectors.lsh_search(v, v.where("vec_id % 100 = 0"), 10)


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '^[.,;:!?\"''()\[\]{}]+|[.,;:!?\"''()\[\]{}]+$', '', 'g')), lambda x: x <> '')) AS n, len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: regexp_matches(x, '[a-z0-9][/.][a-z0-9]'))) AS joined FROM documents")
def word_tokens(spark, d):
    """White-space words without punctuation at their ends; ``a/b`` and ``vue.js`` stay whole."""
    words = F.split(F.lower("text"), r"\s+")
    edges = r"""^[.,;:!?"'()\[\]{}]+|[.,;:!?"'()\[\]{}]+$"""
    bare = F.filter(F.transform(words, lambda x: F.regexp_replace(x, edges, "")), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.size(bare).cast("long").alias("n"), F.size(F.filter(words, lambda x: x.rlike("[a-z0-9][/.][a-z0-9]"))).cast("long").alias("joined"))


_MET = {"click": "cpu_usage", "error": "error_rate", "purchase": "memory_usage", "signup": "cache_hit_rate", "view": "disk_usage"}
_LIMITS = ", ".join(f"('{m}', '{level}', '{way}', {limit}e0)" for m, level, way, limit in registry.THRESHOLDS)


@query(f"""WITH p AS (SELECT event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MET.items())} END AS metric, value FROM events), l(metric, level, way, lim) AS (VALUES {_LIMITS})
SELECT event_id, metric, value, level, lim AS "limit" FROM p JOIN l USING (metric) WHERE CASE way WHEN 'gt' THEN value > lim ELSE value < lim END""")
def exceeded_thresholds(spark, d):
    named = F.create_map(*[F.lit(x) for p in _MET.items() for x in p])[F.col("event_type")]
    return registry.exceeded(table(spark, d, "events").select("event_id", named.alias("metric"), "value"), "metric", "value")


_GAP = f"{USAGE_SQL}, r AS (SELECT * FROM u WHERE {SINCE_SQL}), c AS (SELECT standard_id, count(*) AS uses FROM r GROUP BY 1)"


@query(f"WITH {_GAP}, g AS (SELECT DISTINCT p_partkey % 100 AS k, p_brand FROM part WHERE p_size < 10) SELECT p_brand, standard_id, uses, round((SELECT avg(uses) FROM c), 6) AS mean FROM g JOIN c ON standard_id = k::VARCHAR WHERE uses < (SELECT avg(uses) FROM c)")
def gap_usage(spark, d):
    """Gaps joined with the usage of their standards, those used less than the mean."""
    counts = usage.within(usage_events(spark, d), as_of()).groupBy("standard_id").agg(F.count(F.lit(1)).alias("uses"))
    low = usage.under_represented(counts, "uses", 1.0).withColumnRenamed("mean_count", "mean")
    gaps = table(spark, d, "part").where("p_size < 10").select((F.col("p_partkey") % 100).cast("string").alias("standard_id"), "p_brand").distinct()
    return gaps.join(low, "standard_id").select("p_brand", "standard_id", "uses", F.round("mean", 6).alias("mean"))


@query("WITH t AS (SELECT conv_id, list(DISTINCT role ORDER BY role) AS roles FROM conversations GROUP BY 1) SELECT conv_id, array_to_string(list_filter(['assistant', 'system', 'tool', 'user'], lambda x: NOT list_contains(roles, x)), ',') AS next_batch FROM t")
def next_batch(spark, d):
    """Sections to load next: those wanted without those loaded."""
    held = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    want = F.array(*map(F.lit, ("assistant", "system", "tool", "user")))
    return held.select("conv_id", F.array_join(F.array_except(want, "roles"), ",").alias("next_batch"))


#: Patterns of injected SQL and script, by name.
INJECTIONS = {
    "union_select": r"(?i)\bunion\s+(all\s+)?select\b", "drop_table": r"(?i)\bdrop\s+(table|database)\b", "stacked": r"(?i);\s*(delete|update|insert|drop)\b", "tautology": r"(?i)\bor\s+'?1'?\s*=\s*'?1", "comment": r"--\s*$|/\*.*\*/",
    "script_tag": r"(?i)<script\b", "javascript_url": r"(?i)javascript:", "event_handler": r"(?i)\bon[a-z]+\s*=", "iframe": r"(?i)<iframe\b", "object_tag": r"(?i)<(object|embed)\b", "data_url": r"(?i)data:text/html", "expression": r"(?i)expression\s*\(", "eval_call": r"(?i)\beval\s*\(",
}
_INJ = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in INJECTIONS.items())


@query(f"WITH r(name, pattern) AS (VALUES {_INJ}), t AS (SELECT page_id, unnest(['url: ' || url, html]) AS said FROM pages) SELECT page_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM t JOIN r ON regexp_matches(said, pattern) GROUP BY 1")
def injection_names(spark, d):
    """Which injection patterns the texts of a record hold, anywhere in its array of texts."""
    texts = F.array(F.concat(F.lit("url: "), "url"), F.col("html"))

    def held(pattern):
        return F.exists(texts, lambda t: t.rlike(pattern))

    names = F.array_sort(F.array_compact(F.array(*[F.when(held(p), k) for k, p in INJECTIONS.items()])))
    return table(spark, d, "pages").select("page_id", F.array_join(names, ",").alias("names")).where("names <> ''")


registry.ANALYSERS.setdefault("html", lambda files, key, text: scan.line_findings(files.withColumn("of", F.lit("html")), key, text, language="of"))


@query("""WITH l AS (SELECT page_id, i AS line, x[i] AS code FROM (SELECT page_id, string_split(html, chr(10)) AS x FROM pages WHERE page_id % 2 = 0), unnest(range(1, len(x) + 1)) t(i)), r(rule_id, pattern) AS (VALUES """ + ", ".join("('" + i + "', '" + p.replace("'", "''") + "')" for i, g, _, p, *_ in scan.LINE_RULES if g in ("html", "any")) + """) SELECT page_id, 'html' AS language, rule_id, line::INTEGER AS line FROM l JOIN r ON regexp_matches(code, pattern)""")
def registered_analysers(spark, d):
    """Files handed to the analyser that is registered for their language; others have none."""
    files = table(spark, d, "pages").withColumn("language", F.when(F.col("page_id") % 2 == 0, "html").otherwise("cobol"))
    return registry.analyse(files, "page_id", "language", "html")


registry.HEALTH.setdefault("has_points", lambda df: F.count(F.lit(1)) > 0)
registry.HEALTH.setdefault("few_errors", lambda df: F.count_if(F.col("event_type") == "error") < 0.5 * F.count(F.lit(1)))
registry.HEALTH.setdefault("values_known", lambda df: F.count_if(F.col("value").isNull()) == 0)


@query("SELECT 'has_points' AS \"check\", count(*) > 0 AS healthy FROM events UNION ALL SELECT 'few_errors', count(*) FILTER (event_type = 'error') < 0.5 * count(*) FROM events UNION ALL SELECT 'values_known', count(*) FILTER (value IS NULL) = 0 FROM events")
def registered_health(spark, d):
    return registry.health(table(spark, d, "events"))


@query("SELECT 'Users' AS kind, user_id::VARCHAR AS subject, dense_rank() OVER (ORDER BY n DESC)::INTEGER AS place FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def dense_places(spark, d):
    """Places by count, equal counts sharing one; the counts are ranked, which are few, and joined back."""
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    levels = counts.select("n").distinct().withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"))))
    return counts.join(levels, "n").select(F.lit("Users").alias("kind"), F.col("user_id").cast("string").alias("subject"), "place")
