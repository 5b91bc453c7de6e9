"""Personal-data findings, document checks, reviewer assignment and input checks, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsense.operators import checks, pii
from docsense.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def pii_spans(spark, d):
    """Every finding in every document: kind, place and confidence, without overlaps."""
    return pii.span_rows(table(spark, d, "documents"), ["doc_id"], "text")


@query()
def pii_kinds(spark, d):
    """Report of each source: documents with findings, findings, and their kinds."""
    found = pii.span_rows(table(spark, d, "documents"), ["source", "doc_id"], "text")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query()
def pii_hashed(spark, d):
    """Texts with findings replaced by kind and digest."""
    rows = table(spark, d, "documents").select("doc_id", "text", pii.redacted(F.col("text"), "hash").alias("clean"))
    return rows.select("doc_id", F.sha2(F.col("clean").cast("binary"), 256).alias("clean_sha256"), (F.col("clean") != F.col("text")).alias("changed"))


def _dialogues(spark, d):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    told = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return told.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), "turns")).alias("body"))


@query()
def pii_json_paths(spark, d):
    """Conversations as JSON, redacted through all levels, and the paths of what was found."""
    found = pii.filtered_json(_dialogues(spark, d), "conv_id", "body")
    return found.select("conv_id", F.array_join("paths", ",").alias("paths"))


@query("SELECT conv_id, 3 AS depth, (2 + 2 * count(*))::INTEGER AS keys, max(greatest(length(text), length(role)))::INTEGER AS longest, 2 + 2 * count(*) <= 12 AND max(greatest(length(text), length(role))) <= 400 AS accepted FROM conversations GROUP BY 1")
def json_limits(spark, d):
    return pii.json_limits(_dialogues(spark, d), "conv_id", "body", 10, 12, 400)


def _standards(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.trim(F.substring(t, 1, 40)).alias("title"), t.alias("description"), F.when(F.col("lang") != "es", F.col("lang")).alias("domain"), F.when(F.col("source") != "src1", F.col("source")).alias("author"),
        F.when(F.col("doc_id") % 7 > 0, "2024-01-01").alias("created_date"), t.contains("!").alias("examples"), t.contains("@").alias("implementation_guides"), t.contains("=").alias("code_examples"), t.contains(",").alias("guidelines"),
    )


@query("""WITH s AS (SELECT doc_id, coalesce(trim(substr(text, 1, 40), ' ') <> '', false) AS t, coalesce(text <> '', false) AS de, lang <> 'es' AS dom, source <> 'src1' AS au, doc_id % 7 > 0 AS cr, contains(text, '!') AS e, contains(text, '@') AS g, contains(text, '=') AS c, contains(text, ',') AS gu, length(coalesce(text, '')) AS n FROM documents),
m AS (SELECT *, round(least(0.15e0 * (t::INTEGER + de::INTEGER + dom::INTEGER + au::INTEGER) + 0.1e0 * (e::INTEGER + g::INTEGER + c::INTEGER + gu::INTEGER), 1e0), 6) AS completeness, CASE WHEN n = 0 THEN 0e0 WHEN n < 50 THEN 0.3e0 WHEN n < 200 THEN 0.7e0 ELSE 1e0 END AS clarity, round(CASE WHEN e THEN 0.3e0 ELSE 0e0 END + CASE WHEN g THEN 0.4e0 ELSE 0e0 END + CASE WHEN c THEN 0.3e0 ELSE 0e0 END, 6) AS actionability FROM s),
x AS (SELECT doc_id, completeness, clarity, actionability, concat_ws('; ', CASE WHEN NOT t THEN 'Missing required field: title' END, CASE WHEN NOT de THEN 'Missing required field: description' END, CASE WHEN NOT dom THEN 'Missing required field: domain' END) AS errors,
concat_ws('; ', CASE WHEN NOT cr THEN 'Missing creation date' END, CASE WHEN NOT au THEN 'Missing author information' END) AS warnings, concat_ws('; ', CASE WHEN completeness < 0.8 THEN 'Add more comprehensive documentation' END, CASE WHEN actionability < 0.6 THEN 'Include more practical examples and implementation guides' END) AS suggestions FROM m)
SELECT *, errors = '' AS valid FROM x""")
def document_validation(spark, d):
    return checks.validation(_standards(spark, d), "doc_id")


_MD = "'# ' || p_name || chr(10) || '## ' || p_type || chr(10) || 'See [a](#' || replace(lower(p_name), ' ', '-') || ') and [b](#part-' || p_size % 3 || ') or [c](#' || lower(p_type) || ').'"


def _markdown(spark, d):
    return table(spark, d, "part").withColumn(
        "md", F.concat(F.lit("# "), "p_name", F.lit("\n## "), "p_type", F.lit("\nSee [a](#"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lit(") and [b](#part-"), (F.col("p_size") % 3).cast("string"), F.lit(") or [c](#"), F.lower("p_type"), F.lit(")."))
    )


@query("SELECT p_partkey, 'part-' || p_size % 3 AS anchor FROM part")
def broken_anchors(spark, d):
    """Links of a Markdown text to headings that it doesn't have."""
    return checks.broken_anchors(_markdown(spark, d), "p_partkey", "md")


@query("SELECT p_partkey, '- [' || p_name || '](#' || replace(lower(p_name), ' ', '-') || ')' || chr(10) || '- [' || p_type || '](#' || lower(p_type) || ')' AS toc FROM part")
def tables_of_contents(spark, d):
    return _markdown(spark, d).select("p_partkey", checks.table_of_contents(F.col("md")).alias("toc"))


@query("""WITH c AS (SELECT p_partkey, ['AC-' || p_partkey % 4, 'ZZ-' || p_partkey % 3] AS claimed, ['AC-' || p_partkey % 2, 'AU-' || p_partkey % 5] AS said FROM part), k AS (SELECT 'AC-' || i AS control FROM range(0, 10) t(i) UNION ALL SELECT 'AU-' || i FROM range(0, 10) t(i)),
e AS (SELECT p_partkey, unnest(claimed) AS control, 'unknown' AS warning FROM c UNION ALL SELECT p_partkey, unnest(list_filter(claimed, lambda x: NOT list_contains(said, x))), 'not referenced' FROM c UNION ALL SELECT p_partkey, unnest(list_filter(list_distinct(said), lambda x: NOT list_contains(claimed, x))), 'not in metadata' FROM c)
SELECT p_partkey, control, warning FROM e WHERE CASE warning WHEN 'unknown' THEN control NOT IN (SELECT control FROM k) WHEN 'not referenced' THEN control IN (SELECT control FROM k) ELSE true END""")
def control_mentions(spark, d):
    """Controls claimed and said, compared both ways and with a catalogue."""
    k = F.col("p_partkey")
    name = lambda family, n: F.concat(F.lit(f"{family}-"), (k % n).cast("string"))
    docs = table(spark, d, "part").select("p_partkey", F.array(name("AC", 4), name("ZZ", 3)).alias("claimed"), F.concat(F.lit("Meets NIST-"), name("AC", 2), F.lit(" and NIST "), name("AU", 5), F.lit(".")).alias("text"))
    known = spark.range(10).select(F.explode(F.array(F.concat(F.lit("AC-"), F.col("id").cast("string")), F.concat(F.lit("AU-"), F.col("id").cast("string")))).alias("control"))
    return checks.control_mentions(docs, "p_partkey", "text", "claimed", known)


@query("""SELECT p_partkey, concat_ws('; ', CASE WHEN NOT regexp_matches((p_size % 4) || '.' || (p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN '.0' ELSE '' END, '^[0-9]+\\.[0-9]+\\.[0-9]+$') THEN 'version' END, CASE WHEN p_partkey % 5 > 0 THEN NULL ELSE 'type' END, CASE WHEN p_partkey % 7 = 0 THEN 'status' END, CASE WHEN p_partkey % 11 = 0 THEN 'risk' END) AS errors FROM part""".replace("\\\\", "\\"))
def metadata_errors(spark, d):
    k = F.col("p_partkey")
    version = F.concat((F.col("p_size") % 4).cast("string"), F.lit("."), (k % 3).cast("string"), F.when(k % 2 == 0, ".0").otherwise(""))
    errors = checks.metadata_errors(version, F.when(k % 5 > 0, "security"), F.when(k % 7 > 0, "draft").otherwise("lost"), F.when(k % 11 > 0, "low"))
    return table(spark, d, "part").select("p_partkey", errors.alias("errors"))


@query("SELECT p_partkey, 'NIST-AC-' || p_partkey % 9 AS control, CASE p_size % 7 WHEN 1 THEN 'Initial' WHEN 2 THEN 'Managed' WHEN 3 THEN 'Defined' WHEN 4 THEN 'Measured' WHEN 5 THEN 'Optimised' ELSE 'Unknown' END AS level, 'v' || (p_size % 3) || '.0' AS version FROM part")
def template_fields(spark, d):
    k = F.col("p_partkey")
    control = F.concat(F.when(k % 2 == 0, "ac-").otherwise("NIST-AC-"), (k % 9).cast("string"))
    version = F.concat(F.when(k % 3 == 0, "v").otherwise(""), (F.col("p_size") % 3).cast("string"), F.lit(".0"))
    made = checks.template_fields(control, (F.col("p_size") % 7).cast("string"), version)
    return table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in made.items()])


@query(r"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(text, '[<>"''`;\\]', '', 'g'), '[\x00-\x1F\x7F]', ' ', 'g'), ' +', ' ', 'g'), ' '), 1, 1000) AS clean, regexp_replace(lower(lang || ' ' || source || '!'), '[^a-z0-9_-]', '_', 'g') AS id FROM documents""")
def sanitised_input(spark, d):
    return table(spark, d, "documents").select("doc_id", checks.sanitised(F.col("text")).alias("clean"), checks.identifier(F.concat("lang", F.lit(" "), "source", F.lit("!"))).alias("id"))


@query("""WITH q AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'SELECT * FROM a JOIN b' WHEN 1 THEN 'select now()' WHEN 2 THEN 'Insert into t' ELSE 'SELECT k FROM t' END AS s FROM events) SELECT event_id, CASE WHEN s ILIKE 'select%' THEN 'select' ELSE 'insert' END AS kind, contains(lower(s), 'join') AS complex, s ILIKE 'select%' AND NOT contains(lower(s), 'now()') AS cacheable FROM q""")
def classified_queries(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("SELECT * FROM a JOIN b", "select now()", "Insert into t", "SELECT k FROM t"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", checks.classify_sql(said).alias("c")).select("event_id", "c.*")


@query("SELECT conv_id, turn, length(text) BETWEEN 1 AND 300 AND (turn % 12) * 10 BETWEEN 1 AND 100 AND turn % 7 BETWEEN 1 AND 5 AS valid FROM conversations")
def request_bounds(spark, d):
    """Requests within bounds: query length, limit 1 to 100, depth 1 to 5."""
    ok = F.length("text").between(1, 300) & ((F.col("turn") % 12) * 10).between(1, 100) & (F.col("turn") % 7).between(1, 5)
    return table(spark, d, "conversations").select("conv_id", "turn", ok.alias("valid"))


_REV = "rv AS (SELECT s_suppkey AS reviewer, CASE s_suppkey % 3 WHEN 0 THEN 'technical' WHEN 1 THEN 'editorial' ELSE 'community' END AS role, (s_suppkey // 3) % 5 AS d1, (s_suppkey // 3 + 1) % 5 AS d2, s_suppkey % 4 AS load FROM supplier), rd AS (SELECT reviewer, role, load, d1 AS domain FROM rv WHERE load < 3 UNION ALL SELECT reviewer, role, load, d2 FROM rv WHERE load < 3)"


@query(f"""WITH {_REV}, st(stage, role, most, days) AS (VALUES ('technical', 'technical', 2, 5), ('editorial', 'editorial', 1, 8), ('community', 'community', 3, 10)),
c AS (SELECT o_orderkey, stage, reviewer, row_number() OVER (PARTITION BY o_orderkey, stage ORDER BY load, reviewer)::INTEGER AS place, o_orderdate::DATE + days AS due, most FROM orders JOIN rd ON domain = o_custkey % 5 JOIN st USING (role) WHERE o_orderstatus = 'P')
SELECT o_orderkey, stage, reviewer, place, due FROM c WHERE place <= most""")
def assign_reviewers(spark, d):
    k = F.col("s_suppkey")
    role = F.when(k % 3 == 0, "technical").when(k % 3 == 1, "editorial").otherwise("community")
    group = (k / 3).cast("long")
    reviewers = table(spark, d, "supplier").select(k.alias("reviewer"), role.alias("role"), F.array(group % 5, (group + 1) % 5).alias("domains"), (k % 4).alias("load"), F.lit(3).alias("capacity"))
    docs = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_custkey") % 5).alias("domain"), F.to_date("o_orderdate").alias("start"))
    return checks.assign_reviewers(docs, reviewers, "o_orderkey", "start")


@query("""WITH a AS (SELECT DISTINCT user_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view'), c AS (SELECT user_id, json_extract_string(props, '$.k') AS k, min(ts) AS completed_at FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, k, completed_at, CASE WHEN completed_at IS NULL THEN 'pending' ELSE 'completed' END AS status FROM a LEFT JOIN c USING (user_id, k)""")
def completed_reviews(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return checks.completed(rows.where("event_type = 'view'").select("user_id", "k").distinct(), rows.where("event_type = 'purchase'"), ["user_id", "k"])
