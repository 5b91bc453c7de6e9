"""Quality rubrics, section formats, file rules, file filters and reviews over the driver's tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsense.functions import markup
from docsense.operators import reviews, rubrics, scan, sections, versions
from docsense.sources import readers
from docsense.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rewrite(text: str, steps) -> str:
    for pattern, replacement in steps:
        for i in "123":
            replacement = replacement.replace(f"${i}", f"\\{i}")
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(replacement)}, 'g')"
    return text


def _n(pattern: str) -> str:
    return f"len(regexp_extract_all(t, {_q(pattern)}))"


def _words(*words: str) -> str:
    return "(" + " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words) + ")"


def _held(of: str, words) -> str:
    return "(" + " + ".join(f"contains({of}, {_q(w)})::INTEGER" for w in words) + f") / {len(words)}e0"


def pages(spark, d):
    """Web pages as Markdown documents."""
    p = table(spark, d, "pages").select("page_id", "url", "html", markup.to_markdown(F.col("html")).alias("t"))
    return p.withColumn("low", F.lower("t"))


_PAGES = f"p AS (SELECT page_id, url, html, t, lower(t) AS low FROM (SELECT *, {_rewrite('html', markup.MARKDOWN_STEPS)} AS t FROM pages))"

CONTROLS, FRAMEWORKS = ("The", "Ing", "Policy", "Terms"), ("GDPR", "SOC2", "Of")


@query(f"WITH {_PAGES} SELECT page_id, sha256(t) AS markdown_sha256 FROM p")
def html_to_markdown(spark, d):
    return pages(spark, d).select("page_id", F.sha2(F.col("t").cast("binary"), 256).alias("markdown_sha256"))


def _rubric(spark, d):
    t, low, url = F.col("t"), F.col("low"), F.col("url")
    return rubrics.overall(
        pages(spark, d).select(
            "page_id",
            F.round(rubrics.completeness(t, low, [t.contains("# "), url.contains("example"), url.contains("?"), url.contains("#"), url.startswith("https")]), 6).alias("completeness"),
            F.round(rubrics.consistency(t), 6).alias("consistency"),
            rubrics.clarity(t, low).cast("long").alias("clarity"),
            F.round(rubrics.compliance(t, low, CONTROLS, FRAMEWORKS), 6).alias("compliance"),
            rubrics.guidance(t, low, url.contains("example.com")).cast("long").alias("guidance"),
            rubrics.maintainability(low, url.contains("?"), url.contains("example"), t.contains("]("), F.col("page_id") % 2 == 0).cast("long").alias("maintainability"),
        )
    )


_LV = "list_transform(regexp_extract_all(t, '(?m)^(#+)[ \\t]+[^ \\t\\n]', 1), lambda x: length(x))"
_TERMS = r"list_concat(list_filter(regexp_extract_all(t, '[\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^([A-Z][a-z]+|[A-Z]{2,})$')), regexp_extract_all(t, '`([^`]+)`', 1))"
_SUM = " + ".join(f"{w}e0 * {k}" for k, w in rubrics.WEIGHTS.items())
_NEAR = "CASE WHEN {0} BETWEEN {1} AND {2} THEN 25 WHEN {0} BETWEEN {3} AND {4} THEN 20 WHEN {0} IS NOT NULL THEN 10 ELSE 0 END"
_RUBRIC = f"""{_PAGES}, a AS (SELECT *, {_LV} AS lv, {_TERMS} AS terms, regexp_extract_all(t, '```([A-Za-z0-9_]*)', 1) AS fences,
 {_n('[^ \\t\\r\\n.!?]+')}::DOUBLE / nullif({_n('[^ \\t\\r\\n.!?][^.!?]*')}, 0) AS sentence,
 {_n('[^ \\t\\r\\n]+')}::DOUBLE / nullif(len(list_filter(string_split(t, chr(10) || chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r\\n]'))), 0) AS para,
 {_words(*rubrics.ACTIVE)} AS act, {_words(*rubrics.PASSIVE)} AS pas FROM p),
b AS (SELECT *, list_transform(range(1, len(lv)), lambda i: abs(lv[i + 1] - lv[i])) AS jumps, coalesce(list_aggregate(terms, 'histogram'), MAP {{}}) AS h FROM a),
s AS (SELECT page_id, round(30 * {_held('low', rubrics.SECTIONS)} + CASE WHEN length(t) > 2000 THEN 20 WHEN length(t) > 1000 THEN 10 ELSE 0 END + 20 * (contains(t, '# ')::INTEGER + contains(url, 'example')::INTEGER + contains(url, '?')::INTEGER + contains(url, '#')::INTEGER + starts_with(url, 'https')::INTEGER) / 5e0 + 15 * contains(t, '```')::INTEGER + 15 * (contains(t, '![') OR contains(t, '```mermaid'))::INTEGER, 6) AS completeness,
 round(25 * coalesce(len(list_filter(jumps, lambda x: x <= 1))::DOUBLE / nullif(len(jumps), 0), 0) + 25 * coalesce(least(len(list_filter(map_values(h), lambda x: x > 1)), 10)::DOUBLE / nullif(least(cardinality(h), 10), 0), 0) + 25 * coalesce(1 - len(list_distinct(fences))::DOUBLE / nullif(len(fences), 0), 0) + 25 * regexp_matches(t, '\\[[^\\[\\]]+\\]\\([^()]+\\)')::INTEGER, 6) AS consistency,
 ({_NEAR.format('sentence', 15, 20, 10, 25)} + {_NEAR.format('para', 50, 150, 30, 200)} + CASE WHEN act > pas THEN 25 WHEN act > 0 THEN 15 ELSE 0 END + CASE WHEN {_words(*rubrics.CONNECTIVES)} > 0 THEN 25 ELSE 0 END)::BIGINT AS clarity,
 round(40 * {_held('t', CONTROLS)} + 30 * {_held('t', FRAMEWORKS)} + CASE WHEN {_words(*rubrics.RISK)} > 5 THEN 30 WHEN {_words(*rubrics.RISK)} > 0 THEN 20 ELSE 0 END, 6) AS compliance,
 (least(10 * {_n('```[^`]+```')}, 30) + least(2 * {_n('(?m)^[0-9]+\\.')}, 20) + CASE WHEN {_words(*rubrics.SETUP)} > 3 THEN 20 WHEN {_words(*rubrics.SETUP)} > 0 THEN 10 ELSE 0 END + CASE WHEN NOT contains(url, 'example.com') THEN 0 WHEN {_words(*rubrics.TECHNOLOGY)} > 5 THEN 30 WHEN {_words(*rubrics.TECHNOLOGY)} > 0 THEN 20 ELSE 0 END)::BIGINT AS guidance,
 (25 * contains(url, '?')::INTEGER + 20 * contains(url, 'example')::INTEGER + 20 * (contains(low, 'changelog') OR contains(low, 'history'))::INTEGER + 15 * contains(t, '](')::INTEGER + 20 * (page_id % 2 = 0)::INTEGER)::BIGINT AS maintainability FROM b)"""


@query(f"WITH {_RUBRIC} SELECT *, round({_SUM}, 2) AS overall FROM s")
def qa_rubric(spark, d):
    """Six sub-scores and the weighted mean of every page, in one pass without a shuffle."""
    return _rubric(spark, d)


@query(f"WITH {_RUBRIC}, e AS (UNPIVOT (SELECT page_id, " + ", ".join(f"{k}::DOUBLE AS {k}" for k in rubrics.WEIGHTS) + " FROM s) ON " + ", ".join(rubrics.WEIGHTS) + " INTO NAME metric VALUE score) SELECT page_id, metric, score, round(60e0 - score, 6) AS missing FROM e WHERE score < 60")
def qa_recommendations(spark, d):
    return rubrics.recommendations(_rubric(spark, d), "page_id")


REQUIRED = ("# ", "## ", "### ", "- ", "![")


@query(f"WITH {_PAGES}, a AS (SELECT page_id, t, {_LV} AS lv FROM p) SELECT page_id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT contains(t, '{x}') THEN '{x}' END" for x in REQUIRED) + f") AS missing, coalesce(lv[1] <> 1, false) AS starts_lower, len(list_filter(range(1, len(lv)), lambda i: lv[i + 1] > lv[i] + 1)) AS skips, {_n('```')} % 2 = 1 AS open_fence FROM a")
def heading_structure(spark, d):
    checks = rubrics.heading_structure(F.col("t"), REQUIRED)
    return pages(spark, d).select("page_id", *[c.alias(k) for k, c in checks.items()])


@query(f"WITH {_PAGES}, a AS (SELECT page_id, {_TERMS} AS x FROM p) SELECT page_id, len(x) AS n, len(list_distinct(x)) AS distinct_terms FROM a")
def technical_terms(spark, d):
    terms = markup.technical_terms(F.col("t"))
    return pages(spark, d).select("page_id", F.size(terms).cast("long").alias("n"), F.size(F.array_distinct(terms)).cast("long").alias("distinct_terms"))


@query("SELECT p_partkey, length(p_name) > 0 AND length(p_type) > 0 AND length(p_brand) > 0 AS valid, round(0.15e0 * 4 + 0.1e0 * ((p_size > 10)::INTEGER + (p_size > 20)::INTEGER + (p_size > 30)::INTEGER + (p_size > 40)::INTEGER), 6) AS completeness, CASE WHEN length(p_name || p_type) < 50 THEN 0.3e0 WHEN length(p_name || p_type) < 200 THEN 0.7e0 ELSE 1e0 END AS clarity, round(0.3e0 * (p_size > 10)::INTEGER + 0.4e0 * (p_size > 20)::INTEGER + 0.3e0 * (p_size > 30)::INTEGER, 6) AS actionability FROM part")
def record_validation(spark, d):
    checks = rubrics.record_validation(F.col("p_name"), F.concat("p_name", "p_type"), F.col("p_brand"), F.col("p_type"), [F.col("p_size") > x for x in (10, 20, 30, 40)])
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in checks.items()])


_KIND = "CASE " + " ".join(f"WHEN starts_with(lower(title), '{k}') THEN '{k}'" for k in sections.KINDS) + " ELSE 'other' END"
_RANK = "CASE kind " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in sections.KINDS.items()) + f" ELSE {sections.OTHER} END"
_SECTIONS = f"""{_PAGES}, x AS (SELECT page_id, unnest(string_split(regexp_replace(t, '(?m)^(#{{1,3}}[ \\t]*[^ \\t\\n#])', chr(1) || '\\1', 'g'), chr(1))) AS body FROM p),
y AS (SELECT page_id, trim(regexp_extract(body, '^#{{1,3}}[ \\t]*([^\\n]*)', 1)) AS title, body FROM x), z AS (SELECT *, {_KIND} AS kind FROM y), sec AS (SELECT page_id, title, kind, {_RANK} AS priority, body FROM z WHERE regexp_matches(body, '[^ \\t\\r\\n]') AND (kind <> 'other' OR length(body) >= 50))"""


def _sections(spark, d):
    return pages(spark, d).select("page_id", sections.parse(F.col("t")).alias("sections"))


@query(f"WITH {_SECTIONS} SELECT page_id, title, kind, priority, length(body) AS n FROM sec")
def markdown_sections(spark, d):
    return _sections(spark, d).select("page_id", F.inline("sections")).select("page_id", "title", "kind", "priority", F.length("body").cast("long").alias("n"))


def _pattern_sections(rows: str, key: str, patterns) -> str:
    """The same in SQL over ``rows`` (key and t): each block goes to the first pattern that matches in it."""
    head = lambda name: f"'(?is)^(.*?)#{{1,3}}\\s*{name}'"
    hit = lambda name: f"regexp_matches(block, '(?i)#{{1,3}}\\s*{name}')"
    order = "CASE " + " ".join(f"WHEN {hit(name)} THEN {n}" for n, (_, name, _) in enumerate(patterns)) + " END"
    before = "CASE o " + " ".join(f"WHEN {n} THEN regexp_extract(block, {head(name)}, 1)" for n, (_, name, _) in enumerate(patterns)) + " END"
    ids, ranks = (" ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(x)) for x in ([f"'{k}'" for k, _, _ in patterns], [r for _, _, r in patterns]))
    return f"""s AS ({rows}), b AS (SELECT {key}, unnest(bs) AS block, generate_subscripts(bs, 1) AS i FROM (SELECT {key}, string_split(replace(t, chr(10) || '#', chr(1) || '#'), chr(1)) AS bs FROM s WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '')),
o AS (SELECT *, {order} AS o FROM b), c AS (SELECT *, {before} AS pre FROM o),
g AS (SELECT {key}, string_agg(CASE WHEN o IS NULL THEN block ELSE pre || chr(2) END, chr(10) ORDER BY i) AS left_over, count(o) AS claimed, string_agg(block, chr(10) ORDER BY i) AS whole FROM c GROUP BY 1),
r AS (SELECT {key}, list_filter(list_transform(string_split(left_over, chr(2)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 50) AS gaps FROM g WHERE claimed > 0)
SELECT {key}, CASE o {ids} END AS id, CASE o {ranks} END AS priority, sha256(substr(block, length(pre) + 1)) AS content_sha256 FROM c WHERE o IS NOT NULL
UNION ALL SELECT {key}, 'other', 4, sha256(array_to_string(gaps, chr(10) || chr(10))) FROM r WHERE len(gaps) > 0
UNION ALL SELECT {key}, 'content', 5, sha256(whole) FROM g WHERE claimed = 0"""


def _claimed(rows, key: str, text: str, patterns):
    found = rows.select(key, F.inline(sections.parse_patterns(F.col(text), patterns)))
    return found.select(key, "id", "priority", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


@query(f"WITH {_PAGES}, " + _pattern_sections("SELECT page_id, t FROM p", "page_id", sections.PATTERNS))
def pattern_sections(spark, d):
    """Sections of every page by the nine patterns."""
    return _claimed(pages(spark, d), "page_id", "t", sections.PATTERNS)


#: Roles as section names of a conversation told in Markdown; what users say is left to the gaps.
ROLES = (("reply", "Assistant", 9), ("frame", "System", 7), ("reply_again", "Assist", 3))
_TOLD = "SELECT conv_id, string_agg('# ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY 1"


@query("WITH " + _pattern_sections(_TOLD, "conv_id", ROLES))
def role_sections(spark, d):
    """Conversations told in Markdown, cut by the roles that speak."""
    piece = F.concat(F.lit("# "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    told = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", piece.alias("p")))), lambda x: x["p"]), "\n").alias("t"))
    return _claimed(told, "conv_id", "t", ROLES)


@query()
def reference_format(spark, d):
    """Titles and first bullets of the sections of every page within 200 tokens."""
    return _sections(spark, d).select("page_id", sections.reference_format(F.col("sections"), 200).alias("text"))


@query()
def summary_format(spark, d):
    return _sections(spark, d).select("page_id", sections.summary_format(F.col("sections"), 100).alias("text"))


@query()
def condensed_format(spark, d):
    return sections.condensed_format(_sections(spark, d), "page_id", "sections", 300)


_FILES = " UNION ALL ".join(f"SELECT page_id, '{i}' AS rule_id, '{f}' AS family, '{s}' AS severity, '{c}' AS cwe FROM pages WHERE regexp_matches(html, {_q(p)}) AND NOT regexp_matches(html, {_q(a)})" for i, _, f, p, a, s, c in scan.FILE_RULES)


@query(_FILES)
def file_rule_scan(spark, d):
    return scan.file_findings(table(spark, d, "pages"), "page_id", "html")


_SPLIT = "l AS (SELECT page_id, i::INTEGER AS line, x[i] AS code FROM (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)) AS x FROM pages), unnest(range(1, len(x) + 1)) t(i))"


def _tags(spark, d):
    """Pages with each tag at the start of a line."""
    return table(spark, d, "pages").select("page_id", F.replace("html", F.lit("><"), F.lit(">\n<")).alias("html"))


_NEARBY = _SPLIT.replace("i::INTEGER AS line, x[i] AS code", "x, i") + " " + " UNION ALL ".join(
    f"SELECT page_id, i::INTEGER AS line, '{r}' AS rule_id, '{s}' AS severity FROM l WHERE regexp_matches(x[i], {_q(p)}) AND len(list_filter(range(greatest(i + {a}, 1), least(i + {b}, len(x)) + 1), lambda j: regexp_matches(x[j], {_q(w)}))) = 0" for r, _, p, w, a, b, s in scan.NEAR_RULES
)


@query(f"WITH {_NEARBY}")
def near_rule_scan(spark, d):
    return scan.near_findings(_tags(spark, d), "page_id", "html")


_REGION = f"{_SPLIT}, m AS (SELECT *, regexp_matches(code, {_q(scan.ARTICLE_HEAD)}) AS h, regexp_matches(code, {_q(scan.ARTICLE_END)}) AS e FROM l), o AS (SELECT *, max(CASE WHEN h THEN line END) OVER w AS opened, max(CASE WHEN e AND NOT h THEN line END) OVER w AS closed FROM m WINDOW w AS (PARTITION BY page_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), inside AS (SELECT page_id, line, code FROM o WHERE opened > coalesce(closed, 0) AND NOT e)"


@query(f"WITH {_REGION} " + " UNION ALL ".join(f"SELECT page_id, line, '{i}' AS rule_id, '{s}' AS severity FROM inside WHERE regexp_matches(code, {_q(p)})" for i, _, p, s in scan.ARTICLE_RULES))
def region_rule_scan(spark, d):
    """Elements of every page that don't belong in its article."""
    return scan.region_findings(_tags(spark, d), "page_id", "html", scan.ARTICLE_RULES, scan.ARTICLE_HEAD, scan.ARTICLE_END)


@query("SELECT page_id, " + ", ".join(f"1 + len(regexp_extract_all(html, {_q(p)})) AS {k}" for k, p in scan.BRANCHES.items()) + " FROM pages")
def file_complexity(spark, d):
    return table(spark, d, "pages").select("page_id", *[scan.complexity(F.col("html"), k).alias(k) for k in scan.BRANCHES])


@query(f"SELECT name, count(*) AS files FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, {_q(scan.IMPORTS['html'])}, 1))) AS name FROM pages) GROUP BY 1")
def file_dependencies(spark, d):
    """How many files import each name."""
    return table(spark, d, "pages").select(F.explode(scan.dependencies(F.col("html"), "html")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("files"))


_PATH = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"SELECT page_id, NOT regexp_matches(path, '[\\x00-\\x1f\\\\]') AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '^[A-Za-z]:') AND len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.') OR x = '')) = 0 AND regexp_matches(path, '^.*/en/[^/]*$') AND NOT regexp_matches(path, '^.*=.*$') AND length(html) <= 20000 AS admitted FROM (SELECT *, {_PATH} AS path FROM pages)")
def admitted_files(spark, d):
    """The file filter of a sync over page addresses as paths."""
    p = table(spark, d, "pages").withColumn("path", F.regexp_replace("url", "^[a-z]+://", ""))
    return p.select("page_id", readers.admitted(F.col("path"), F.length("html"), ["**/en/*"], ["**=**"], 20000).alias("admitted"))


@query(f"SELECT page_id, {_rewrite(_q('cannot read ') + ' || url || ' + _q(' password=abc at /srv/data/x.json'), markup.MESSAGE_STEPS)} AS message FROM pages")
def redacted_messages(spark, d):
    message = F.concat(F.lit("cannot read "), "url", F.lit(" password=abc at /srv/data/x.json"))
    return table(spark, d, "pages").select("page_id", markup.redact_message(message).alias("message"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS shown FROM documents")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", markup.preview(F.col("text")).alias("shown"))


_ASSIGN = "a AS (SELECT l_suppkey AS reviewer, l_partkey AS doc, CASE WHEN st = 'completed' THEN st WHEN due < DATE '1998-06-01' THEN 'overdue' ELSE st END AS status FROM (SELECT *, CASE l_linestatus WHEN 'F' THEN 'completed' ELSE 'assigned' END AS st, l_shipdate::DATE + CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 8 ELSE 10 END AS due FROM lineitem))"


def _assignments(spark, d):
    """Line items as review assignments: supplier, part, stage and status."""
    stage = F.when(F.col("l_returnflag") == "A", "technical").when(F.col("l_returnflag") == "N", "editorial").otherwise("community")
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("reviewer"), F.col("l_partkey").alias("doc"), stage.alias("stage"), F.col("l_shipdate").cast("date").alias("assigned"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("assigned").alias("open"))
    dated = reviews.due_dates(a, "stage", "assigned")
    return dated.select("reviewer", "doc", "stage", "due", reviews.overdue(F.col("open"), F.col("due"), F.lit("1998-06-01").cast("date")).alias("status"))


@query(f"WITH {_ASSIGN} SELECT s_suppkey AS reviewer, count(doc) AS assigned, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'overdue') AS overdue FROM supplier LEFT JOIN a ON s_suppkey = reviewer GROUP BY 1")
def review_workload(spark, d):
    return reviews.workload(table(spark, d, "supplier").select(F.col("s_suppkey").alias("reviewer")), _assignments(spark, d), "reviewer")


@query(f"WITH {_ASSIGN} SELECT doc, count(*) AS reviews, count(*) FILTER (status = 'completed') AS completed, round(100e0 * count(*) FILTER (status = 'completed') / count(*), 6) AS percent FROM a GROUP BY 1")
def review_progress(spark, d):
    return reviews.progress(_assignments(spark, d), "doc")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 1 AND s_acctbal < 5000 AND s_nationkey IN (1, 4, 7)")
def reviewers_available(spark, d):
    role = F.when(F.col("s_suppkey") % 3 == 1, "domain_expert").otherwise("community")
    r = table(spark, d, "supplier").select("s_suppkey", role.alias("role"), F.array("s_nationkey").alias("domains"), F.col("s_acctbal").alias("load"), F.lit(5000.0).alias("capacity"))
    return reviews.available(r, ["domain_expert", "maintainer"], [1, 4, 7]).select("s_suppkey")


@query("SELECT user_id, CASE WHEN max(value) > 90 THEN 'unhealthy' WHEN max(value) > 70 THEN 'degraded' ELSE 'healthy' END AS status, round(max(value), 6) AS peak FROM events GROUP BY 1")
def health_grades(spark, d):
    """Resource health by strict bounds on the peak."""
    peak = F.max("value")
    return table(spark, d, "events").groupBy("user_id").agg(F.when(peak > 90, "unhealthy").when(peak > 70, "degraded").otherwise("healthy").alias("status"), F.round(peak, 6).alias("peak"))


_HALF = "h AS (SELECT event_type, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS before, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS after FROM events GROUP BY 1), c AS (SELECT event_type, 100 * (after - before) / nullif(before, 0) AS change FROM h)"


@query(f"WITH {_HALF} SELECT event_type, round(change, 6) AS change, CASE WHEN change > 20 THEN 'critical' WHEN change > 10 THEN 'warning' ELSE 'ok' END AS level, CASE WHEN abs(change) < 5 THEN 'unchanged' WHEN change > 10 THEN 'regression' WHEN change < -10 THEN 'improvement' ELSE 'unchanged' END AS class FROM c")
def regression_levels(spark, d):
    """Change of the mean between two halves of the window, by level and class; both halves come from one scan."""
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    h = table(spark, d, "events").groupBy("event_type").agg(F.avg(F.when(~late, F.col("value"))).alias("before"), F.avg(F.when(late, F.col("value"))).alias("after"))
    c = h.select("event_type", F.try_divide(100 * (F.col("after") - F.col("before")), "before").alias("change"))
    x = F.col("change")
    return c.select("event_type", F.round(x, 6).alias("change"), F.when(x > 20, "critical").when(x > 10, "warning").otherwise("ok").alias("level"), F.when(F.abs(x) < 5, "unchanged").when(x > 10, "regression").when(x < -10, "improvement").otherwise("unchanged").alias("class"))


@query("WITH v AS (SELECT p_brand, p_size % 5 AS major, p_size % 7 AS minor, p_size AS patch FROM part) SELECT p_brand, arg_max(major || '.' || minor || '.' || patch, major * 10000 + minor * 100 + patch) AS latest, count(*) AS versions FROM v GROUP BY 1")
def latest_versions(spark, d):
    """The newest version of each brand in the order of numbers, not of text."""
    s = F.col("p_size")
    v = table(spark, d, "part").select("p_brand", F.concat_ws(".", (s % 5).cast("string"), (s % 7).cast("string"), s.cast("string")).alias("v"))
    return v.groupBy("p_brand").agg(F.max_by("v", versions.parts(F.col("v"))).alias("latest"), F.count(F.lit(1)).alias("versions"))
