"""Hybrid search, query correction, embeddings, index upkeep and applicability, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsense.functions import stems
from docsense.operators import retrieval, search
from docsense.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


ASKED = ["stupid", "worthless", "license", "token"]
_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _kw_sql(words: list[str], fields: list[str]) -> str:
    parts = []
    for w in words:
        parts.append(f"CASE WHEN list_contains(w, '{w}') THEN 1e0 WHEN contains(lt, '{w}') THEN 0.5e0 ELSE 0e0 END")
        parts.append(f"CASE WHEN {' OR '.join(f'''contains(lower({f}), '{w}')''' for f in fields)} THEN 0.5e0 ELSE 0e0 END")
    k = len(words)
    listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    parts.append(f"CASE WHEN list_has_all(sw, {listed}) AND len(list_filter(range(1, greatest(len(sw) - {k} + 1, 0) + 1), lambda i: list_has_all(sw[i:i + 19], {listed}))) > 0 THEN 0.5e0 ELSE 0e0 END")
    return f"least(({' + '.join(parts)}) / {k}, 1e0)"


_D = rf"d AS (SELECT doc_id, text, lower(text) AS lt, {_TOKENS} AS w, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS sw, lang, source FROM documents)"


@query(f"WITH {_D} SELECT doc_id, round({_kw_sql(ASKED, ['lang', 'source'])}, 6) AS score FROM d")
def keyword_score_full(spark, d):
    """Token, substring, metadata and proximity hits of every document."""
    return table(spark, d, "documents").select("doc_id", F.round(retrieval.keyword_score(ASKED, F.col("text"), [F.col("lang"), F.col("source")]), 6).alias("score"))


_KW = _kw_sql(ASKED, ["lang", "source"])
_HYBRID = f"""{_D}, qv AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
s AS (SELECT doc_id, lang, text, {_KW} AS kw, contains(lt, 'stupid') OR contains(lower(lang), 'stupid') OR contains(lower(source), 'stupid') AS crit, round(coalesce(list_cosine_similarity(embedding, qe), 0), 6)::DOUBLE AS sem FROM d LEFT JOIN embeddings ON vec_id = doc_id CROSS JOIN qv),
b AS (SELECT doc_id, lang, text, round(CASE WHEN kw = 0 THEN 0.3e0 * sem WHEN kw < 0.2 THEN 0.5e0 * sem ELSE CASE WHEN kw > 0.5 THEN 0.5e0 * sem + 0.5e0 * kw ELSE 0.6e0 * sem + 0.4e0 * kw END END * CASE WHEN crit THEN 1e0 ELSE 0.5e0 END, 6) AS score FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 40), t AS (SELECT * FROM r WHERE score > 0.05 AND rank <= 20),
f AS (SELECT *, lag(score) OVER (ORDER BY rank) AS before FROM t), c AS (SELECT *, max(coalesce(rank > 3 AND (before - score) / before > 0.5 AND score < 0.3, false)::INTEGER) OVER (ORDER BY rank) AS cut FROM f)"""


@query(f"WITH {_HYBRID} SELECT doc_id, lang, score, rank, length(text) AS n_chars FROM c WHERE cut = 0 AND score >= 0.1")
def search_hybrid(spark, d):
    """The whole search path: semantic and keyword blend, critical-term gate, top k, score cut, enrichment, least relevance.

    Semantic scores are the cosine of the document's embedding (the vector of its number) and the query's.
    """
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = vectors.where("vec_id = 0").select(F.col("e").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("e", "q") / F.sqrt(dot("e", "e") * dot("q", "q"))
    near = vectors.crossJoin(F.broadcast(asked)).select(F.col("vec_id").alias("doc_id"), F.round(cosine, 6).alias("sem"))
    scored = docs.join(near, "doc_id", "left").select(
        "doc_id", F.lit("q").alias("query"), F.round(retrieval.combined_score(ASKED, F.coalesce("sem", F.lit(0.0)), F.col("text"), [F.col("lang"), F.col("source")]), 6).alias("score")
    )
    hits = retrieval.score_cut(search.top_k(scored, "query", "doc_id", 20), "query", len(ASKED))
    return hits.join(docs.select("doc_id", "lang", F.length("text").alias("n_chars")), "doc_id").where("score >= 0.1").select("doc_id", "lang", "score", "rank", "n_chars")


@query("""WITH s AS (SELECT conv_id, turn, 1.0 / (turn + 1) AS base FROM conversations), x AS (SELECT conv_id, turn::BIGINT AS turn, round(pow(base, 1 + conv_id % 3)::DOUBLE, 6) AS score FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn)::INTEGER AS rank FROM x),
f AS (SELECT *, lag(score) OVER (PARTITION BY conv_id ORDER BY rank) AS before FROM r), c AS (SELECT *, max(coalesce(rank > 3 AND CASE WHEN before > 0 THEN (before - score) / before ELSE 1 END > 0.5 AND score < 0.3, false)::INTEGER) OVER (PARTITION BY conv_id ORDER BY rank) AS cut FROM f) SELECT conv_id, turn, score, rank FROM c WHERE cut = 0""")
def score_drop_cut(spark, d):
    """Ranked lists, one a conversation, cut at a steep fall of the score."""
    turns = table(spark, d, "conversations")
    score = F.round(F.pow(1 / (F.col("turn") + 1), (1 + F.col("conv_id") % 3).cast("double")), 6)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), score.alias("score"))
    from pyspark.sql import Window

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")))
    return retrieval.score_cut(ranked, "conv_id", 4)


@query("SELECT doc_id, round(coalesce(exp(-CASE WHEN doc_id % 10 > 0 THEN doc_id % 400 END / 30e0), 0.5e0), 6) AS recency FROM documents")
def recency_score(spark, d):
    days = F.when(F.col("doc_id") % 10 > 0, F.col("doc_id") % 400)
    return table(spark, d, "documents").select("doc_id", F.round(retrieval.recency(days), 6).alias("recency"))


@query()
def word_stems(spark, d):
    """The stems of all documents' words, with how many words and documents each has."""
    held = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("token"))
    words = held.groupBy("token").agg(F.count(F.lit(1)).alias("documents"))
    return words.groupBy(stems.stemmed(F.col("token")).alias("stem")).agg(F.count(F.lit(1)).alias("words"), F.sum("documents").alias("uses"))


@query()
def query_correction(spark, d):
    """Words of search texts against the vocabulary of all documents."""
    words = table(spark, d, "benchmark").select(F.explode(search.tokens(F.col("text"))).alias("word")).distinct()
    vocabulary = table(spark, d, "documents").select(F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("token")).distinct()
    return retrieval.corrected(words, vocabulary)


_SYN = "(VALUES " + ", ".join(f"('{h}', '{w}')" for h, ws in retrieval.SYNONYMS.items() for w in ws) + ") v(head, word)"


@query(f"WITH p AS (SELECT head, word FROM {_SYN} UNION ALL SELECT word, head FROM {_SYN}), e AS (SELECT DISTINCT doc_id, p.word AS synonym FROM documents JOIN p ON list_contains({_TOKENS}, p.head)) SELECT doc_id, count(*) AS n, string_agg(synonym, ',' ORDER BY synonym) AS synonyms FROM e GROUP BY 1")
def synonym_expansion(spark, d):
    """The synonyms of every document's words, both ways, in alphabetical order."""
    pairs = [(h, w) for h, ws in retrieval.SYNONYMS.items() for w in ws]
    both = F.array(*[F.struct(F.lit(a).alias("head"), F.lit(b).alias("synonym")) for h, w in pairs for a, b in ((h, w), (w, h))])
    words = spark.range(1).select(F.inline(both))
    held = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("head"))
    found = held.join(words, "head").select("doc_id", "synonym").distinct()
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("synonym")), ",").alias("synonyms"))


@query()
def text_embeddings(spark, d):
    """Deterministic vectors of all texts, each distinct text encoded once."""
    return retrieval.embed(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", retrieval.serialised(F.col("embedding")).alias("embedding"))


@query("SELECT vec_id, len(embedding) AS size, true AS same FROM embeddings")
def embedding_round_trip(spark, d):
    """Vectors written as text and read back."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("e"))
    back = retrieval.deserialised(retrieval.serialised(F.col("e")))
    return rows.select("vec_id", F.size(back).cast("long").alias("size"), (back == F.col("e")).alias("same"))


@query("SELECT doc_id, sha256('filters=' || lang || ':limit=' || 10 || ':query=' || source) AS key FROM documents")
def call_cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.cache_key({"query": F.col("source"), "filters": F.col("lang"), "limit": F.lit(10)}).alias("key"))


@query("SELECT doc_id, 'Title: ' || substr(text, 1, 20) || chr(10) || 'Category: ' || lang || chr(10) || 'Tags: ' || lang || ', ' || source AS content FROM documents")
def searchable_content(spark, d):
    """Labelled text that a standard is indexed under."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    content = F.concat_ws("\n", line("Title", F.substring("text", 1, 20)), line("Category", F.col("lang")), line("Tags", F.array_join(F.array("lang", "source"), ", ")))
    return table(spark, d, "documents").select("doc_id", content.alias("content"))


@query("""WITH i AS (SELECT doc_id, 0 AS version, n_chars FROM documents UNION ALL SELECT doc_id + 5, 1, n_chars * 2 FROM documents WHERE lang = 'fr'), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS place FROM i)
SELECT doc_id, version::INTEGER AS version, n_chars FROM k WHERE place = 1""")
def index_upsert(spark, d):
    """An index after a batch with new and known keys."""
    docs = table(spark, d, "documents")
    index = docs.select("doc_id", F.lit(0).alias("version"), "n_chars")
    batch = docs.where("lang = 'fr'").select((F.col("doc_id") + 5).alias("doc_id"), F.lit(1).alias("version"), (F.col("n_chars") * 2).alias("n_chars"))
    return retrieval.upserted(index, batch, "doc_id", "version")


_P = "p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS language, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS framework, CASE WHEN p_partkey % 5 > 0 THEN (p_size % 4) || '.' || (p_partkey % 10) || '.0' END AS version FROM part)"


@query(f"WITH {_P} SELECT p_partkey FROM p WHERE coalesce(language = 'PROMO', true) AND coalesce(framework = 'Brand#12', true) AND (version IS NULL OR (split_part(version, '.', 1)::INTEGER, split_part(version, '.', 2)::INTEGER) >= (1, 5))")
def applicable_standards(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.element_at(F.split("p_type", " "), 1).alias("language"),
        F.when(k % 4 > 0, F.col("p_brand")).alias("framework"),
        F.when(k % 5 > 0, F.concat((F.col("p_size") % 4).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(".0"))).alias("version"),
    )
    return rows.where(retrieval.applicable(F.col("language"), F.col("framework"), F.col("version"), F.lit("PROMO"), F.lit("Brand#12"), (1, 5, 0))).select("p_partkey")


@query("""WITH c AS (SELECT c_custkey, lower(n_name || ' ' || c_mktsegment) AS q FROM customer JOIN nation ON n_nationkey = c_nationkey), w AS (SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT DISTINCT p_name, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS t FROM part), t AS (SELECT p_name, t, count(*) AS n FROM p GROUP BY ALL)
SELECT n_name, c_mktsegment, lower(n_name || ' ' || c_mktsegment) AS query, len(regexp_extract_all(lower(n_name || ' ' || c_mktsegment), '[\\p{L}\\p{N}_]+')) AS words FROM w""")
def context_queries(spark, d):
    """Search texts made from contexts (nation and segment), with their number of words."""
    customers = table(spark, d, "customer").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = customers.select("n_name", "c_mktsegment").distinct().withColumn("query", F.lower(F.concat_ws(" ", "n_name", "c_mktsegment")))
    return asked.withColumn("words", F.size(search.tokens(F.col("query"))).cast("long"))
