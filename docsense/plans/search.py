"""Search, vector and token-budget queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docsense.operators import overlap, search, tokens, vectors
from docsense.operators.staging import staged
from docsense.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WORDS = ["stupid", "worthless", "license"]
_TOK = r"t AS (SELECT doc_id, text, lower(text) AS lt, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w, lang, source FROM documents)"
_KW = "least((" + " + ".join(f"CASE WHEN list_contains(w, '{x}') THEN 1e0 WHEN contains(lt, '{x}') THEN 0.5e0 ELSE 0e0 END" for x in WORDS) + f") / {len(WORDS)}, 1e0)"


@query(f"WITH {_TOK}, e AS (SELECT unnest(w) AS token, doc_id FROM t) SELECT token, count(*) AS n, count(DISTINCT doc_id) AS documents FROM e GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20")
def doc_tokens(spark, d):
    """Vocabulary with document frequencies; copies within a document are counted before the shuffle."""
    each = table(spark, d, "documents").select("doc_id", F.explode(search.tokens(F.col("text"))).alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents")).where("documents >= 20")


@query(f"WITH {_TOK} SELECT doc_id, round({_KW}, 6) AS score FROM t WHERE {_KW} > 0")
def keyword_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.round(search.keyword_score(WORDS, search.tokens(F.col("text")), F.col("text")), 6).alias("score"))
    return docs.where("score > 0")


@query(f"""WITH {_TOK}, s AS (SELECT doc_id, CASE WHEN list_contains(w, 'clown') THEN 0e0 WHEN NOT ((list_contains(w, 'the') OR contains(lt, 'the')) AND (list_contains(w, 'and') OR contains(lt, 'and'))) THEN 0e0 ELSE
 CASE WHEN contains(lt, 'stupid') AND contains(lt, 'idiot') THEN 1.5e0 WHEN contains(lt, 'stupid') OR contains(lt, 'idiot') THEN 1.25e0 ELSE 0.3e0 END END AS factor FROM t) SELECT doc_id, factor FROM s WHERE factor > 0""")
def boolean_mask(spark, d):
    terms = search.boolean_terms("the AND and stupid OR idiot NOT clown")
    docs = table(spark, d, "documents").select("doc_id", search.boolean_factor(terms, search.tokens(F.col("text")), F.col("text")).alias("factor"))
    return docs.where("factor > 0")


@query(f"WITH {_TOK} SELECT doc_id, lang, round({_KW}, 6) AS score FROM t WHERE lang = 'en' AND list_has_any([lang, source], ['src1', 'src2']) AND {_KW} > 0")
def metadata_filter(spark, d):
    """Scores under a scalar filter and a tag overlap; both reach the scan."""
    docs = table(spark, d, "documents").where((F.col("lang") == "en") & F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("src1"), F.lit("src2"))))
    return docs.select("doc_id", "lang", F.round(search.keyword_score(WORDS, search.tokens(F.col("text")), F.col("text")), 6).alias("score")).where("score > 0")


_TF = " + ".join(f"(len(list_filter(w, lambda x: x = '{x}')) + 0.5e0 * ((length(lt) - length(replace(lt, '{x}', ''))) / {len(x)}e0 - len(list_filter(w, lambda x: x = '{x}'))))" for x in WORDS)


@query(f"WITH {_TOK} SELECT doc_id, round(least(({_TF}) / (1 + ln(greatest(len(w), 1))), 1e0), 6) AS tf FROM t WHERE contains(lt, 'stupid') OR contains(lt, 'worthless') OR contains(lt, 'license')")
def tf_score(spark, d):
    docs = table(spark, d, "documents").where(search.holds_any(WORDS, F.col("text")))
    return docs.select("doc_id", F.round(search.term_frequency(WORDS, F.col("text")), 6).alias("tf"))


@query(f"WITH {_TOK}, p AS (SELECT doc_id, len(w) AS n, least(" + ", ".join(f"nullif(coalesce(list_position(w, '{x}'), 0), 0)" for x in WORDS) + ") - 1 AS i FROM t) SELECT doc_id, CASE WHEN i::DOUBLE / n < 0.1 THEN 1e0 WHEN i::DOUBLE / n < 0.3 THEN 0.8e0 WHEN i::DOUBLE / n < 0.5 THEN 0.6e0 ELSE 0.4e0 END AS score FROM p WHERE i IS NOT NULL")
def position_score(spark, d):
    return table(spark, d, "documents").select("doc_id", search.position_score(WORDS, search.tokens(F.col("text"))).alias("score")).where("score > 0")


def _passage_hits(spark, d, k=10):
    """Benchmark items searched by all their words, rarest first, until no further document can enter the best."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), search.tokens(F.col("text")).alias("words"))
    held = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), search.tokens(F.col("text")).alias("words"))
    found = overlap.best_by_overlap(words, held, k, search.THRESHOLD)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "score", "rank")


_HITS = r"""q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM benchmark),
h AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS token FROM documents),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), s AS (SELECT item_id, doc_id, round(count(*)::DOUBLE / n, 6) AS score FROM q JOIN h USING (token) JOIN n USING (item_id) GROUP BY item_id, doc_id, n),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s), top AS (SELECT item_id, doc_id, score, rank FROM k WHERE rank <= 10 AND score > 0.05)"""


@query(f"WITH {_HITS} SELECT * FROM top")
def topk_keyword(spark, d):
    return _passage_hits(spark, d).select("item_id", "doc_id", "score", "rank")


@query(f"""WITH {_HITS}, rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents ON contains(lower(documents.text), lower(b.text))), tot AS (SELECT item_id, count(*) AS n FROM rel GROUP BY 1),
m AS (SELECT item_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM top JOIN rel USING (item_id, doc_id) GROUP BY 1),
f AS (SELECT item_id AS query, coalesce(hits, 0) / 10e0 AS p, coalesce(hits, 0) / n::DOUBLE AS r, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(1e0 / first, 0) AS mrr FROM tot LEFT JOIN m USING (item_id))
SELECT query, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM f""")
def ir_metrics(spark, d):
    """Relevance of the keyword search: documents that hold the passage are relevant.

    Passages meet documents on a shared long word before the substring test, so there is no cross product.
    """
    hits = _passage_hits(spark, d).select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"), "rank")
    items = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("passage"))
    # The passage's longest word (ties to the smaller) must be among the document's words.
    keyed = items.withColumn("token", F.element_at(F.array_sort(F.transform(search.tokens(F.col("passage")), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"])
    # A text is read once and meets a passage in place: only the passages' words are exploded, and no text is shuffled.
    sought = keyed.agg(F.collect_set("token").alias("sought"))
    docs = table(spark, d, "documents").select("doc_id", "text", search.tokens(F.col("text")).alias("words")).crossJoin(F.broadcast(sought))
    met = docs.select("doc_id", "text", F.explode(F.array_intersect("words", "sought")).alias("token")).join(keyed, "token")
    both = met.where(F.lower("text").contains(F.col("passage"))).select(F.col("item_id").alias("query"), F.col("doc_id").alias("doc"))
    relevant = staged(both, "relevant")
    return search.ir_metrics(hits, relevant, 10)


_META = "(2 * (contains(lower(p_name), 'blue')::INTEGER + contains(lower(p_name), 'steel')::INTEGER) + contains(lower(p_brand), 'blue')::INTEGER + contains(lower(p_brand), 'steel')::INTEGER + 2 * len(list_filter(string_split(p_type, ' '), lambda x: contains(lower(x), 'blue') OR contains(lower(x), 'steel')))) / 5e0"


@query(f"SELECT p_partkey, round(least({_META}, 1e0), 6) AS score FROM part")
def metadata_score(spark, d):
    score = search.metadata_score(["blue", "steel"], {"title": F.col("p_name"), "brand": F.col("p_brand")}, {"tags": F.split("p_type", " ")})
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query()
def rerank(spark, d):
    """Keyword hits reranked by phrase, frequency, proximity and position signals."""
    text, held = F.col("text"), search.tokens(F.col("text"))
    words, _ = search.query_words("stupid worthless")
    init = search.blend(F.lit(0.5), search.keyword_score(words, held, text))
    scored = table(spark, d, "documents").where(search.holds_any(words, text)).select(
        F.lit("stupid worthless").alias("query"),
        "doc_id",
        F.round(search.rerank(init, F.lower("text").contains("stupid worthless").cast("double"), search.term_frequency(words, text), search.proximity_score(words, held), search.position_score(words, held), search.metadata_score(words, {"source": F.col("source"), "lang": F.col("lang")}), F.lit(0.5)), 6).alias("score"),
    )
    return search.top_k(scored, "query", "doc_id", 20).select("query", "doc_id", "score", "rank")


@query()
def highlights(spark, d):
    docs = table(spark, d, "documents").where(search.holds_any(["stupid", "worthless"], F.col("text")))
    return docs.select("doc_id", F.array_join(search.highlights(F.col("text"), ["stupid", "worthless"]), " ... ").alias("shown"))


@query()
def fuzzy_vocab_match(spark, d):
    """Misspelt words against the words of all documents."""
    vocabulary = table(spark, d, "documents").select(F.explode(F.array_distinct(search.tokens(F.col("text")))).alias("token")).distinct()
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, ["worthles", "stupit", "licens", "generel"]))).alias("word"))
    return search.fuzzy_matches(words, vocabulary)


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, n FROM c ORDER BY n DESC, lang, source LIMIT 10 OFFSET 5")
def list_documents_page(spark, d):
    counts = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "lang", "source").offset(5).limit(10)


_COS = "list_cosine_similarity(a.embedding, b.embedding)"


@query("WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def knn_exact_cosine(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 50 = 0"), 10, "cosine")


@query("WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def knn_exact_l2(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.nearest(v, v.where("vec_id % 50 = 0"), 10, "l2")


@query()
def ivf_search(spark, d):
    """Approximate neighbours by inverted lists of product codes, re-ranked exactly."""
    v = table(spark, d, "embeddings")
    return vectors.ivf_search(v, v.where("vec_id % 50 = 0"), 10)


@query("WITH e AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) t(i)), c AS (SELECT label, i, round(avg(x), 6) AS m FROM e GROUP BY ALL) SELECT label, (i - 1)::INTEGER AS component, m AS mean FROM c")
def label_centroids(spark, d):
    """Mean vectors of labels, a row a component."""
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("component", "x"))
    return parts.groupBy("label", "component").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("SELECT vec_id, round(list_inner_product(list_transform(embedding, lambda x: 0.8e0 * x::DOUBLE + 0.2e0), list_transform(embedding, lambda x: x::DOUBLE)), 6) AS score FROM embeddings")
def query_blend(spark, d):
    v = table(spark, d, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    ones = F.transform("e", lambda x: F.lit(1.0))
    return v.select("vec_id", F.round(vectors.dot(vectors.blend(F.col("e"), ones), F.col("e")), 6).alias("score"))


@query("SELECT doc_id, length(text) // 4 AS gpt_tokens, length(text) // 3 AS claude_tokens FROM documents".replace("claude_tokens", "other_tokens"))
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.count(F.col("text")).alias("gpt_tokens"), tokens.count(F.col("text"), 3).alias("other_tokens"))


@query("SELECT lang, f AS format, sum(floor((length(text) // 4) * r))::BIGINT AS tokens, round(1 - sum(floor((length(text) // 4) * r)) / sum(length(text) // 4), 6) AS saved FROM documents, (VALUES ('full', 0.9e0), ('condensed', 0.5e0), ('reference', 0.2e0), ('summary', 0.05e0)) x(f, r) GROUP BY ALL")
def token_estimates_by_format(spark, d):
    return tokens.estimates(table(spark, d, "documents"), "lang")


@query("SELECT doc_id, CASE WHEN 1000e0 / greatest(length(text) // 4, 1) >= 0.8 THEN 'full' WHEN 1000e0 / greatest(length(text) // 4, 1) >= 0.4 THEN 'condensed' WHEN 1000e0 / greatest(length(text) // 4, 1) >= 0.15 THEN 'reference' ELSE 'summary' END AS format FROM documents")
def format_auto_select(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.auto_format(tokens.count(F.col("text")), 1000).alias("format"))


@query("SELECT doc_id, source, floor(100000e0 * (length(text) // 4) / sum(length(text) // 4) OVER (PARTITION BY source))::BIGINT AS budget FROM documents")
def budget_split(spark, d):
    return tokens.split_budget(table(spark, d, "documents").select("doc_id", "source", tokens.count(F.col("text")).alias("tokens")), "source", "tokens", 100000).select("doc_id", "source", "budget")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, role, length(text) // 4 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END, turn) AS rn FROM conversations),
p(conv_id, rn, used, kept) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM conversations UNION ALL SELECT p.conv_id, s.rn, CASE WHEN p.used + s.t <= 150 THEN p.used + s.t ELSE p.used END, p.kept + CASE WHEN p.used + s.t <= 150 THEN 1 ELSE 0 END FROM p JOIN s ON s.conv_id = p.conv_id AND s.rn = p.rn + 1)
SELECT conv_id, max(used) AS used, max(kept) AS kept FROM p GROUP BY 1""")
def greedy_pack(spark, d):
    """Turns packed into a token budget by role, skipping what doesn't fit and going on."""
    c = table(spark, d, "conversations")
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    items = c.select("conv_id", F.struct(rank.alias("rank"), "turn", tokens.count(F.col("text")).alias("tokens")).alias("item"))
    packed = tokens.pack(items, "conv_id", 150)
    return packed.select("conv_id", "used", F.size("kept").cast("long").alias("kept"))


@query(r"SELECT doc_id, length(rtrim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m) +$', '', 'g'), ' ')) AS n FROM documents")
def remove_redundancy(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(tokens.remove_redundancy(F.col("text"))).cast("long").alias("n"))


_ABBR = "text"
for _word, _short in tokens.ABBREVIATIONS.items():
    _ABBR = f"regexp_replace({_ABBR}, '(?i)\\b{_word}\\b', '{_short}', 'g')"


@query(f"SELECT doc_id, length({_ABBR}) // 4 AS n FROM documents")
def abbreviate(spark, d):
    return table(spark, d, "documents").select("doc_id", tokens.count(tokens.abbreviate(F.col("text"))).alias("n"))


_WORDS_OF = tokens.ESSENTIAL.replace("'", "''")


@query(rf"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(ltrim(x, ' '), '#') OR regexp_matches(lower(x), '{_WORDS_OF}') OR (regexp_matches(trim(x, ' '), '^([-*] |[1-3]\.)') AND length(trim(x, ' ')) > 10))) AS n FROM documents")
def essential_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens.essential_lines(F.col("text"))).cast("long").alias("n"))


@query(r"WITH t AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), g AS (SELECT array_to_string(w[i:i + 2], ' ') AS gram FROM t, unnest(range(1, len(w) - 1)) r(i)) SELECT gram, count(*) AS n FROM g WHERE length(gram) > 10 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, gram LIMIT 50")
def ngram_lookup(spark, d):
    """Most frequent three-word phrases, the table of a phrase compressor."""
    return tokens.top_phrases(table(spark, d, "documents"), 3, 2, 50, 10)


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER AS rn FROM embeddings QUALIFY rn <= 5")
def warm_candidates(spark, d):
    """The first five of each label: what a cache would be filled with."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, d, "embeddings").select("vec_id", "label", F.row_number().over(w).alias("rn")).where("rn <= 5")
