"""Keyword and vector search: tokens, scores, boolean masks, filters, top-k, rerank, highlights, fuzzy terms."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsense.operators.fuzzy import candidates

#: Words that a query doesn't search for.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
PUNCTUATION = ".,;:!?\"'()[]{}"
TOKEN = r"[\p{L}\p{N}_]+"
OVERSAMPLE, THRESHOLD = 2, 0.05


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def boolean_terms(query: str) -> dict[str, list]:
    """Upper-case operators of a query: pairs of AND and OR, and words after NOT; matches don't overlap."""
    return {"and": re.findall(r"(\w+)\s+AND\s+(\w+)", query), "or": re.findall(r"(\w+)\s+OR\s+(\w+)", query), "not": re.findall(r"NOT\s+(\w+)", query)}


def query_words(query: str, synonyms: dict[str, list[str]] | None = None) -> tuple[list[str], list[str]]:
    """Search words of a query in order, and their synonyms in alphabetical order."""
    plain = re.sub(r"\s+(AND|OR|NOT)\s+", " ", f" {query} ")
    words = [w for w in dict.fromkeys(re.findall(r"\w+", plain.lower())) if w not in STOP_WORDS]
    known = synonyms or {}
    around = {s for w in words for s in known.get(w, [])} | {head for head, others in known.items() for w in words if w in others}
    return words, sorted(around - set(words))


def keyword_score(words: list[str], held: Column, text: Column) -> Column:
    """Share of the words found: 1 for a token, else one half for a substring."""
    lowered = F.lower(text)
    each = [F.when(F.array_contains(held, w), 1.0).when(lowered.contains(F.lit(w)), 0.5).otherwise(0.0) for w in words]
    return F.least(sum(each, F.lit(0.0)) / max(len(words), 1), F.lit(1.0))


def holds_any(words: list[str], text: Column) -> Column:
    """Whether the text holds any of the words, as a token or inside one."""
    lowered, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | lowered.contains(F.lit(w))
    return out


def _equals(word: str):
    return lambda t: t == F.lit(word)


def _places(held: Column, word: str) -> Column:
    return F.filter(F.transform(held, lambda t, i: F.when(t == F.lit(word), i)), lambda x: x.isNotNull())


def _least_gap(a: Column, b: Column) -> Column:
    return F.array_min(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: F.abs(x - y)))))


def term_frequency(words: list[str], text: Column) -> Column:
    """Occurrences as whole tokens plus half of other substrings, over 1 + ln(length), capped at 1."""
    lowered, held = F.lower(text), tokens(text)
    total = F.lit(0.0)
    for w in words:
        exact = F.size(F.filter(held, _equals(w)))
        anywhere = (F.length(lowered) - F.length(F.replace(lowered, F.lit(w), F.lit("")))) / len(w)
        total = total + exact + 0.5 * (anywhere - exact)
    return F.least(total / (1 + F.log(F.greatest(F.size(held), F.lit(1)))), F.lit(1.0))


def position_score(words: list[str], held: Column) -> Column:
    """1, .8, .6 or .4 by how early the first word occurs; 0 without any."""
    places = F.array_compact(F.array(*[F.nullif(F.array_position(held, w), F.lit(0)) for w in words]))
    ratio = (F.array_min(places) - 1) / F.size(held)
    return F.when(F.size(places) == 0, 0.0).when(ratio < 0.1, 1.0).when(ratio < 0.3, 0.8).when(ratio < 0.5, 0.6).otherwise(0.4)


def proximity_score(words: list[str], held: Column) -> Column:
    """exp(-mean least distance / 5) over pairs of words; one half for one word, 0 if any word is missing."""
    if len(words) < 2:
        return F.lit(0.5)
    where = [_places(held, w) for w in words]
    pairs = [(a, b) for i, a in enumerate(where) for b in where[i + 1 :]]
    least = [_least_gap(a, b) for a, b in pairs]
    missing = sum([F.when(F.size(a) == 0, 1).otherwise(0) for a in where], F.lit(0)) > 0
    return F.when(missing, 0.0).otherwise(F.exp(-(sum(least, F.lit(0.0)) / len(pairs)) / 5))


def boolean_factor(terms: dict[str, list], held: Column, text: Column) -> Column:
    """Multiplier of a score: 0 for a NOT token or a missing AND side; OR 1.5 both, 1.25 one, .3 none."""
    has = lambda w: F.array_contains(held, w.lower()) | F.lower(text).contains(F.lit(w.lower()))
    out = F.lit(1.0)
    for w in terms["not"]:
        out = F.when(F.array_contains(held, w.lower()), 0.0).otherwise(out)
    for a, b in terms["and"]:
        out = F.when(has(a) & has(b), out).otherwise(0.0)
    for a, b in terms["or"]:
        out = out * F.when(has(a) & has(b), 1.5).when(has(a) | has(b), 1.25).otherwise(0.3)
    return out


def blend(semantic: Column, keyword: Column) -> Column:
    weight = F.when(keyword > 0.5, 0.5).otherwise(0.6)
    return F.when(keyword == 0, 0.3 * semantic).when(keyword < 0.2, 0.5 * semantic).otherwise(weight * semantic + (1 - weight) * keyword)


def top_k(scored: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """Per query the best k above the threshold among twice as many; ties go to the smaller key."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= OVERSAMPLE * k)
    return ranked.where((F.col(score) > THRESHOLD) & (F.col("rank") <= k))


#: Metadata fields that count double.
IMPORTANT = ("title", "category", "tags", "description", "summary")


def metadata_score(words: list[str], fields: dict[str, Column], lists: dict[str, Column] | None = None) -> Column:
    """Words found in text fields, and items of list fields that hold a word, over the weights of the fields present; at most 1.

    Fields named in `IMPORTANT` weigh two, others one. A null field isn't present; without any the score is 0.
    """
    weight = lambda name: 2.0 if name in IMPORTANT else 1.0
    holds = lambda text: [F.lower(text).contains(w) for w in words]
    hits, total = F.lit(0.0), F.lit(0.0)
    for name, text in fields.items():
        hits = hits + sum((F.when(h, weight(name)).otherwise(0.0) for h in holds(text)), F.lit(0.0))
        total = total + F.when(text.isNotNull(), weight(name)).otherwise(0.0)
    for name, items in (lists or {}).items():
        found = F.filter(items, lambda x: F.coalesce(*[F.when(h, True) for h in holds(x)], F.lit(False)))
        hits = hits + F.when(items.isNotNull(), weight(name) * F.size(found)).otherwise(0.0)
        total = total + F.when(items.isNotNull(), weight(name)).otherwise(0.0)
    return F.least(F.coalesce(F.try_divide(hits, total), F.lit(0.0)), F.lit(1.0))


def rerank(init: Column, exact: Column, tf: Column, near: Column, place: Column, meta: Column, recent: Column) -> Column:
    """Weighted sum of the first score and six signals, at most twice the first score."""
    total = 0.4 * init + 0.2 * exact + 0.15 * tf + 0.1 * near + 0.05 * place + 0.05 * meta + 0.05 * recent
    return F.least(total, 2 * init)


def highlights(text: Column, words: list[str], most: int = 3) -> Column:
    """At most ``most`` sentences that hold a word, the words marked."""
    pattern = "(?i)(" + "|".join(map(re.escape, words)) + ")"
    found = F.filter(F.split(text, r"\."), lambda s: s.rlike(pattern))
    return F.transform(F.slice(found, 1, most), lambda s: F.regexp_replace(F.trim(s), pattern, "**$1**"))


def indel_ratio(a: str, b: str) -> int:
    """100 * 2 LCS / (len a + len b), rounded."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return round(200 * row[-1] / (len(a) + len(b))) if a or b else 100


def _ratio(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([indel_ratio(p, q) for p, q in zip(x, y)])

    return of(a, b)


def fuzzy_matches(words: DataFrame, vocabulary: DataFrame, least: int = 80, most: int = 5) -> DataFrame:
    """word, token, ratio: the closest vocabulary tokens of each word.

    Only pairs that share a segment are compared (see `fuzzy`); none that reaches the ratio is missed.
    """
    near = candidates(words, vocabulary, least)
    # The edit distance is never above the insertions and deletions that the ratio allows, so this loses no match.
    allowed = F.floor((F.length("word") + F.length("token")) * (100 - least) / 100 + 0.5)
    close = near.where(F.levenshtein("word", "token") <= allowed)
    scored = close.withColumn("ratio", _ratio(F.col("word"), F.col("token"))).where(F.col("ratio") >= least)
    order = Window.partitionBy("word").orderBy(F.desc("ratio"), "token")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("word", "token", "ratio", "rank")


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, F1, NDCG and reciprocal rank at k; ranked (query, doc, rank), relevant (query, doc)."""
    totals = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    marked = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query", "doc"], "left")
    per = marked.groupBy("query").agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    both = totals.join(per, "query", "left").na.fill({"hits": 0, "dcg": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    p, r = F.col("hits") / k, F.col("hits") / F.col("n")
    return both.select("query", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))
