"""Hybrid retrieval: query preparation, keyword and semantic blend with gates, cuts, enrichment and index upkeep."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsense.operators import search

#: Heads of synonyms and their words.
SYNONYMS = {
    "api": ["interface", "endpoint", "service"],
    "test": ["testing", "validation", "verification", "check"],
    "security": ["secure", "safety", "protection", "auth", "authentication"],
    "standard": ["convention", "guideline", "best practice", "rule"],
    "web": ["website", "webapp", "frontend", "browser"],
    "react": ["reactjs", "react.js"],
    "vue": ["vuejs", "vue.js"],
    "angular": ["angularjs", "angular.js"],
    "mcp": ["model context protocol", "context protocol"],
    "llm": ["language model", "ai model", "gpt", "claude"],
    "performance": ["speed", "optimization", "efficiency", "fast"],
    "accessibility": ["a11y", "wcag", "aria"],
    "database": ["db", "data store", "storage"],
    "deploy": ["deployment", "release", "publish"],
    "config": ["configuration", "settings", "setup"],
}
#: Words that a query's critical term can't be.
COMMON = ("best", "good", "new", "top", "all", "how", "what", "when", "where", "why")
PROXIMITY_WINDOW = 20
EMBEDDING = 64


def critical_term(words: list[str]) -> str | None:
    """The first word of over three letters that isn't common, of queries of two words or more."""
    return next((w for w in words if len(words) >= 2 and w not in COMMON and len(w) > 3), None)


def space_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def near_together(words: list[str], text: Column) -> Column:
    """Whether some run of ``PROXIMITY_WINDOW`` white-space words holds all ``words``; never for one word."""
    if len(words) < 2:
        return F.lit(False)
    held = space_words(text)
    last = F.size(held) - len(words) + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    here = lambda i: F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.array_contains(F.slice(held, i, PROXIMITY_WINDOW), w)), False)
    # Windows are tried only where every word occurs somewhere.
    everywhere = F.size(F.array_intersect(held, F.array(*map(F.lit, words)))) == len(words)
    return F.coalesce(everywhere, F.lit(False)) & F.exists(starts, lambda i: ~here(i))


def _in_fields(word: str, fields: list[Column]) -> Column:
    out = F.lit(False)
    for field in fields:
        out = out | F.coalesce(F.lower(field).contains(F.lit(word)), F.lit(False))
    return out


def keyword_score(words: list[str], text: Column, fields: list[Column]) -> Column:
    """1 for a token, .5 for a substring, .5 for a metadata hit, .5 for all words close together; over the words, at most 1."""
    held, lowered, total = search.tokens(text), F.lower(text), F.lit(0.0)
    for w in words:
        total = total + F.when(F.array_contains(held, w), 1.0).when(lowered.contains(F.lit(w)), 0.5).otherwise(0.0)
        total = total + F.when(_in_fields(w, fields), 0.5).otherwise(0.0)
    total = total + F.when(near_together(words, text), 0.5).otherwise(0.0)
    return F.least(total / max(len(words), 1), F.lit(1.0))


def combined_score(words: list[str], semantic: Column, text: Column, fields: list[Column]) -> Column:
    """Blend of semantic and keyword scores, halved where a query of three words misses its critical term."""
    keyword = keyword_score(words, text, fields)
    term = critical_term(words)
    gate = F.lit(1.0)
    if len(words) >= 3 and term:
        gate = F.when(F.lower(text).contains(F.lit(term)) | _in_fields(term, fields), 1.0).otherwise(0.5)
    return search.blend(semantic, keyword) * gate


def recency(days: Column) -> Column:
    """exp(-days / 30); one half without a date."""
    return F.coalesce(F.exp(-days / 30), F.lit(0.5))


def score_cut(ranked: DataFrame, query: str, words: int, score: str = "score") -> DataFrame:
    """Hits of each query up to the first that falls by over half from the one before to under .3, once three are kept.

    Queries of fewer than four words keep all hits. Needs ``rank`` from 1.
    """
    if words < 4:
        return ranked
    by = Window.partitionBy(query).orderBy("rank")
    before = F.lag(score).over(by)
    falls = (F.col("rank") > 3) & (F.when(before > 0, (before - F.col(score)) / before).otherwise(1.0) > 0.5) & (F.col(score) < 0.3)
    return ranked.withColumn("falls", F.coalesce(falls, F.lit(False))).withColumn("cut", F.max("falls").over(by)).where(~F.col("cut")).drop("falls", "cut")


def corrected(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word and correction: the closest vocabulary token of each word that isn't one itself, else the word."""
    unknown = words.join(vocabulary.select(F.col("token").alias("word")), "word", "left_anti")
    best = search.fuzzy_matches(unknown, vocabulary, most=1).select("word", F.col("token").alias("correction"))
    return words.join(best, "word", "left").select("word", F.coalesce("correction", "word").alias("correction"))


def expanded(words: list[str], most: int = 3) -> list[str]:
    """The first synonyms of the words of a query: heads' words, and heads of words, in alphabetical order."""
    return search.query_words(" ".join(words), SYNONYMS)[1][:most]


def hash_embedding(text: str | None, size: int = EMBEDDING) -> np.ndarray:
    """A unit vector drawn from a generator that the text's SHA-256 seeds: a stand-in where no model is at hand."""
    seed = int.from_bytes(hashlib.sha256((text or "").encode()).digest()[:8], "little")
    vector = np.random.default_rng(seed).standard_normal(size)
    return (vector / np.linalg.norm(vector)).astype(np.float32)


def embed(docs: DataFrame, text: str, size: int = EMBEDDING) -> DataFrame:
    """``docs`` with an embedding; each distinct text is encoded once and joined back by its hash."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([hash_embedding(t, size) for t in texts])

    keyed = docs.withColumn("text_key", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    vectors = keyed.groupBy("text_key").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias("said")).select("text_key", encode("said").alias("embedding"))
    return keyed.join(vectors, "text_key").drop("text_key")


def serialised(vector: Column) -> Column:
    """A vector as text: base64 of its comma-joined components, type and shape."""
    body = F.base64(F.array_join(F.transform(vector, lambda x: x.cast("string")), ",").cast("binary"))
    return F.concat(F.regexp_replace(body, r"\s", ""), F.lit("|float32|"), F.size(vector).cast("string"))


def deserialised(text: Column) -> Column:
    return F.transform(F.split(F.decode(F.unbase64(F.element_at(F.split(text, r"\|"), 1)), "UTF-8"), ","), lambda x: x.cast("float"))


def cache_key(parts: dict[str, Column]) -> Column:
    """SHA-256 of the canonical form of call arguments: names sorted, joined as name=value by colons."""
    return F.sha2(F.concat_ws(":", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in sorted(parts.items())]).cast("binary"), 256)


def upserted(index: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """An index with a batch taken in: the latest row of each key stays."""
    rows = index.unionByName(batch)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("place = 1").drop("place")


def applicable(language: Column, framework: Column, version: Column, want_language: Column, want_framework: Column, least: tuple[int, int, int]) -> Column:
    """Whether a standard fits a project: language and framework where both name one, and a version of at least ``least``."""
    same = lambda a, b: F.coalesce(a == b, F.lit(True))
    parts = F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(0))
    number = F.struct(at(0).alias("a"), at(1).alias("b"), at(2).alias("c"))
    limit = F.struct(*[F.lit(v).alias(c) for v, c in zip(least, "abc")])
    return same(language, want_language) & same(framework, want_framework) & F.coalesce(version.isNull() | (number >= limit), F.lit(True))
