"""The best documents of many queries by shared words, without the postings of common words.

A document's score is the share of a query's distinct words that it holds. Words are taken from the rarest on: documents that
hold one of a query's first j words are candidates and are counted whole, so every candidate's score is exact. A document
that holds none of the first j of n words shares n - j at most; once the k-th best candidate shares more, no other document
can enter. The first pass takes the rarest ``FIRST`` of the words and gives that bound, the second those words more that the
bound asks for, and what remains, the common words, is never joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsense.operators.staging import staged

#: The share of a query's words, the rarest ones, with which the first pass looks for candidates.
FIRST = 0.2


def ranked_words(queries: DataFrame, held: DataFrame) -> DataFrame:
    """query, token, n (words of the query) and place (from 1, rarest first; unknown words come first) of ``queries``
    (query, words), by how many rows of ``held`` (doc, words) have the word."""
    asked = queries.select("query", F.explode(F.array_distinct("words")).alias("token"))
    known = asked.select("token").distinct()
    counts = held.select(F.explode("words").alias("token")).join(known, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    by_query = Window.partitionBy("query")
    return asked.join(counts, "token", "left").select(
        "query", "token", F.count(F.lit(1)).over(by_query).alias("n"), F.row_number().over(by_query.orderBy(F.coalesce("docs", F.lit(0)), "token")).alias("place")
    )


def _candidates(words: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct (query, doc) of documents with one of the words (query, token)."""
    postings = held.select("doc", F.explode("words").alias("token"))
    return words.select("query", "token").join(postings, "token").select("query", "doc").distinct()


def _counted(pairs: DataFrame, queries: DataFrame, held: DataFrame) -> DataFrame:
    """query, doc and hits: how many of the query's words the document holds."""
    both = pairs.join(held, "doc").join(queries.select("query", F.col("words").alias("sought")), "query")
    return both.select("query", "doc", F.size(F.array_intersect("sought", "words")).alias("hits")).groupBy("query", "doc").agg(F.max("hits").alias("hits"))


def best_by_overlap(queries: DataFrame, docs: DataFrame, k: int, above: float = 0.0) -> DataFrame:
    """query, doc, score and rank of each query's ``k`` best documents with a score above ``above``; ties go to the smaller doc.

    ``queries`` are query and words, ``docs`` doc and words (arrays). Null ids and words are left out, repeated words count
    once; of several rows of one doc the best counts. Queries without words, and empty tables, find nothing.
    """
    held = staged(docs.where("doc is not null and words is not null").select("doc", F.array_distinct(F.array_compact("words")).alias("words")), "overlap-docs")
    sought = queries.where("query is not null and words is not null").select("query", F.array_distinct(F.array_compact("words")).alias("words"))
    places = staged(ranked_words(sought, held), "overlap-words")
    # A score above the threshold needs one hit at least, so the last words alone can never be enough.
    first = F.greatest(F.ceil(F.col("n") * FIRST), F.lit(1))
    found = staged(_counted(_candidates(places.where(F.col("place") <= first), held), sought, held), "overlap-first")
    order = Window.partitionBy("query").orderBy(F.desc("hits"), "doc")
    bound = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", F.col("hits").alias("least"))
    # n - j < least: with j = n - least + 1 words every other document shares fewer than the k-th candidate.
    asked = F.col("n") - F.greatest(F.coalesce("least", F.lit(1)), F.floor(F.lit(above) * F.col("n")) + 1) + 1
    more = places.join(bound, "query", "left").where((F.col("place") > first) & (F.col("place") <= asked))
    extra = _candidates(more, held).join(found, ["query", "doc"], "left_anti")
    every = found.unionByName(_counted(extra, sought, held)).join(places.select("query", "n").distinct(), "query")
    scored = every.withColumn("score", F.round(F.col("hits") / F.col("n"), 6)).withColumn("rank", F.row_number().over(order))
    return scored.where((F.col("rank") <= k) & (F.col("score") > above)).select("query", "doc", "score", "rank")
