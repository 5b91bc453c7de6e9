"""Mixing sources to target weights (operator 1).

Token shares p of the sources are raised to an exponent and normalised: w ~ p ** a. The exponent is bisected in [0, 1] to
the smallest value at which the mixture meets a limit: at most so much entropy (nats), or no source repeated more than so
many times. Weights become token budgets. Without a given total the budget is the smallest one that uses every document at
least once. A source's budget is realised as passes over its documents, each pass in a keyed order of its own, the last
one cut when the budget is spent (the document that reaches it is whole). The stream of each source is cut into its quota
of every block of ``block_tokens`` and the documents of a block are put in a keyed order, so each block carries the
target weights.

A document counts its white-space words, at least one; a null source counts as the source ``''``; rows that share a
doc_id share their fate. Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsense.llm.common import WORD_PATTERN, materialise

REPETITIONS = 2.0
BLOCK_TOKENS = 1_000_000
STEPS = 40
SEED = 17
#: Documents of a prefix-sum bucket, on average.
BUCKET = 512
KEY_BITS = 60


@dataclass(frozen=True)
class Target:
    """Exactly one of the two is set."""

    entropy: float | None = None
    repetitions: float | None = None


def token_count(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)), F.lit(1)).cast("long")


def keyed(*parts: Column | int | str) -> Column:
    """A reproducible 60-bit key: the first 15 hex digits of the MD5 of the parts joined by colons."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """source, tokens and documents: one row a source, aggregated before the shuffle."""
    return docs.select(F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("documents"))


def bisect_exponent(totals: DataFrame, target: Target, budget: int | None = None, steps: int = STEPS) -> float:
    """The smallest exponent in [0, 1] that meets the target, else 1.

    Each Spark job evaluates all midpoints of four bisection steps at once and the driver walks down them, so neither
    the number of sources nor their shares ever reach it.
    """
    whole = totals.agg(F.sum("total")).first()[0] or 0
    if not whole:
        return 1.0
    p = F.col("total") / F.lit(float(whole))

    def measure(points: list[float]) -> list[float]:
        at = totals.select(p.alias("p"), F.explode(F.array(*map(F.lit, points))).alias("a")).withColumn("power", F.pow("p", "a"))
        rows = at.groupBy("a").agg(F.sum("power").alias("z"), F.sum(F.col("power") * F.log("p")).alias("slope"), F.max(F.col("power") / F.col("p")).alias("most"), F.min(F.col("power") / F.col("p")).alias("least")).collect()
        found = {}
        for r in rows:
            if target.entropy is not None:
                found[r.a] = math.log(r.z) - r.a * r.slope / r.z - target.entropy
            else:
                found[r.a] = (r.most / r.least if budget is None else budget / whole * r.most / r.z) - target.repetitions
        return [found[a] for a in points]

    def tree(low: float, high: float, depth: int) -> list[float]:
        mid = (low + high) / 2
        return [mid] + (tree(low, mid, depth - 1) + tree(mid, high, depth - 1) if depth > 1 else [])

    at_zero, at_one = measure([0.0, 1.0])
    if at_zero <= 0:
        return 0.0
    if at_one > 0:
        return 1.0
    low, high = 0.0, 1.0
    for begun in range(0, steps, 4):
        depth = min(4, steps - begun)
        points = tree(low, high, depth)
        value = dict(zip(points, measure(points)))
        for _ in range(depth):
            mid = (low + high) / 2
            low, high = (low, mid) if value[mid] <= 0 else (mid, high)
    return high


def source_plan(docs: DataFrame, target: Target, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """source, total, documents, weight, budget, passes (whole ones), rest (tokens of the last pass) and quota."""
    totals = materialise(source_totals(docs), "source-totals")
    a = round(bisect_exponent(totals, target, budget), 9)
    sums = totals.agg(F.sum("total").cast("double").alias("whole")).crossJoin(totals.agg(F.sum(F.pow(F.col("total").cast("double"), F.lit(a))).alias("z"), F.min(F.pow(F.col("total").cast("double"), F.lit(a - 1))).alias("least"))).first()
    total = F.col("total").cast("double")
    if sums.whole is None:
        weight = passes = F.lit(0.0)
    else:
        weight = F.pow(total, F.lit(a)) / F.lit(sums.z)
        passes = F.pow(total, F.lit(a - 1)) / F.lit(sums.least) if budget is None else F.lit(float(budget)) * weight / total
    spent = F.floor(passes * total).cast("long")
    return totals.select(
        "source",
        "total",
        "documents",
        weight.alias("weight"),
        spent.alias("budget"),
        F.greatest(F.lit(1), F.round(F.lit(float(block_tokens)) * weight)).cast("long").alias("quota"),
    ).select("source", "total", "documents", "weight", "budget", "quota", F.expr("budget div total").alias("passes"), F.expr("budget % total").alias("rest"))


def occurrences(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Every use of every document: doc_id, source, tokens, pass, key (its place in the pass) and before (tokens of the
    source's stream that come before it). Texts aren't carried.

    The running sum is taken in two steps, inside key-range buckets of about ``BUCKET`` documents and over the buckets'
    sums, so that a hot source is spread over many tasks.
    """
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("tokens"))
    bits = F.greatest(F.ceil(F.log2(F.col("documents") / BUCKET)), F.lit(0)).cast("int")
    used = (
        light.join(plan.select("source", "total", "passes", "rest", bits.alias("bits")), "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
        .where((F.col("pass") < F.col("passes")) | (F.col("rest") > 0))
        .withColumn("key", keyed(seed, F.col("pass"), F.col("doc_id")))
        .withColumn("bucket", F.expr(f"shiftright(key, {KEY_BITS} - bits)"))
    )
    used = materialise(used, "mix-occurrences")
    sums = used.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("held"))
    before = sums.select("source", "pass", "bucket", (F.sum("held").over(Window.partitionBy("source", "pass").orderBy("bucket")) - F.col("held")).alias("earlier"))
    inside = Window.partitionBy("source", "pass", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("source", "pass", "bucket", "key")
    ranked = used.select("*", (F.sum("tokens").over(inside) - F.sum("tokens").over(ties)).alias("near"))
    placed = ranked.join(before, ["source", "pass", "bucket"]).withColumn("cut", F.col("earlier") + F.col("near"))
    kept = placed.where((F.col("pass") < F.col("passes")) | (F.col("cut") < F.col("rest")))
    return kept.select("doc_id", "source", "tokens", "pass", "key", (F.col("pass") * F.col("total") + F.col("cut")).alias("before"))


def mix_order(docs: DataFrame, target: Target, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """The mixture as an order of documents: doc_id, source, tokens, pass, block, position (in the block, from 1)."""
    plan = materialise(source_plan(docs, target, budget, block_tokens), "mix-plan")
    used = occurrences(docs, plan, seed).join(plan.select("source", "quota"), "source")
    blocks = used.withColumn("block", F.expr("before div quota")).withColumn("shuffled", keyed(seed, "block", F.col("block"), F.col("pass"), F.col("doc_id")))
    inside = Window.partitionBy("block").orderBy("shuffled", "doc_id", "pass", "source", "tokens")
    return blocks.select("doc_id", "source", "tokens", "pass", "block", F.row_number().over(inside).cast("long").alias("position"))


def mix(docs: DataFrame, target: Target, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mixture uses it; columns unchanged and no text shuffled.

    For each source only the key at which its last pass is cut is needed; documents up to it get one use more.
    """
    plan = materialise(source_plan(docs, target, budget), "mix-plan")
    last = occurrences(docs, plan, seed).join(plan.select("source", "passes"), "source").where(F.col("pass") == F.col("passes"))
    cuts = materialise(plan.join(last.groupBy("source").agg(F.max("key").alias("cut")), "source", "left").select("source", "passes", F.coalesce("cut", F.lit(-1)).alias("cut")), "mix-cuts")
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("of", F.coalesce("row.source", F.lit("")))
    joined = rows.join(cuts, rows["of"] == cuts["source"])
    uses = F.col("passes") + F.when(keyed(seed, F.col("passes"), F.col("row.doc_id").cast("long")) <= F.col("cut"), 1).otherwise(0)
    return joined.withColumn("use", F.explode(F.array_repeat(F.lit(1), uses.cast("int")))).select("row.*")
