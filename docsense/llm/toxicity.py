"""Toxic passages by maximum-scoring segments over token log-odds (operator 4).

Training (bounded sample of labelled rows): words are counted in toxic and clean documents, once for each document. A
word's score is its log-odds ratio under an informative Dirichlet prior: the pooled word frequencies, with as many
pseudo-counts as the smaller class has counts (times ``PRIOR``). Words whose ratio is not ``Z_MIN`` standard deviations from zero score the neutral drift, which is negative.

Scoring (every whole text): one linear scan finds all maximal-scoring segments (Ruzzo and Tompa). Under the clean word
distribution the best segment of n words exceeds s about ``K n exp(-lambda s)`` times by chance (Karlin and Altschul);
lambda solves ``E exp(lambda s) = 1`` and K is its maximum-likelihood value on clean training documents. Segments expected
at most ``SIGNIFICANT`` times by chance are reported as toxic passages. Their evidence is the logarithm of the summed
odds against chance, and a logistic curve fitted to the training sample turns it into a score from 0 to 1.

Words are the letter runs of the text as it stands, each lower-cased on its own, so passages are spans of the original
text. Null and empty texts score as texts without words; repeated rows score alike; very long texts are scanned whole; an
empty table gives an empty result; only doc_id and text are read, so other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsense.llm.common import labelled_sample, materialise

WORDS = re.compile(r"[^\W\d_]+")
MODULUS, REMAINDER = 3, 1
THRESHOLD = 0.7
#: At most so many labelled documents are learned from, which bounds the lexicon too.
SAMPLE_ROWS = 20_000
PRIOR = 1.0
Z_MIN = 2.5
NEUTRAL = -0.1
SIGNIFICANT = 0.05


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    rate: float  # lambda
    scale: float  # K
    slope: float
    offset: float


def segments(hits: list[tuple[int, float]], neutral: float = NEUTRAL) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first word, last word + 1, score).

    ``hits`` are the words with a score of their own, in order; all others score ``neutral`` < 0. Each candidate keeps
    a link to the nearest earlier one with a smaller left sum, so the scan is linear in the number of hits.
    """
    found: list[list] = []  # left sum, right sum, first, stop, link
    total, at = 0.0, 0
    for place, value in hits:
        total += neutral * (place - at)
        left, at = total, place + 1
        total += value
        if value <= 0:
            continue
        first, stop, right = place, place + 1, total
        while True:
            link = len(found) - 1
            while link >= 0 and found[link][0] >= left:
                link = found[link][4]
            if link < 0 or found[link][1] >= right:
                found.append([left, right, first, stop, link])
                break
            left, first = found[link][0], found[link][2]
            del found[link:]
    return [(a, b, right - left) for left, right, a, b, _ in found]


def scan(text: str | None, lexicon: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and the maximal segments by word position."""
    words = WORDS.findall(text or "")
    values = map(lexicon.get, map(str.lower, words))
    return len(words), segments([(i, v) for i, v in enumerate(values) if v is not None])


def evidence(n: int, found: list[tuple[int, int, float]], rate: float, scale: float) -> float:
    """ln(1 + sum of odds against chance) over the segments of one document; 0 without segments."""
    if not found:
        return 0.0
    powers = np.array([rate * s for _, _, s in found]) - np.log(max(scale * n, 1e-300))
    return float(np.logaddexp(0.0, np.logaddexp.reduce(powers)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope (not negative) and offset of a ridge logistic regression by Newton's method."""
    design, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = _logistic(design @ beta)
        gradient = design.T @ (y - p) - ridge * np.array([beta[0], 0.0])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def _count_batches(batches):
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            (toxic if label else clean).update(set(map(str.lower, WORDS.findall(text))))
        if len(toxic) + len(clean) > 500_000:
            yield _partial_counts(toxic, clean)
            toxic, clean = Counter(), Counter()
    yield _partial_counts(toxic, clean)


def _partial_counts(toxic: Counter, clean: Counter) -> pa.RecordBatch:
    words = sorted(toxic.keys() | clean.keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())],
        names=["word", "toxic", "clean"],
    )


def _rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive solution of sum(weights * exp(rate * values)) = 1; needs a negative mean."""
    low, high = 0.0, 1.0
    excess = lambda r: float(np.logaddexp.reduce(r * values + np.log(weights)))
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn the lexicon, the calibration and the logistic curve from labelled rows outside the held-out fold.

    Without labelled documents of both kinds nothing can be learned: the lexicon is empty and every score is the share
    of toxic labels, or 0 without labels.
    """
    sample = materialise(labelled_sample(docs, labels, "toxic", MODULUS, REMAINDER, SAMPLE_ROWS), "toxic-sample")
    counts = materialise(sample.mapInArrow(_count_batches, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-counts")
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    n_toxic, n_clean = total.toxic or 0, total.clean or 0
    lexicon: dict[str, float] = {}
    rate = scale = 1.0
    if n_toxic and n_clean:
        pseudo = PRIOR * min(n_toxic, n_clean)
        prior = F.lit(pseudo) * (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
        odds = lambda k, n: F.log((k + prior) / (n + pseudo - k - prior))
        scored = counts.select(
            "word",
            "clean",
            (odds(F.col("toxic"), n_toxic) - odds(F.col("clean"), n_clean)).alias("ratio"),
            F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)).alias("sd"),
        )
        top = scored.where(F.abs("ratio") >= Z_MIN * F.col("sd")).collect()
        lexicon = {r.word: min(float(r.ratio), 8.0) if r.ratio > 0 else max(float(r.ratio), -1.0) for r in top}
        own = np.array([lexicon[r.word] for r in top] + [NEUTRAL])
        share = np.array([max(r.clean, 0.5) for r in top] + [max(n_clean - sum(r.clean for r in top), 1.0)], dtype=float)
        share /= share.sum()
        if lexicon and (own > 0).any() and (own * share).sum() < 0:
            rate = _rate(own, share)
    shared = lexicon

    def statistics(batches):
        for batch in batches:
            rows = [scan(x, shared) for x in batch.column("text").to_pylist()]
            flat = [(float(n), [s for _, _, s in found]) for n, found in rows]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([n for n, _ in flat]), pa.array([s for _, s in flat], pa.list_(pa.float64()))], names=["label", "n", "found"])

    rows = sample.mapInArrow(statistics, "label int, n double, found array<double>").collect() if lexicon else []
    if rows:
        clean = [r for r in rows if not r.label]
        scale = len(clean) / max(sum(r.n * np.exp(-rate * max(r.found, default=0.0)) for r in clean), 1e-9) if clean else 1.0
        x = np.array([evidence(r.n, [(0, 0, s) for s in r.found], rate, scale) for r in rows])
        slope, offset = _fit_logistic(x, np.array([float(r.label) for r in rows]))
        return Model(lexicon, rate, scale, slope, offset)
    share = sample.agg(F.avg("label")).first()[0]
    return Model({}, 1.0, 1.0, 0.0, -700.0 if not share else float(np.log(share / max(1 - share, 1e-12))))


def passages(text: str | None, model: Model) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Score and number of words of one text, and its significant passages as (start, end, segment score) in code points."""
    n, found = scan(text, model.lexicon)
    score = float(_logistic(np.float64(model.slope * evidence(n, found, model.rate, model.scale) + model.offset)))
    strong = [x for x in found if model.scale * n * np.exp(-model.rate * x[2]) <= SIGNIFICANT]
    if not strong:
        return score, n, []
    spans = [m.span() for m in WORDS.finditer(text or "")]
    return score, n, [(spans[a][0], spans[b - 1][1], s) for a, b, s in strong]


RESULT = "struct<score: double, words: long, passages: array<struct<start: long, end: long, score: double>>>"


def scorer(spark, model: Model):
    """A column function from text to score and passages; the model is a broadcast of bounded size."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [passages(x, shared.value) for x in texts]
        spans = [[{"start": a, "end": b, "score": s} for a, b, s in found] for _, _, found in rows]
        return pd.DataFrame({"score": [s for s, _, _ in rows], "words": [n for _, n, _ in rows], "passages": spans})

    return of


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches ``threshold``; columns unchanged. Texts without words stay."""
    model = fit(docs, labels)
    found = scorer(docs.sparkSession, model)(F.coalesce("text", F.lit("")))
    return docs.where((found["score"] < threshold) | (found["words"] == 0))
