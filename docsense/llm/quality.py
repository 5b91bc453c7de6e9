"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 2).

Each text becomes a row of statistics. Trees are grown on a bounded sample of labelled rows: features are binned once by
quantiles, and every level of a tree is split from gradient and hessian histograms of its nodes. Trees are complete and of
equal depth, so the whole forest is three arrays (feature, threshold, leaf value) and a batch of documents goes down all
trees at once, level by level, in numpy.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsense.llm.common import labelled_sample

MODULUS, REMAINDER = 4, 2
THRESHOLD = 0.7
#: At most so many labelled documents are learned from.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 120, 4, 48, 0.1, 1.0

FEATURES = (
    "log_chars",
    "log_words",
    "mean_word",
    "longest_word",
    "upper",
    "digit",
    "space",
    "non_ascii",
    "exclamation",
    "pipe",
    "symbol",
    "stop_mark",
    "other_mark",
    "newline",
    "distinct_words",
    "top_word",
    "repeated_next",
    "distinct_lines",
    "marked_words",
    "short_words",
)

_SYMBOLS = np.frombuffer(b"#$%&*@^~=+<>_\\/", np.uint8)
_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``FEATURES``; an empty or null text is all zeros."""
    text = text or ""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars, words, lines = len(text), text.split(), text.split("\n")
    n = max(len(words), 1)
    counts = Counter(words)
    lengths = list(map(len, words))
    marks = of[_MARKS].sum()
    spaces = of[[9, 10, 11, 12, 13, 32]].sum()
    stops = of[[44, 46]].sum()
    return [
        np.log1p(chars),
        np.log1p(len(words)),
        sum(lengths) / n,
        np.log1p(max(lengths, default=0)),
        of[65:91].sum() / chars,
        of[48:58].sum() / chars,
        spaces / chars,
        of[128:].sum() / len(raw),
        of[33] / n,
        of[124] / n,
        of[_SYMBOLS].sum() / n,
        stops / n,
        (marks - stops - of[33] - of[124] - of[_SYMBOLS].sum()) / n,
        len(lines) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        sum(not w[-1].isalnum() for w in words) / n,
        sum(x <= 2 for x in lengths) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: inner nodes in heap order (trees x 2**depth - 1), leaves left to right (trees x 2**depth)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node, rows, every = np.zeros((len(x), trees), np.int64), np.arange(len(x))[:, None], np.arange(trees)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[every, node]] > self.threshold[every, node])
        return self.base + self.leaf[every, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(x), -500, 500)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, ridge: float = RIDGE, least: float = 2.0) -> Forest:
    """Boost ``trees`` complete trees on the logistic loss. A node that no split improves sends all rows left."""
    n, m = x.shape
    edges = [_edges(x[:, j], bins) for j in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
    current = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-current))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, start = 1 << level, (1 << level) - 1
            place = node - start
            g, h = np.empty((m, width, bins)), np.empty((m, width, bins))
            for j in range(m):
                at = place * bins + binned[:, j]
                g[j] = np.bincount(at, gradient, width * bins).reshape(width, bins)
                h[j] = np.bincount(at, hessian, width * bins).reshape(width, bins)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            for j, e in enumerate(edges):
                gain[j, :, len(e) :] = 0
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            pick = best.argmax(1)
            for w in range(width):
                if best[w, pick[w]] > 1e-9:
                    j, cut = divmod(int(pick[w]), bins)
                    feature[t, start + w], threshold[t, start + w] = j, edges[j][cut]
            chosen = feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), chosen] > threshold[t, node])
        place = node - inner
        gs, hs = np.bincount(place, gradient, 1 << depth), np.bincount(place, hessian, 1 << depth)
        leaf[t] = rate * gs / (hs + ridge)
        current += leaf[t, place]
    return Forest(feature, threshold, leaf, base)


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """Grow the forest on labelled rows outside the held-out fold; without any, every score is one half."""

    def features(batches):
        for batch in batches:
            rows = _matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    sample = labelled_sample(docs, labels, "quality", MODULUS, REMAINDER, SAMPLE_ROWS)
    rows = sorted((r.label, tuple(r.x)) for r in sample.mapInArrow(features, "label int, x array<double>").collect())
    if not rows:
        return Forest(np.zeros((1, 1), np.int64), np.full((1, 1), np.inf), np.zeros((1, 2)), 0.0)
    return grow(np.array([x for _, x in rows]), np.array([float(y) for y, _ in rows]))


def scorer(spark, forest: Forest):
    """A column function from text to score; the forest is a broadcast of fixed size."""
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([shared.value.score(_matrix(texts[i : i + 1024].tolist())) for i in range(0, len(texts), 1024)] or [np.empty(0)]))

    return of
