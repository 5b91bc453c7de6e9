"""Exact top-k inner-product search by MaxScore (operator 6).

Vectors are turned into integer weights, floor(64 * x) for each component. Every component is a term; a candidate's
posting for it holds its weight. Shards of candidates store postings term by term, shifted by the shard's least (or, for
negative query weights, greatest) weight, so that every term adds something between zero and its bound to a query's score
plus a constant.

For each query a shard first scores a few candidates to get a threshold. Terms are ordered by bound; those whose bounds
together can't lift a candidate to the threshold are non-essential. Essential postings, and no others, are traversed for
all candidates; the non-essential ones are probed, largest bound first, only for candidates that could still reach the
threshold. Ties with the threshold stay in, and the smaller id wins. Shards keep their best k of each query and a window
merges them.

Sums are taken in doubles where no partial sum can reach 2**53, in 64-bit integers where none can reach 2**63, and else in
integers of any size, so scores are exact; one that a long can't hold counts as the nearest long.

Shards and query blocks have bounded sizes and hashed members, so equal vectors, and rows that share an id, spread evenly.
A candidate is sent once for each block of queries and a query once for each shard, so the sizes are as large as a task's
memory allows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
SCALE = 64
#: Rows of a tile's two sides: with 64 components about 16 and 4 MB of weights in a task.
SHARD_ROWS = 32_768
QUERY_ROWS = 8_192
#: Every so many-th candidate of a shard is scored first, for a threshold.
SEED_STEP = 8
#: ... but no more than about so many.
SEEDS = 1024
BATCH = 64
#: Terms probed between two checks of which candidates are still competitive.
STEP = 8
LONG = (1 << 63) - 1


def weights(vector: Column) -> Column:
    """floor(64 * x) of every component, as long integers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null, NaN or infinite component."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))), F.lit(False))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _largest(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.min(initial=0))), abs(int(matrix.max(initial=0))))


def exact_kind(candidates: np.ndarray, queries: np.ndarray):
    """The number type in which no sum over terms, with bounds and constants, loses a unit."""
    most = 4 * (_largest(candidates) + 1) * (_largest(queries) + 1) * candidates.shape[1]
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


class Shard:
    """Postings of some candidates, term by term."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, kind=np.float64):
        order = np.argsort(ids, kind="stable")
        self.ids, self.kind = ids[order], kind
        self.low, self.high = matrix.min(axis=0).astype(kind), matrix.max(axis=0).astype(kind)
        self.postings = np.ascontiguousarray(matrix[order].T.astype(kind))  # terms x candidates

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """For each query its id and the ids and scores of its best k candidates other than itself."""
        q = queries.astype(self.kind)
        # Every term adds q * w = floor + gain with 0 <= gain <= bound.
        ends = q * self.low, q * self.high
        floor, bound = np.minimum(*ends), np.maximum(*ends) - np.minimum(*ends)
        base = floor.sum(axis=1)
        terms = np.argsort(-bound.astype(float), axis=1, kind="stable")
        width = terms.shape[1]
        zero = np.zeros((len(q), 1), bound.dtype)
        suffix = lambda x: np.concatenate([np.cumsum(np.take_along_axis(x, terms, 1)[:, ::-1], axis=1)[:, ::-1], zero], axis=1)
        gains, remaining = suffix(bound), suffix(floor + bound)
        some = np.arange(0, len(self.ids), max(SEED_STEP, len(self.ids) // SEEDS))
        if len(some) > k:
            # The k-th best of some candidates; the query itself counts as less than any score.
            seen = np.where(self.ids[some] == query_ids[:, None], base[:, None] - 1, q @ self.postings[:, some])
            threshold = _sorted_at(seen, len(some) - k)
        else:
            threshold = base - 1
        # A term is essential unless the bounds from it on can't lift a candidate from the base to the threshold.
        essential = np.maximum((gains[:, :-1] >= (threshold - base)[:, None]).sum(axis=1), 1)
        # Queries whose terms are all essential traverse the same postings, together.
        whole = np.flatnonzero(essential == width)
        traversed = dict(zip(whole.tolist(), q[whole] @ self.postings))
        for i, query_id in enumerate(query_ids):
            at, limit = int(essential[i]), threshold[i] if self.kind is not object else _limit(threshold[i])
            first = terms[i, :at]
            scores = traversed.pop(i) if at == width else q[i, first] @ self.postings[first]
            live = np.flatnonzero((scores + remaining[i, at] >= limit) & (self.ids != query_id))
            scores = scores[live]
            while at < width:
                more = terms[i, at : at + STEP]
                scores = scores + q[i, more] @ self.postings[np.ix_(more, live)]
                at = min(at + STEP, width)
                stay = scores + remaining[i, at] >= limit
                live, scores = live[stay], scores[stay]
            scores = _longs(scores)
            if len(scores) > k:
                stay = scores >= _sorted_at(scores, len(scores) - k)
                live, scores = live[stay], scores[stay]
            order = np.lexsort((live, ~scores))[:k]
            yield int(query_id), self.ids[live[order]], scores[order]


def _sorted_at(values: np.ndarray, at: int):
    """What stands at place ``at`` of the last axis in ascending order."""
    return (np.sort(values, axis=-1) if values.dtype == object else np.partition(values, at, axis=-1))[..., at]


def _limit(threshold: int) -> int:
    """A threshold under which no score that counts as much can fall."""
    return min(threshold, LONG) if threshold > -LONG - 1 else -(1 << 200)


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        scores = np.array([min(max(x, -LONG - 1), LONG) for x in scores], object)
    return scores.astype(np.int64)


def _search_group(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            width = max(candidates.w.map(len).max(), queries.w.map(len).max(), 1)
            held, ids, matrix = _matrix(candidates.w, width), queries.vec_id.to_numpy(np.int64), _matrix(queries.w, width)
            shard = Shard(candidates.vec_id.to_numpy(np.int64), held, exact_kind(held, matrix))
            for i in range(0, len(ids), BATCH):
                found += shard.search(ids[i : i + BATCH], matrix[i : i + BATCH], k)
        column = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        return pd.DataFrame({"query_id": column([np.full(len(v), i) for i, v, _ in found]), "vec_id": column([v for _, v, _ in found]), "score": column([s for _, _, s in found])})

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = K, vector: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's best k candidates other than its own id.

    Only vec_id and the vector column are read. Rows with a null id or an unusable vector take no part; shorter vectors
    count as padded with zeros; an empty side gives an empty result. vec_id should be unique: a repeated id is
    listed as often as it occurs.
    """
    usable_rows = lambda df: df.where(usable(F.col(vector)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), weights(F.col(vector)).alias("w"))
    left, right = usable_rows(candidates), usable_rows(queries)
    shards = max(1, -(-left.count() // shard_rows))
    blocks = max(1, -(-right.count() // query_rows))
    left = left.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(_search_group(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
