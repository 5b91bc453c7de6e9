"""Vector similarity: exact and inverted-list neighbours, blending, principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def blend(query: Column, expanded: Column, share: float = 0.8) -> Column:
    return F.zip_with(query, expanded, lambda x, y: share * x.cast("double") + (1 - share) * y.cast("double"))


def _ranked(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score") if metric == "cosine" else F.asc_nulls_last("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def _score(metric: str) -> Column:
    if metric == "cosine":
        value = dot(F.col("q"), F.col("v")) / (F.col("qn") * F.col("vn"))
    else:
        value = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return F.round(value, 6)


#: Queries and vectors that meet in one task, and queries scored at once.
QUERY_ROWS, VECTOR_ROWS, TILE = 4096, 16_384, 128
#: More than rounding to six places can move a score, and than a matrix product can differ from a sum in order.
MARGIN = 2e-6


def _matrix(rows: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as a matrix, and which rows are there and of that width."""
    whole = np.array([r is not None and len(r) == width for r in rows], bool)
    out = np.zeros((len(rows), width))
    if whole.any():
        out[whole] = np.stack([np.asarray(r, np.float64) for r, w in zip(rows, whole) if w])
    return out, whole


def _fold(terms) -> np.ndarray:
    """Sums from the first component on, as `dot` adds them."""
    total = 0.0
    for term in terms:
        total = total + term
    return total


def _best(value: np.ndarray, ids: np.ndarray, k: int, metric: str) -> np.ndarray:
    """Which of one query's exact scores may be among the ``k`` best once rounded. Of equal scores only the ``k`` smallest ids can."""
    key = np.where(np.isnan(value), np.inf, value) if metric == "cosine" else -np.where(np.isnan(value), np.inf, np.minimum(value, np.finfo(np.float64).max))
    order = np.lexsort((ids, -key))
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
    least = key[k - 1] - MARGIN if len(key) >= k else -np.inf
    return order[(place < k) & (key >= least)]


def _met(held: pd.DataFrame, sought: pd.DataFrame, k: int, metric: str) -> pd.DataFrame:
    """query_id, vec_id and value of the pairs of two blocks that may be among a query's ``k`` best.

    A matrix product leaves the scores that come near the k-th; those are summed again as `_score` does. With buckets only pairs
    that share one in some table count. Pairs without a score (null components, other widths) come last.
    """
    out, ids = [], held["vec_id"].to_numpy()
    lengths = np.array([-1 if q is None else len(q) for q in sought["q"]])
    for width in np.unique(lengths):
        v, whole = _matrix(held["v"], max(width, 0))
        some = sought[lengths == width]
        q, asked = _matrix(some["q"], max(width, 0))
        norms = [np.sqrt(_fold(x[:, i] * x[:, i] for i in range(x.shape[1]))) + np.zeros(len(x)) for x in (q, v)]
        squares = [(x * x).sum(1) for x in (q, v)]
        buckets = [np.stack(df["buckets"].to_numpy()).astype(np.int64) for df in (some, held)] if "buckets" in held else None
        for top in range(0, len(q), TILE):
            part = slice(top, min(top + TILE, len(q)))
            with np.errstate(all="ignore"):
                near = q[part] @ v.T
                near = near / np.outer(norms[0][part], norms[1]) if metric == "cosine" else -np.sqrt(np.maximum(squares[0][part, None] + squares[1][None, :] - 2 * near, 0))
            allowed = some["query_id"].to_numpy()[part, None] != ids[None, :]
            if buckets:
                shared = np.zeros(allowed.shape, bool)
                for t in range(buckets[0].shape[1]):
                    shared |= buckets[0][part, t, None] == buckets[1][None, :, t]
                allowed &= shared
            for row in range(len(near)):
                query_id, scored = some["query_id"].iloc[top + row], allowed[row] & whole & asked[top + row]
                at = np.flatnonzero(scored)
                if len(at) > k:
                    # A distance comes from a difference of squares: near zero its error is the root of theirs.
                    got = near[row, at]
                    sure = np.where(np.isnan(got), np.inf if metric == "cosine" else -np.inf, got)
                    kth = np.partition(sure, len(sure) - k)[len(sure) - k]
                    slack = MARGIN if metric == "cosine" else MARGIN + 2e-7 * np.sqrt(squares[0][top + row] + squares[1][at])
                    at = at[(sure >= kth - 2 * np.nanmax(slack)) | np.isnan(got)]
                with np.errstate(all="ignore"):
                    mine, theirs = q[top + row], v[at]
                    if metric == "cosine":
                        value = _fold(mine[i] * theirs[:, i] for i in range(width)) / (norms[0][top + row] * norms[1][at])
                    else:
                        value = np.sqrt(_fold((mine[i] - theirs[:, i]) * (mine[i] - theirs[:, i]) for i in range(width)))
                value = value + np.zeros(len(at))
                best = _best(value, ids[at], k, metric) if len(at) else np.empty(0, int)
                without = np.sort(ids[allowed[row] & ~scored])[: max(k - len(best), 0)]
                out.append((query_id, ids[at][best], value[best], without))
    sizes = [len(o[1]) + len(o[3]) for o in out]
    return pd.DataFrame({
        "query_id": np.repeat(np.array([o[0] for o in out], np.int64), sizes),
        "vec_id": np.concatenate([x for o in out for x in (o[1], o[3])] or [np.empty(0, np.int64)]).astype(np.int64),
        "value": pd.Series([float(x) for o in out for x in o[2].tolist() + [0.0] * len(o[3])], dtype=float),
        "known": [x for o in out for x in [True] * len(o[1]) + [False] * len(o[3])],
    })


def _searched(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """The best of queries (query_id, q and, if there, buckets) among vectors (vec_id, v and buckets), block by block."""
    groups, blocks = max(1, -(-queries.count() // QUERY_ROWS)), max(1, -(-vectors.count() // VECTOR_ROWS))
    known = lambda df, c: df.withColumn(c, F.when(~F.exists(c, lambda x: x.isNull()), F.col(c)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sought = known(queries, "q").where("query_id is not null").withColumn("query_id", F.col("query_id").cast("long")).withColumn("part", of("query_id", groups)).withColumn("block", every(blocks))
    held = known(vectors, "v").where("vec_id is not null").withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("block", of("vec_id", blocks)).withColumn("part", every(groups))

    def one(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _met(rows, asked, k, metric)

    met = held.groupBy("block", "part").cogroup(sought.groupBy("block", "part")).applyInPandas(one, "query_id long, vec_id long, value double, known boolean")
    return _ranked(met.select("query_id", "vec_id", F.when(F.col("known"), F.round("value", 6)).alias("score")), k, metric)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Exact neighbours of a stated query set: blocks of queries and of vectors meet once each, as matrices, and keep what
    may be among a query's ``k`` best. Vectors without a score (null components) come last."""
    return _searched(vectors.select("vec_id", F.col("embedding").alias("v")), queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), k, metric)


def lloyd(points: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k centres of ``points`` (a bounded sample) by k-means++ starts and Lloyd's rounds; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    chosen = [int(rng.integers(len(points)))]
    gaps = ((points - points[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = gaps.sum()
        chosen.append(int(rng.choice(len(points), p=gaps / total)) if total > 0 else int(rng.integers(len(points))))
        gaps = np.minimum(gaps, ((points - points[chosen[-1]]) ** 2).sum(1))
    centres = points[chosen].copy()
    for _ in range(rounds):
        cell = nearest_centre(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(cell, minlength=k)
        np.add.at(sums, cell, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def gaps_to(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1)[None, :] - 2 * points @ centres.T


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return gaps_to(points, centres).argmin(1)


@dataclass
class Quantiser:
    """Cells of unit vectors, and for each of the parts of what remains within a cell a book of codes."""

    cells: np.ndarray
    books: list[np.ndarray]
    cuts: list[slice]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest_centre(unit, self.cells)
        rest = unit - self.cells[cell]
        return cell, np.stack([nearest_centre(rest[:, cut], book) for cut, book in zip(self.cuts, self.books)], 1).astype(np.uint8)

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that cells and codes stand for."""
        out = self.cells[cell].astype(np.float32)
        for cut, book, column in zip(self.cuts, self.books, codes.T):
            out[:, cut] += book[column].astype(np.float32)
        return out


def quantiser(sample: np.ndarray, cells: int, parts: int, seed: int) -> Quantiser:
    """Fitted on unit vectors of a bounded sample; books have at most 256 codes."""
    centres = lloyd(sample, cells, seed)
    rest = sample - centres[nearest_centre(sample, centres)]
    edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges, edges[1:])]
    return Quantiser(centres, [lloyd(rest[:, cut], 256, seed + 1 + i) for i, cut in enumerate(cuts)], cuts)


#: Coded vectors that one task scans for a group of queries, and queries of a group.
CELL_ROWS, CELL_QUERIES = 65_536, 1024


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int, cells: int | None = None, probes: int | None = None, sample: int = 10_000, seed: int = 7, parts: int = 16, refine: int = 20) -> DataFrame:
    """Neighbours by cosine from inverted lists of product codes: query_id, vec_id, score and rank.

    Unit vectors are dealt into k-means ``cells``; within its cell a vector is a code of ``parts`` bytes, one for each part
    of its remainder. A query scans the codes of its ``probes`` nearest cells; of each block of ``CELL_ROWS`` codes the best ``refine``
    times k leave the task, and only the best so many of all are compared as whole vectors. Cells and codes are fitted on about ``sample`` vectors (twice as
    many at most, chosen by hash), every vector is coded. Without numbers there are about sqrt(n) / 2 cells, 16 to 256, and four fifths of
    them are scanned: what vectors without clusters need. Blocks hold all cells, so a hot cell is in all of them. Vectors that are null, zero or
    hold null or non-finite components take no part; an empty table gives an empty result.
    """
    from docsense.operators.graphindex import directions

    spark = vectors.sparkSession
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    rows = lambda df, name: df.where(usable).select(F.col("vec_id").cast("long").alias(name), F.col("embedding").cast("array<double>").alias("embedding"))
    n = vectors.count()
    cells = cells or max(16, min(256, int(n**0.5 / 2)))
    probes = probes or -(-4 * cells // 5)
    chosen = rows(vectors, "vec_id").where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // sample))) == 0).limit(2 * sample).toPandas()
    unit, _ = directions(chosen["embedding"])
    if not len(unit):
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    shared = spark.sparkContext.broadcast(quantiser(unit.astype(np.float64), cells, parts, seed))
    blocks, groups = max(1, -(-n // CELL_ROWS)), max(1, -(-queries.count() // CELL_QUERIES))

    def code(frames):
        for frame in frames:
            found, kept = directions(frame["embedding"])
            if len(found):
                cell, codes = shared.value.encode(found.astype(np.float64))
                yield pd.DataFrame({"vec_id": frame["vec_id"].to_numpy()[kept], "cell": cell, "code": [c.tobytes() for c in codes]})

    def directed(frames):
        for frame in frames:
            found, kept = directions(frame["embedding"])
            if len(found):
                yield pd.DataFrame({"query_id": frame["query_id"].to_numpy()[kept], "unit": list(found)})

    def scan(codes: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(codes) and len(sought):
            ids, cell = codes["vec_id"].to_numpy(), codes["cell"].to_numpy()
            held = shared.value.decode(cell, np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1))
            sizes, most = (held**2).sum(1), min(refine * k, len(ids))
            for i in range(0, len(sought), TILE):
                unit = np.stack(sought["unit"].iloc[i : i + TILE].to_numpy()).astype(np.float32)
                near = np.argsort(gaps_to(unit.astype(np.float64), shared.value.cells), axis=1, kind="stable")[:, :probes]
                probed = np.zeros((len(unit), len(shared.value.cells)), bool)
                np.put_along_axis(probed, near, True, 1)
                # But for the query's own size, which is the same for all, these are squared distances.
                gap = np.where(probed[:, cell], sizes - 2 * unit @ held.T, np.float32(np.inf))
                top = np.argpartition(gap, most - 1, axis=1)[:, :most]
                best = np.take_along_axis(gap, top, 1)
                there = np.isfinite(best)
                query = np.repeat(sought["query_id"].iloc[i : i + TILE].to_numpy(), most).reshape(top.shape)
                out.append(pd.DataFrame({"query_id": query[there], "vec_id": ids[top[there]], "gap": best[there].astype(np.float64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "gap": []})

    of_block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    of_group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    coded = rows(vectors, "vec_id").mapInPandas(code, "vec_id long, cell int, code binary").withColumn("block", of_block("vec_id")).withColumn("part", every(groups))
    sought = rows(queries, "query_id").mapInPandas(directed, "query_id long, unit array<float>").withColumn("part", of_group("query_id")).withColumn("block", every(blocks))
    keys = ["block", "part"]
    near = coded.groupBy(*keys).cogroup(sought.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, gap double").where("vec_id <> query_id")
    first = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "vec_id"))).where(F.col("place") <= refine * k)
    sides = lambda df, name, c: rows(df, name).select(name, F.col("embedding").alias(c), norm(F.col("embedding")).alias(f"{c}n"))
    both = first.select("query_id", "vec_id").distinct().join(sides(queries, "query_id", "q"), "query_id").join(sides(vectors, "vec_id", "v"), "vec_id")
    return _ranked(both.select("query_id", "vec_id", _score("cosine").alias("score")), k, "cosine")


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int, width: float = 1.6, tables: int = 24) -> DataFrame:
    """Neighbours by cosine among vectors that share a bucket of a random projection in one of ``tables`` tables.

    Buckets are compared where blocks of queries and vectors meet, so pairs are neither shuffled nor made once a table."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = lambda df: df.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("features", array_to_vector("e"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=7).fit(rows(vectors))

    def buckets(df: DataFrame, *names: str) -> DataFrame:
        hashed = model.transform(rows(df)).select(F.col("vec_id").alias(names[0]), F.col("e").alias(names[1]), "hashes")
        each = F.array(*[F.get(vector_to_array(F.get("hashes", F.lit(t))), F.lit(0)).cast("long") for t in range(tables)])
        return hashed.select(*names, each.alias("buckets"))

    return _searched(buckets(vectors, "vec_id", "v"), buckets(queries, "query_id", "q"), k, "cosine")


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id and its centred projection on the first k principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    centred = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    return PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred).select("vec_id", vector_to_array("p").alias("projection"))
