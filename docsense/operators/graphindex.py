"""Navigable small-world graphs over shards of vectors: build, store as a table, search by beams, merge.

Vectors are dealt by a hash of vec_id into shards of about ``SHARD_ROWS``; each shard is one layered graph, built in a task of
its own and stored as rows (shard, place, vec_id, vector, links), so an index is a table like any other: it can be written,
partitioned by shard and read again. A vector's top layer falls off geometrically; in each of its layers it is linked to up
to ``M`` neighbours (twice as many at the bottom) that are nearer to it than to each other, of the ``BUILD_BEAM`` nearest before it.
These are exact: a shard is small, and blocks of it are compared as matrices, which costs less than a beam for each vector.
A query descends greedily from the top, searches the bottom layer of every shard with a beam of ``BEAM`` and the shards' best
are merged. Distances are of directions, so the order is that of cosines.

Vectors that are null, zero, or hold null or non-finite components aren't indexed and find nothing; ties go to the smaller
vec_id. Repeated vec_ids are rows of their own. An empty table gives an empty index and empty results.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 20_000
M, BUILD_BEAM, BEAM = 16, 200, 50
#: Queries that meet a shard in one task.
QUERY_BLOCK = 4096
#: Nodes whose candidates are compared at once.
ROWS_AT_ONCE = 128
INDEX = "shard int, place int, vec_id long, vector array<float>, links array<array<int>>"
FOUND = "query_id long, vec_id long, score double, evaluations long"


def directions(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows, and which rows those are."""
    rows = [np.array(v if v is not None else [], np.float64) for v in vectors]
    width = max((len(r) for r in rows), default=0)
    sizes = [np.linalg.norm(r) if len(r) == width and width else 0.0 for r in rows]
    usable = np.array([math.isfinite(s) and s > 0 for s in sizes], bool)
    kept = [r / s for r, s, u in zip(rows, sizes, usable) if u]
    return np.array(kept, np.float32).reshape(len(kept), width), usable


class Graph:
    """One shard's graph; ``links[layer][node]`` are the neighbours. ``evaluations`` counts computed distances."""

    def __init__(self, vectors: np.ndarray, links: list[dict[int, np.ndarray]], entry: int | None):
        self.vectors, self.links, self.entry, self.evaluations = vectors, links, entry, 0

    def gaps(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        self.evaluations += len(nodes)
        return 1.0 - self.vectors[nodes] @ q

    def beam(self, q: np.ndarray, entries: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes that best-first search finds from ``entries`` (gap, node), nearest first."""
        seen = np.zeros(len(self.vectors), bool)
        seen[[node for _, node in entries]] = True
        open_, best = list(entries), [(-gap, node) for gap, node in entries]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            gap, node = heapq.heappop(open_)
            if len(best) >= width and gap > -best[0][0]:
                break
            near = self.links[layer].get(node)
            if near is None or not len(near):
                continue
            near = near[~seen[near]]
            seen[near] = True
            for g, other in zip(self.gaps(q, near).tolist(), near.tolist()):
                if len(best) < width or g < -best[0][0]:
                    heapq.heappush(open_, (g, other))
                    heapq.heappush(best, (-g, other))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-g, node) for g, node in best)

    def descend(self, q: np.ndarray, down_to: int) -> list[tuple[float, int]]:
        """The nearest node of the layers above ``down_to``, as the entry to that layer."""
        near = [(float(self.gaps(q, np.array([self.entry]))[0]), self.entry)]
        for layer in range(len(self.links) - 1, down_to, -1):
            near = self.beam(q, near, 1, layer)
        return near

    def search(self, q: np.ndarray, k: int, width: int) -> list[tuple[float, int]]:
        return self.beam(q, self.descend(q, 0), max(width, k), 0)[:k] if self.entry is not None else []


def _nearest_before(unit: np.ndarray, members: np.ndarray, a: int, b: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest earlier members of the members a to b, nearest first, and their gaps; -1 and inf where there are fewer."""
    gaps = 1.0 - unit[members[a:b]] @ unit[members[:b]].T
    gaps[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = np.inf
    width = min(width, b)
    near = np.argpartition(gaps, width - 1, axis=1)[:, :width]
    gaps = np.take_along_axis(gaps, near, 1)
    order = np.lexsort((near, gaps), axis=1)
    near, gaps = np.take_along_axis(near, order, 1), np.take_along_axis(gaps, order, 1)
    return np.where(np.isfinite(gaps), members[near], -1), gaps


def spread(unit: np.ndarray, near: np.ndarray, gaps: np.ndarray, most: int) -> np.ndarray:
    """For each row up to ``most`` of its nodes (nearest first, -1 for none), leaving out those nearer to a chosen one; then the rest fills up."""
    there = near >= 0
    held = unit[near]
    between = 1.0 - held @ held.transpose(0, 2, 1)
    passed, taken, n = ~there, np.zeros(near.shape, bool), np.zeros(len(near), int)
    for j in range(near.shape[1]):
        taken[:, j] = take = ~passed[:, j] & (n < most)
        n += take
        passed |= take[:, None] & (between[:, j] < gaps)
        if (n >= most).all():
            break
    order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(near, order, 1)


def _linked(unit: np.ndarray, members: np.ndarray, m: int, most: int, width: int) -> dict[int, np.ndarray]:
    """One layer's links: every node to up to ``m`` earlier ones and back, those with more than ``most`` spread again."""
    chosen = [spread(unit, *_nearest_before(unit, members, a, min(a + ROWS_AT_ONCE, len(members)), width), m) for a in range(0, len(members), ROWS_AT_ONCE)]
    heads = np.repeat(members, [c.shape[1] for c in chosen for _ in c])
    tails = np.concatenate([c.ravel() for c in chosen])
    heads, tails = heads[tails >= 0], tails[tails >= 0]
    heads, tails = np.concatenate([heads, tails]), np.concatenate([tails, heads])
    gaps = np.concatenate([1.0 - np.einsum("ij,ij->i", unit[heads[i : i + 100_000]], unit[tails[i : i + 100_000]]) for i in range(0, len(heads), 100_000)] or [np.empty(0, np.float32)])
    order = np.lexsort((tails, gaps, heads))
    heads, tails, gaps = heads[order], tails[order], gaps[order]
    first, last = np.searchsorted(heads, members, "left"), np.searchsorted(heads, members, "right")
    links = {node: tails[a:b].astype(np.int32) for node, a, b in zip(members.tolist(), first.tolist(), last.tolist())}
    full = np.flatnonzero(last - first > most)
    for i in range(0, len(full), ROWS_AT_ONCE):
        some = full[i : i + ROWS_AT_ONCE]
        at = first[some, None] + np.arange(min(width, (last - first)[some].max()))
        ok = at < last[some, None]
        at = np.where(ok, at, 0)
        for node, held in zip(members[some].tolist(), spread(unit, np.where(ok, tails[at], -1), np.where(ok, gaps[at], np.inf).astype(unit.dtype), most)):
            links[node] = held[held >= 0].astype(np.int32)
    return links


def _reached(unit: np.ndarray, links: dict[int, np.ndarray], entry: int, most: int) -> None:
    """Nodes that no path from the entry leads to are linked from the nearest reached node that has room."""
    reached, room = np.zeros(len(unit), bool), np.array([len(links[i]) < most for i in range(len(unit))])

    def follow(node: int) -> None:
        reached[node], todo = True, [node]
        while todo:
            near = links[todo.pop()]
            near = near[~reached[near]]
            reached[near] = True
            todo += near.tolist()

    follow(entry)
    for node in range(len(unit)):
        if not reached[node] and (reached & room).any():
            near = int(np.where(reached & room, 1.0 - unit @ unit[node], np.inf).argmin())
            links[near] = np.append(links[near], np.int32(node))
            room[near] = len(links[near]) < most
            follow(node)


def grow(vectors: np.ndarray, seed: int, m: int = M, width: int = BUILD_BEAM) -> Graph:
    """Layers are linked as by inserting node after node, but the candidates are the nearest earlier nodes by matrix products."""
    if not len(vectors):
        return Graph(vectors, [], None)
    rng = np.random.default_rng(seed)
    levels = (-np.log(1.0 - rng.random(len(vectors))) / math.log(m)).astype(int)
    links = [_linked(vectors, np.flatnonzero(levels >= layer), m, m if layer else 2 * m, width) for layer in range(levels.max() + 1)]
    entry = int(levels.argmax())
    _reached(vectors, links[0], entry, 2 * m)
    return Graph(vectors, links, entry)


def build(vectors: DataFrame, m: int = M, width: int = BUILD_BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index (columns ``INDEX``) of vec_id and embedding; ``links`` has the neighbours' places from the bottom layer up."""
    shards = max(1, -(-vectors.count() // shard_rows))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        unit, usable = directions(frame["embedding"])
        graph = grow(unit, int(frame["shard"].iloc[0]), m, width)
        links = [[layer[i].tolist() for layer in graph.links if i in layer] for i in range(len(unit))]
        return pd.DataFrame({"shard": frame["shard"].iloc[0], "place": range(len(unit)), "vec_id": frame["vec_id"].to_numpy()[usable], "vector": list(unit), "links": links}).astype({"shard": "int32", "place": "int32"})

    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("shard").applyInPandas(one, INDEX)


def _graph_of(frame: pd.DataFrame) -> Graph:
    frame = frame.sort_values("place")
    vectors = np.stack(frame["vector"].to_numpy()).astype(np.float32)
    layers = [len(x) for x in frame["links"]]
    links: list[dict[int, np.ndarray]] = [{} for _ in range(max(layers))]
    for node, held in enumerate(frame["links"]):
        for layer, near in enumerate(held):
            links[layer][node] = np.asarray(near, np.int32)
    return Graph(vectors, links, int(np.argmax(layers)))


def search(index: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, counted: bool = False) -> DataFrame:
    """query_id, vec_id, score (cosine) and rank of the neighbours that the shards' graphs find for ``queries``.

    With ``counted`` also evaluations: the distances computed for the query in all shards.
    """
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    sought = queries.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("query_id"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    # Each block of queries meets each shard, a graph of bounded size.
    asked = sought.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def one(graph_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph_rows) and len(query_rows):
            graph, ids = _graph_of(graph_rows), graph_rows.sort_values("place")["vec_id"].to_numpy()
            unit, usable = directions(query_rows["embedding"])
            for query_id, q in zip(query_rows["query_id"].to_numpy()[usable], unit):
                before = graph.evaluations
                found = [(ids[node], node) for _, node in graph.search(q, k + 1, beam) if ids[node] != query_id]
                exact = graph.vectors[[node for _, node in found]].astype(np.float64) @ q.astype(np.float64)
                out += [(query_id, vec_id, score, 0 if i else graph.evaluations - before) for i, ((vec_id, _), score) in enumerate(zip(found, exact))]
        return pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])

    met = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(one, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(best))
    if counted:
        spent = met.groupBy("query_id").agg(F.sum("evaluations").alias("evaluations"))
        return ranked.drop("evaluations").where(F.col("rank") <= k).join(spent, "query_id")
    return ranked.where(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")
