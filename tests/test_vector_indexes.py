"""Graph index and product-quantised lists: recall against exact search, work saved, hostile rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsense.operators import graphindex, vectors
from docsense.plans import extras, search

LARGE = "/root/testdata/sf0.1"


def _recall(found, exact):
    a, b = ({(r.query_id, r.vec_id) for r in df.collect()} for df in (found, exact))
    assert b and all(q != v for q, v in a)
    return len(a & b) / len(b)


@pytest.fixture(scope="module")
def large(spark):
    v = spark.read.parquet(f"{LARGE}/embeddings.parquet")
    return v, v.where("vec_id % 100 = 0")


def test_graph_recall_and_work(spark, large):
    """The registered parameters: recall of 0.9 at least, fewer than half of the distances of an exact search."""
    v, q = large
    exact = vectors.nearest(v, q, 10, "cosine")
    index = graphindex.build(v)
    index.write.parquet(path := graphindex_path(spark))
    found = graphindex.search(spark.read.parquet(path), q, 10, counted=True)
    assert _recall(found, exact) >= 0.9
    spent = [r.evaluations for r in found.select("query_id", "evaluations").distinct().collect()]
    assert len(spent) == 20 and sum(spent) / len(spent) < 0.5 * v.count()
    scores = {(r.query_id, r.vec_id): r.score for r in exact.collect()}
    assert all(scores[r.query_id, r.vec_id] == pytest.approx(r.score, abs=1e-5) for r in found.collect() if (r.query_id, r.vec_id) in scores)


def graphindex_path(spark):
    from docsense.operators.staging import shared_dir

    return f"{shared_dir(spark)}/graph-{random.getrandbits(64):x}"


def test_graph_over_shards_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(graphindex, "QUERY_BLOCK", 7)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(i % 4, 1) for _ in range(12)]) for i in range(600)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 20 = 0")
    index = graphindex.build(v, shard_rows=150)
    assert index.select("shard").distinct().count() == 4 and index.count() == 600
    assert _recall(graphindex.search(index, q, 5), vectors.nearest(v, q, 5, "cosine")) >= 0.95


def test_graph_links_are_bounded_and_connected():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 16)).astype(np.float32)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    graph = graphindex.grow(unit, 5, m=6, width=40)
    assert all(len(x) <= (12 if layer == 0 else 6) for layer, held in enumerate(graph.links) for x in held.values())
    assert set(graph.links[0]) == set(range(400)) and all(set(up) <= set(down) for down, up in zip(graph.links, graph.links[1:]))
    reached, todo = {graph.entry}, [graph.entry]
    while todo:
        new = set(graph.links[0][todo.pop()].tolist()) - reached
        reached |= new
        todo += new
    assert len(reached) == 400


def test_graph_is_built_by_blocks():
    """Candidates are the nearest earlier vectors, exactly; 5,000 vectors take seconds, and every one is reached."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(4000, 32)), np.ones((1000, 32))]).astype(np.float32)[rng.permutation(5000)]
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    began = time.process_time()
    graph = graphindex.grow(unit, 1)
    assert time.process_time() - began < 25
    reached, todo = {graph.entry}, [graph.entry]
    while todo:
        new = set(graph.links[0][todo.pop()].tolist()) - reached
        reached |= new
        todo += new
    assert len(reached) == 5000 and all(len(x) <= 2 * graphindex.M for x in graph.links[0].values())
    near, gaps = graphindex._nearest_before(unit, np.arange(5000), 300, 310, 5)
    assert all(set(near[i]) == set(np.argsort(1.0 - unit[: 300 + i] @ unit[300 + i], kind="stable")[:5]) or gaps[i, -1] < 1e-5 for i in range(10))


HOSTILE = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0])]


@pytest.mark.parametrize("find", [lambda v, q: graphindex.search(graphindex.build(v), q, 3), lambda v, q: vectors.ivf_search(v, q, 3)])
def test_hostile_rows(spark, find):
    v = spark.createDataFrame(HOSTILE, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x")).withColumn("score", F.lit(1))
    found = {}
    for r in find(v, v).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == {1, 2, 7} and found[1] == {2, 7} and found[2] == {1, 7}
    assert find(v.limit(0), v).count() == 0 and find(v, v.limit(0)).count() == 0


def test_quantised_lists_recall_and_work(spark, large):
    """The registered parameters compare 200 of 2,000 whole vectors a query, a tenth of an exact search."""
    v, _ = large
    exact = vectors.nearest(v, v.where("vec_id % 50 = 0"), 10, "cosine")
    assert _recall(search.QUERIES["ivf_search"](spark, LARGE), exact) >= 0.9


def test_quantised_lists_split_hot_cells(spark, monkeypatch):
    """Nearly equal vectors fill one cell; it is scanned in blocks and query groups with the same result."""
    rng = random.Random(4)
    rows = [(i, [1.0 + rng.random() / 50 for _ in range(8)]) for i in range(300)] + [(1000 + i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 30 = 0")
    whole = {(r.query_id, r.vec_id) for r in vectors.ivf_search(v, q, 5, cells=16, probes=16).collect()}
    monkeypatch.setattr(vectors, "CELL_ROWS", 3)
    monkeypatch.setattr(vectors, "CELL_QUERIES", 4)
    split = {(r.query_id, r.vec_id) for r in vectors.ivf_search(v, q, 5, cells=16, probes=16).collect()}
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(v, q, 5, "cosine").collect()}
    assert len(whole & exact) >= 0.9 * len(exact) and len(split & exact) >= 0.9 * len(exact)


def test_quantised_lists_return_a_blocks_best_only(spark, large):
    """What leaves the scans is refine times k rows a query and block, not that many for each of its cells."""
    v, _ = large
    q = v.where("vec_id % 500 = 0")
    df = vectors.ivf_search(v, q, 2, cells=40, probes=40, refine=3)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(block" in plan and "hashpartitioning(cell" not in plan
    points = np.random.default_rng(1).normal(size=(500, 8))
    held = vectors.quantiser(points, 5, 4, 1)
    cell, codes = held.encode(points)
    back = held.decode(cell, codes)
    assert back.shape == points.shape and ((back - points) ** 2).sum() < 0.2 * (points**2).sum()


def test_registered_graph_search(spark):
    found = extras.QUERIES["graph_search"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["query_id", "vec_id", "score", "rank"] and found.count() == 50


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_exact_search_of_blocks_equals_brute_force(spark, monkeypatch, metric):
    """Copies, near ties that rounding makes equal, huge and tiny vectors and nulls, over many blocks and tiles."""
    for name, size in (("QUERY_ROWS", 9), ("VECTOR_ROWS", 40), ("TILE", 4)):
        monkeypatch.setattr(vectors, name, size)
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(20)]
    rows = [(i, [x * (1e-3 if i % 50 == 7 else 1) + rng.choice([0, 1e-9, 3e-7]) for x in base[i % 20]]) for i in range(200)] + [(200 + i, [1e5 * x for x in base[i]]) for i in range(10)]
    v = spark.createDataFrame(rows + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 10 = 0")
    by_id = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vectors.nearest(v, q, 7, metric).collect()}

    def exact(a, b):
        if metric == "l2":
            return sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
        return -sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    for query, e in rows[::10]:
        want = sorted((round(exact(e, o), 6), i) for i, o in rows if i != query)[:7]
        got = [by_id[query, n] for n in range(1, 8)]
        assert [abs(s) for _, s in got] == pytest.approx([abs(s) for s, _ in want], abs=2e-6)
        assert sorted(got, key=lambda x: (x[1] if metric == "l2" else -x[1], x[0])) == got
    assert [by_id[300, n] for n in range(1, 8)] == [(n, None) for n in range(7)]


def test_hashed_search_is_the_exact_one_among_shared_buckets(spark, monkeypatch):
    monkeypatch.setattr(vectors, "VECTOR_ROWS", 70)
    rng = random.Random(5)
    v = spark.createDataFrame([(i, [rng.gauss(i % 3, 1) for _ in range(8)]) for i in range(200)] + [(999, None)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 20 = 0")
    wide = vectors.lsh_search(v, q, 5, width=1e6, tables=16)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, vectors.nearest(v.where("embedding is not null"), q, 5, "cosine").collect()))
    narrow = {(r.query_id, r.vec_id) for r in vectors.lsh_search(v, q, 5, width=1e-9, tables=2).collect()}
    assert not narrow
