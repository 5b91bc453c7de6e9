"""A refreshed reference store equals one built anew; pair sums equal brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docsense.operators import graph, refbuild
from docsense.operators.staging import shared_dir

ROWS = "doc long, concept string"


def brute(rows):
    freq = Counter(r for r in rows if None not in r)
    held = defaultdict(dict)
    for (doc, concept), n in freq.items():
        held[doc][concept] = min(n / 10, 1.0)
    out = {}
    for a in held:
        for b in held:
            both = held[a].keys() & held[b].keys()
            if a != b and both:
                m = sum(held[b][c] for c in both) / len(both)
                out[a, b] = (len(both), round(min(1.0, m + min(len(both) / 10, 0.3)), 6))
    return out


def _rows(rng, docs):
    rows = [(d, rng.choice(["hot", "hot", *[f"c{i}" for i in range(25)]])) for d in docs for _ in range(rng.randrange(1, 9))]
    return rows + [(None, "hot"), (3, None)]


def _told(df):
    return {(r.source, r.target): (r.shared, pytest.approx(r.strength, abs=2e-6)) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 4, 256])
def test_pair_sums_against_brute_force(spark, block):
    """Also where a concept of all documents falls into many blocks, and between disjoint sets."""
    rng = random.Random(block)
    rows = _rows(rng, range(60))
    posts = refbuild.postings(spark.createDataFrame(rows, ROWS))
    want = brute(rows)
    assert _told(graph.shared_concepts(posts, block)) == want
    some, others = posts.where("doc < 20"), posts.where("doc >= 20")
    got = _told(graph.relationships(graph.cross_sums(some, others, block)))
    assert got == {k: v for k, v in want.items() if (k[0] < 20) != (k[1] < 20)}


def test_refreshes_equal_a_rebuild(spark):
    rng = random.Random(9)
    folder = f"{shared_dir(spark)}/refs-{random.getrandbits(60):x}"
    rows = _rows(rng, range(40))
    frame = lambda held: spark.createDataFrame(held, ROWS).withColumn("extra", F.lit(1))
    assert refbuild.refresh(spark, frame(rows), folder) == {"new": 40, "changed": 0, "removed": 0}
    assert _told(refbuild.relationships(spark, folder)) == brute(rows)
    assert refbuild.refresh(spark, frame(rows[::-1]), folder) == {"new": 0, "changed": 0, "removed": 0} and refbuild.versions(spark, folder) == [1]
    for _ in range(3):
        gone, touched = rng.sample(range(40), 4), rng.sample(range(40), 5)
        rows = [r for r in rows if r[0] not in gone] + [(d, rng.choice(["hot", "c1", "fresh"])) for d in touched + [100 + rng.randrange(9)]]
        refbuild.refresh(spark, frame(rows), folder)
        assert _told(refbuild.relationships(spark, folder)) == brute(rows)
        assert {r.doc for r in refbuild.read(spark, folder, "documents").collect()} == {d for d, c in rows if d is not None and c}
    assert len(refbuild.versions(spark, folder)) == 2
    assert refbuild.refresh(spark, frame(rows).limit(0), folder)["removed"] > 30 and refbuild.relationships(spark, folder).count() == 0


def test_an_unfinished_version_is_not_current(spark):
    folder = f"{shared_dir(spark)}/refs-{random.getrandbits(60):x}"
    rows = [(1, "a"), (2, "a")]
    refbuild.refresh(spark, spark.createDataFrame(rows, ROWS), folder)
    spark.createDataFrame([("x", 9, 1, 1.0)], "concept string, doc long, freq long, importance double").write.parquet(f"{folder}/v2/postings")  # a job that was lost here
    assert refbuild.versions(spark, folder) == [1]
    refbuild.refresh(spark, spark.createDataFrame(rows + [(3, "a")], ROWS), folder)
    assert refbuild.versions(spark, folder) == [1, 2] and _told(refbuild.relationships(spark, folder)) == brute(rows + [(3, "a")])


@pytest.mark.parametrize("wide", [1, 3, 32])
def test_strong_pairs_against_brute_force(spark, monkeypatch, wide):
    """Pairs by two shared concepts, also of documents with many concepts, and those of one concept that is worth enough."""
    monkeypatch.setattr(graph, "WIDE", wide)
    rng = random.Random(wide)
    rows = _rows(rng, range(50))
    posts = refbuild.postings(spark.createDataFrame(rows, ROWS))
    want = brute(rows)
    assert _told(graph.relationships(graph.strong_pair_sums(posts, block=4))) == {k: v for k, v in want.items() if v[0] > 1}
    some = spark.createDataFrame([(d,) for d in range(10)], "doc long")
    assert _told(graph.relationships(graph.strong_pair_sums(posts, among=some, block=4))) == {k: v for k, v in want.items() if v[0] > 1 and min(k) < 10}
    strong = {k: v for k, v in want.items() if v[1] > 0.25}
    assert any(v[0] == 1 for v in strong.values()) and _told(graph.relationships(graph.strong_pair_sums(posts, worth=0.149)).where("strength > 0.25")) == strong


def test_store_of_pairs_with_two_concepts_equals_a_rebuild(spark):
    rng = random.Random(3)
    folder = f"{shared_dir(spark)}/refs-{random.getrandbits(60):x}"
    first, then = _rows(rng, range(30)), _rows(rng, range(15, 45))
    for rows in (first, [r for r in first if r[0] is None or r[0] < 20] + [r for r in then if r[0] is not None and r[0] >= 20]):
        refbuild.refresh(spark, spark.createDataFrame(rows, ROWS), folder, 2)
        assert _told(refbuild.relationships(spark, folder, 2)) == {k: v for k, v in brute(rows).items() if v[0] > 1}
