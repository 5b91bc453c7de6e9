"""Pruned keyword search against brute force, and how little of the common words' postings it reads."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docsense.operators import overlap, tokens

DOCS, QUERIES = "doc long, words array<string>", "query long, words array<string>"


def brute(queries, docs, k, above):
    out = []
    for q, sought in queries:
        sought = {w for w in sought or [] if w is not None}
        if q is None or not sought:
            continue
        hits = {}
        for d, words in docs:
            if d is not None and words is not None:
                hits[d] = max(hits.get(d, 0), len(sought & set(words)))
        best = sorted((-h, d) for d, h in hits.items() if h)[:k]
        out += [(q, d, round(-h / len(sought), 6), i) for i, (h, d) in enumerate(best, 1) if round(-h / len(sought), 6) > above]
    return sorted(out)


def _zipf(rng, n):
    return [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(n)]


@pytest.mark.parametrize("k, above", [(1, 0.0), (5, 0.05), (10, 0.4), (1000, 0.0)])
def test_best_against_brute_force(spark, k, above):
    rng = random.Random(k)
    docs = [(i, _zipf(rng, rng.randrange(0, 60))) for i in range(250)] + [(7, ["w1", "only"]), (None, ["w1"]), (900, None), (901, []), (902, [None, "w2", "w2"])]
    queries = [(i, _zipf(rng, rng.randrange(1, 25))) for i in range(30)] + [(90, ["unknown", "w1"]), (91, ["unknown"]), (92, []), (93, None), (None, ["w1"]), (94, ["w1", "w1", None])]
    df = spark.createDataFrame(docs, DOCS).withColumn("token", F.lit("x")).repartition(4)
    found = overlap.best_by_overlap(spark.createDataFrame(queries, QUERIES).withColumn("n", F.lit(1)), df, k, above)
    assert sorted(tuple(r) for r in found.collect()) == brute(queries, docs, k, above)
    assert overlap.best_by_overlap(spark.createDataFrame(queries, QUERIES), df.limit(0), k, above).count() == 0


def test_common_words_are_not_joined(spark, monkeypatch):
    """Every document holds the ten common words; with ten good candidates a query none of their postings is read."""
    rng = random.Random(2)
    common = [f"common{i}" for i in range(10)]
    docs = [(i, common + [f"rare{i // 12}-{j}" for j in range(20)] + [f"own{i}"]) for i in range(600)]
    queries = [(q, common + [f"rare{q}-{j}" for j in rng.sample(range(20), 10)]) for q in range(20)]
    read = []
    real = overlap._candidates
    monkeypatch.setattr(overlap, "_candidates", lambda words, held: read.append(words.select("token").distinct().collect()) or real(words, held))
    got = overlap.best_by_overlap(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(docs, DOCS), 10).collect()
    assert sorted(tuple(r) for r in got) == brute(queries, docs, 10, 0.0)
    assert len(read) == 2 and not any(r.token.startswith("common") for rows in read for r in rows)


@pytest.mark.parametrize("counters", [1, 3, 1 << 20])
def test_top_phrases_by_counters(spark, monkeypatch, counters):
    """However many phrases share a counter, the best are those of counting all; a look at too few counters is made up for."""
    monkeypatch.setattr(tokens, "COUNTERS", counters)
    monkeypatch.setattr(tokens, "FIRST_LOOK", 1 if counters == 3 else 4)
    rng = random.Random(counters)
    texts = [" ".join(rng.choice("abcd") * rng.choice((1, 4)) for _ in range(rng.randrange(30))) for _ in range(80)] + [None, "", "x y"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = Counter(g for t in texts if t for w in [t.split()] for i in range(len(w) - 2) if len(g := " ".join(w[i : i + 3])) > 6)
    for k in (5, 100_000):
        want = sorted(((g, n) for g, n in counts.items() if n >= 2), key=lambda x: (-x[1], x[0]))[:k]
        assert [tuple(r) for r in tokens.top_phrases(docs, 3, 2, k, 6).collect()] == want
    assert tokens.top_phrases(docs.limit(0), 3, 2, 5).count() == 0


def test_relevance_reads_texts_in_place(spark, monkeypatch, tmp_path):
    """The relevant pairs are made once, without a shuffle of texts, and are those whose text holds the passage."""
    from docsense.plans import search as plans

    docs = [(1, "The Elephants walk far"), (2, "elephants run"), (3, None), (4, "we saw the elephants WALK far away"), (4, "the elephants walk far"), (5, "walk far")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "the elephants walk far"), (8, "lions")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = []
    monkeypatch.setattr(plans, "staged", lambda df, name: made.append(df) or df, raising=False)
    found = plans.ir_metrics(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in made[0].collect()) == [(7, 1), (7, 4), (7, 4)] and [r.query for r in found] == [7]
    assert "Exchange hashpartitioning(doc_id" not in made[0]._jdf.queryExecution().executedPlan().toString()
