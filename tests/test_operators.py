"""Operators on small literal fixtures, against plain-Python expectations."""

import math
import random
import time

from pyspark.sql import functions as F

from docsense.operators import graph, rules, scan, search, state, stats, tokens, usage, vectors, versions
from docsense.streaming import state as stream_state
from docsense.streaming.usage import drain


def test_usage_ranges():
    assert [usage.window_days(x) for x in ("7d", "30d", "90d", "1y", "2w", "3m", "12h", "soon")] == [7, 30, 90, 365, 14, 90, 1, 30]


def test_trend_directions(spark):
    rows = [("up", i, i * 3) for i in range(1, 6)] + [("flat", i, 4) for i in range(1, 6)] + [("one", 1, 9)] + [("down", i, 20 - 2 * i) for i in range(1, 6)]
    days = spark.createDataFrame(rows, "standard_id string, d int, uses long").select("standard_id", F.date_add(F.lit("2024-01-01"), F.col("d")).alias("day"), "uses")
    found = {r.standard_id: (r.direction, r.slope) for r in usage.trend(days).collect()}
    assert found == {"up": ("rising", 3.0), "flat": ("stable", 0.0), "one": ("stable", 0.0), "down": ("falling", -2.0)}


def test_nearest_rank_differs_from_linear(spark):
    points = spark.createDataFrame([("m", float(i)) for i in range(1, 11)], "name string, value double")
    r = stats.summary_nearest_rank(points, "name", "value").first()
    assert (r.p50, r.p95, r.p99) == (6.0, 10.0, 10.0)
    assert stats.summary_linear(points, "name", "value").first().median == 5.5


def test_trend_significance(spark):
    rng = random.Random(5)
    # The tail by the midpoint rule over the density.
    for t, df in ((0.5, 3), (2.1, 10), (3.0, 40), (0.0, 7)):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        inside = sum(c * (1 + ((i + 0.5) * t / 20_000) ** 2 / df) ** (-(df + 1) / 2) * t / 20_000 for i in range(20_000))
        assert math.isclose(stats.t_tail(t, df), 1 - 2 * inside, abs_tol=1e-7)
    rows = [("up", float(i), i + rng.random()) for i in range(20)] + [("flat", float(i), rng.random()) for i in range(20)] + [("two", 0.0, 1.0), ("two", 1.0, 2.0), ("same", 1.0, 3.0), ("same", 2.0, 3.0), ("same", 3.0, 3.0)]
    got = {r.k: r for r in stats.trend_significance(spark.createDataFrame(rows, "k string, x double, v double"), "k", "x", "v").collect()}
    assert got["up"].significant and got["up"].p < 1e-9 and not got["flat"].significant and 0.05 <= got["flat"].p <= 1
    assert got["two"].p is None and got["same"].p is None and not got["same"].significant


def test_metadata_score(spark):
    rows = spark.createDataFrame([("Safe API", None, ["api", "web", "api x"]), (None, None, None), ("none", "x", [])], "title string, author string, tags array<string>")
    score = search.metadata_score(["api", "safe"], {"title": F.col("title"), "author": F.col("author")}, {"tags": F.col("tags")})
    assert [r[0] for r in rows.select(score).collect()] == [1.0, 0.0, 0.0]
    only = search.metadata_score(["api"], {"title": F.col("title"), "author": F.col("author")})
    assert [r[0] for r in rows.select(only).collect()] == [1.0, 0.0, 0.0]


def test_outliers_zero_spread(spark):
    points = spark.createDataFrame([("m", 5.0)] * 10, "name string, value double")
    assert stats.outliers(points, "name", "value").where("by_iqr OR by_z OR by_mad").count() == 0


def test_rule_logic(spark):
    rows = spark.createDataFrame([("a", None, ["x"]), ("B", 3.0, ["y", "x"])], "name string, size double, tags array<string>")
    kinds = {"tags": "array", "size": "number"}
    hits = lambda tree: [r[0] for r in rows.where(rules.compile_tree(tree, kinds)).select("name").collect()]
    assert hits([]) == ["a", "B"]
    assert hits({"logic": "OR", "conditions": []}) == []
    assert hits({"field": "size", "operator": "not_equals", "value": 1}) == ["B"]
    assert hits({"logic": "NOT", "conditions": [{"field": "size", "operator": "greater_than", "value": 1}]}) == ["a"]
    assert hits({"field": "name", "operator": "equals", "value": "b", "case_sensitive": False}) == ["B"]
    assert hits({"field": "tags", "operator": "not_contains", "value": "y"}) == ["a"]
    assert hits({"field": "name", "operator": "matches_regex", "value": "B"}) == ["B"]


def test_priority_conflict(spark):
    table = [{"id": "low", "priority": 20, "standards": ["s1", "s2"], "conditions": []}, {"id": "high", "priority": 10, "standards": ["s2", "s3"], "conditions": []}]
    found = rules.matched(spark.range(1).withColumnRenamed("id", "k"), "k", rules.select_rules(table))
    assert rules.resolved(found, "k").count() == 3
    assert [(r.standard_id, r.rule_id, r.rules) for r in rules.conflicts(found, "k").collect()] == [("s2", "low", "high,low")]


def test_search_parts(spark):
    row = spark.createDataFrame([("Alpha beta. Gamma alpha delta. None here. ALPHA end",)], "text string")
    t, held = F.col("text"), search.tokens(F.col("text"))
    r = row.select(
        search.keyword_score(["alpha", "gam", "zzz"], held, t), search.position_score(["gamma"], held), search.proximity_score(["alpha", "gamma"], held), search.proximity_score(["alpha", "zzz"], held), search.highlights(t, ["alpha"]), search.boolean_factor(search.boolean_terms("alpha AND zzz"), held, t)
    ).first()
    assert r[0] == 0.5 and r[1] == 0.8 and math.isclose(r[2], math.exp(-0.2)) and r[3] == 0.0 and r[5] == 0.0
    assert r[4] == ["**Alpha** beta", "Gamma **alpha** delta", "**ALPHA** end"]
    assert search.boolean_terms("a AND b AND c OR d NOT e")["and"] == [("a", "b")]


def test_fuzzy(spark):
    words = spark.createDataFrame([("securty",)], "word string")
    vocabulary = spark.createDataFrame([("security",), ("secure",), ("unrelated",)], "token string")
    assert search.fuzzy_matches(words, vocabulary).first()[:3] == ("securty", "security", 93)


def test_packing_skips_and_goes_on(spark):
    items = spark.createDataFrame([("d", 1, 5), ("d", 2, 9), ("d", 3, 4)], "k string, rank int, tokens long").select("k", F.struct("rank", "tokens").alias("item"))
    r = tokens.pack(items, "k", 10).first()
    assert r.used == 9 and [x.rank for x in r.kept] == [1, 3]


def test_ivf_recall(spark):
    rng = random.Random(3)
    data = [(i, [rng.gauss(i % 5, 1) for _ in range(8)]) for i in range(300)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    q = v.where("vec_id < 20")
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(v, q, 5, "cosine").collect()}
    found = {(r.query_id, r.vec_id) for r in vectors.ivf_search(v, q, 5, cells=6, probes=4).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_ivf_recall_of_registered_query(spark):
    """The registered parameters on the given 64-dimensional vectors."""
    from docsense.plans import search as plans

    d = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(v, v.where("vec_id % 50 = 0"), 10, "cosine").collect()}
    found = {(r.query_id, r.vec_id) for r in plans.ivf_search(spark, d).collect()}
    assert len(exact) == 400 and len(found & exact) >= 0.9 * len(exact)


def test_principal_components(spark):
    v = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], "vec_id long, embedding array<double>")
    got = [r.projection[0] for r in vectors.principal_components(v, 1).orderBy("vec_id").collect()]
    assert math.isclose(abs(got[9] - got[0]), 9 * math.sqrt(5), rel_tol=1e-6) and abs(sum(got)) < 1e-6


def test_traversal_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reachable(edges, starts, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_versions(spark):
    row = spark.createDataFrame([("1.2.3",)], "v string")
    got = row.select(*[versions.next_version(F.col("v"), F.lit(x)) for x in ("MAJOR", "MINOR", "PATCH")]).first()
    assert tuple(got) == ("2.0.0", "1.3.0", "1.2.4")


def test_limiter_boundaries():
    assert state.replay(state.admit(10, 2), [0, 1, 2, 10, 10.5]) == [True, True, False, True, False]
    times = sorted(random.Random(1).uniform(0, 100) for _ in range(300))
    passed = [t for t, ok in zip(times, state.replay(state.admit(7, 4), times)) if ok]
    assert all(sum(a - 7 < b <= a for b in passed) <= 4 for a in passed)
    assert state.replay(state.admit_tiers([(10, 2), (100, 3)]), [0, 1, 2, 11, 12, 50]) == [True, True, False, True, False, False]
    assert state.replay(state.breaker(2, 10), [0, 1, 2, 3, 20], [True, True, True, True, False]) == ["closed", "closed", "open", "open", "half_open"]
    assert state.replay(state.cooldown(5, 10), [0, 5, 11, 30], [9, 9, 9, None]) == [True, False, True, False]
    assert state.replay(state.cache_hits(10), [0, 5, 11, 12]) == [False, True, False, True]


def _timeline(spark, first, last):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, i * 60 + rng.random()) for i in range(400)]
    return spark.createDataFrame(rows[first:last], "k long, event_id long, s double").select("k", "event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))


def test_fold_equals_replay(spark):
    events = _timeline(spark, 0, 400)
    got = {r.event_id: r.ok for r in state.fold(events, "k", state.admit(600, 3), "ok", "boolean").collect()}
    rows = events.select("k", "event_id", state.seconds(F.col("ts")).alias("t")).collect()
    for k in (1, 2, None):
        mine = sorted((r.t, r.event_id) for r in rows if r.k == k)
        assert [got[i] for _, i in mine] == state.replay(state.admit(600, 3), [t for t, _ in mine])
    assert len(got) == 400 and state.fold(events.limit(0), "k", state.admit(600, 3), "ok", "boolean").count() == 0


def test_stream_equals_fold(spark, tmp_path):
    for n, (a, b) in enumerate([(0, 150), (150, 400)]):
        _timeline(spark, a, b).where("k IS NOT NULL").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    events = _timeline(spark, 0, 400).where("k IS NOT NULL")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(stream_state.decide(stream, "k", state.admit(600, 3), "ok", "boolean"), str(tmp_path / "out"), str(tmp_path / "check"))
    want = {tuple(r) for r in state.fold(events, "k", state.admit(600, 3), "ok", "boolean").collect()}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("k", "event_id", "ok").collect()} == want and len(want) > 200


def test_scans(spark):
    files = spark.createDataFrame([("f", "<script>\nok\n<a href=\"http://x\" onclick=1>")], "k string, text string")
    assert {(r.line, r.rule_id) for r in scan.line_findings(files, "k", "text").collect()} == {(1, "script-tag"), (3, "inline-handler"), (3, "http-link")}
    code = spark.createDataFrame([("p", "password = 'longsecret1'\ntry:\n  eval('1')\nexcept:\n  pass"), ("bad", "def (")], "k string, code string")
    assert {(r.k, r.rule_id) for r in scan.python_findings(code, "k", "code").collect()} == {("p", "hard-coded-secret"), ("p", "dynamic-code"), ("p", "bare-except"), ("bad", "parse-error")}
    masked = spark.createDataFrame([("a b@c.org 123-45-6789",)], "t string").select(scan.mask(F.col("t"))).first()[0]
    assert masked == "a [email] [ssn]"
    assert spark.createDataFrame([("4111 1111 1111 1111",)], "n string").select(scan.luhn_valid(F.col("n"))).first()[0]
