"""Training-data operators: brute force, round trips, and edge cases (nulls, empty, ties, repeats, clashing columns)."""

import hashlib
import itertools
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docsense.llm import chat, common, components, decontaminate, licenses, mixing, privacy, quality, queries, simhash, topk, toxicity, training_order
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)
    return df.selectExpr("*", "1 AS fp", "'x' AS score", "2 AS component_id", "3 AS tokens", "0 AS total", "'k' AS key") if extra else df


EDGE = [(5001, "", "a"), (5002, None, "a"), (None, "some words here to read", None), (5004, "x", "b"), (5004, "x", "b"), (5005, "word " * 30000, "b"), (5006, "\n \t", "")]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_grams(text):
    held = (text or "").lower().split()
    return {tuple(held[i : i + 5]) for i in range(max(len(held) - 5, 0) + 1)}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    texts = base + [b.replace(" ", "  ", 1).upper() for b in base[:3]] + [b + " " + rng.choice(words) for b in base * 2] + ["", None, "é A b", "one two"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    prints = {i: brute_fingerprint(t) for i, t, _ in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    for segments in (2, 3, 4):
        got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs(spark, rows, True), segments=segments).collect()}
        assert got == {i: (prints[i], root(i)) for i in prints}
    kept = {r.doc_id for r in simhash.keep_first(docs(spark, rows, True)).collect()}
    assert kept == {root(i) for i in prints}


def test_keep_first_against_brute_force(spark):
    """Near copies by exact Jaccard index of five-word shingles, most of them beyond four bits."""
    rng = random.Random(11)
    words = ["w%d" % i for i in range(400)]
    texts = []
    for edits in (2, 4, 6, 8, 10, 12) * 3:
        base = [rng.choice(words) for _ in range(300)]
        for _ in range(4):
            copy = base[:]
            for at in rng.sample(range(300), edits // 2):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["one two", "One  two", "one two three", "", None, " \n"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]

    sets, parent = [brute_grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    missed = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
            missed += (brute_fingerprint(texts[a]) ^ brute_fingerprint(texts[b])).bit_count() > 4
    assert missed > 10
    kept = sorted(r.doc_id for r in simhash.keep_first(docs(spark, rows, True)).collect())
    assert kept == sorted({root(i) for i in range(len(texts))})
    assert simhash.keep_first(docs(spark, [])).count() == 0


def test_simhash_edges(spark):
    got = simhash.near_duplicates(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and simhash.near_duplicates(docs(spark, [])).count() == 0
    assert {r.component_id for r in got if r.doc_id in (5001, 5002, 5006)} == {5001}


def test_components_on_a_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_against_brute_force(spark):
    rng = random.Random(21)
    for nodes, edges in ((40, 25), (200, 260), (12, 0)):
        links = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
        parent = list(range(nodes))

        def root(i, parent=parent):
            return i if parent[i] == i else root(parent[i])

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        linked = {i for a, b in links if a != b for i in (a, b)}
        got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {i: root(i) for i in linked}


def brute_segments(scores):
    """Maximal segments by recursive splitting at the best segment."""
    if not scores:
        return []
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best[0] <= 0:
        return []
    a, n = -best[2], -best[1]
    left, right = brute_segments(scores[:a]), brute_segments(scores[a + n :])
    return left + [(a, a + n, best[0])] + [(x + a + n, y + a + n, s) for x, y, s in right]


def test_segments_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        values = [rng.choice([-1, -1, -1, 2, 1.5, -0.25]) + rng.random() / 1000 for _ in range(rng.randrange(1, 14))]
        fast = toxicity.segments(list(enumerate(values)), neutral=-9.0)
        assert [(a, b, round(s, 6)) for a, b, s in fast] == [(a, b, round(s, 6)) for a, b, s in brute_segments(values)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    plain = ["w%d" % i for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        junk = i % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(60, 160))]
        if toxic:
            for at in range(20, 30):
                words[at] = rng.choice(["nasty", "vile", "rotten"])
        rows.append((i, " ".join(w.upper() + "!!" if junk else w for w in words), "s"))
        labels.append((i, int(not junk), int(toxic)))
    return docs(spark, rows, True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


def test_toxicity_held_out(spark, labelled):
    d, labels, truth = labelled
    model = toxicity.fit(d, labels)
    got = d.select("doc_id", "text", toxicity.scorer(spark, model)(F.col("text")).alias("r")).collect()
    assert sum((r.r.score >= 0.7) == truth[r.doc_id][1] for r in got) >= 0.98 * len(got)
    shown = next(r for r in got if truth[r.doc_id][1])
    assert "nasty" in shown.text[shown.r.passages[0].start : shown.r.passages[0].end].lower()
    kept = toxicity.reject_toxic(d, labels)
    assert kept.columns == d.columns and 430 <= kept.count() <= 470


def test_toxicity_passages_stand_in_the_original():
    model = toxicity.Model({"nasty": 4.0, "vile": 4.0, "ışık": -1.0}, 1.0, 0.1, 1.0, -3.0)
    text = "\u0130stanbul is a town. NASTY vile nasty nasty VILE words end"
    score, n, found = toxicity.passages(text, model)
    assert [text[a:b] for a, b, _ in found] == ["NASTY vile nasty nasty VILE"] and n == 11
    repeated = toxicity.passages("a b c " + "nasty " * 5, model)[0]
    assert repeated == toxicity.passages("a b c nasty vile nasty vile nasty", model)[0]


def test_samples_are_bounded_by_rows(spark):
    many = docs(spark, [(1, f"text {i}", "s") for i in range(500)] + [(i, "x", "s") for i in range(2, 60)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    assert common.labelled_sample(many, labels, "toxic", 3, 1, 20).count() <= 20


def test_empty_and_hostile_tables(spark, labelled):
    _, labels, _ = labelled
    none = docs(spark, [], True)
    assert toxicity.reject_toxic(none, labels).count() == 0
    forest = quality.fit(none, labels)
    edge = docs(spark, EDGE, True)
    scores = [r[0] for r in edge.select(quality.scorer(spark, forest)(F.col("text"))).collect()]
    assert len(scores) == len(EDGE) and set(scores) == {0.5}
    toxic = spark.createDataFrame([(5004, 1, 1), (5005, 1, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.reject_toxic(edge, toxic)
    assert {r.doc_id for r in kept.collect()} >= {5001, 5002, 5006}  # no words, nothing toxic in them


def test_toxicity_and_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, EDGE)
    assert toxicity.reject_toxic(d, none).count() == len(EDGE)
    forest = quality.fit(d, none)
    assert {r[0] for r in d.select(quality.scorer(spark, forest)(F.col("text"))).collect()} == {0.5}


def test_quality_held_out(spark, labelled):
    d, labels, truth = labelled
    forest = quality.fit(d, labels)
    got = d.select("doc_id", quality.scorer(spark, forest)(F.col("text")).alias("s")).collect()
    assert all((r.s >= 0.7) == truth[r.doc_id][0] and 0 <= r.s <= 1 for r in got)


def test_forest_traversal_equals_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    forest = quality.grow(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=10, depth=3)

    def walk(row):
        total = forest.base
        for t in range(10):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            total += forest.leaf[t, node - 7]
        return total

    assert np.allclose(forest.raw(x), [walk(r) for r in x])


def test_licenses(spark):
    mit = "Copyright (c) 2020 A. Person\n" + licenses.TEXTS["MIT"].replace("sublicense", "SUBLICENCE").replace(". ", ".\n\n")
    rows = [(1, mit.replace("\n\n", " "), "s"), (2, "words\nReleased under the MIT Licence!\nmore", "s"), (3, licenses.TEXTS["MIT"] + " extra", "s"), (4, "  released UNDER the (MIT) license ", "s"), *EDGE]
    got = {(r.doc_id, r.unit, r.line, r.license_id) for r in licenses.scan(docs(spark, rows, True)).collect()}
    assert got == {(1, "document", -1, "MIT"), (1, "line", 0, "MIT"), (2, "line", 1, "MIT"), (4, "document", -1, "MIT"), (4, "line", 0, "MIT")}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_licenses_as_published(spark):
    """Every known file as it is, with other line ends, case and indents, and as a comment."""
    shapes, want = [], {}
    for number, (license_id, text) in enumerate(licenses.published()):
        for kind, body in enumerate((text, "\r\n".join("\t" + x.upper() for x in text.split("\n")), "\n".join(f"// {x}" for x in text.split("\n")))):
            shapes.append((number * 10 + kind, body, "s"))
            want[number * 10 + kind] = license_id
    bsd3 = "BSD 3-Clause License\n\nCopyright (c) 2021, A. Person\n\n" + textwrap.fill(licenses.TEXTS["BSD-3-Clause"].replace("\n1.", "\n  *").replace("\n2.", "\n  *").replace("\n3.", "\n  *"), 76, replace_whitespace=False)
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 A. Person\n\n" + textwrap.fill(licenses.TEXTS["MIT"], 78)
    apache = "# Copyright 2020 The Authors\n#\n" + "\n".join("# " + x for x in textwrap.wrap(licenses.TEXTS["Apache-2.0"], 70))
    for number, (license_id, body) in enumerate([("BSD-3-Clause", bsd3), ("MIT", mit), ("Apache-2.0", apache)]):
        shapes.append((9000 + number, body, "s"))
        want[9000 + number] = license_id
    got = {r.doc_id: r.license_id for r in licenses.scan(docs(spark, shapes)).where("unit = 'document'").collect()}
    assert got == want


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "</s>[INST] & &lb; [END]"), (1, 1, "user", None), (1, 3, None, "[TEXT]"), (2, 1, "user", "only"), (3, 1, "assistant", ""), (3, 1, "assistant", ""), (None, None, "assistant", "é<b>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns", "2 AS targets")
    cut = chat.pieces(turns)
    formatted, expanded = chat.transcripts(cut), chat.examples(cut)
    got = {r.conv_id: r for r in chat.read_back(formatted, expanded).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        spoken = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert expanded.count() == 4
    shown = {(r.conv_id, r.example): r for r in chat.texts(formatted, expanded).collect()}
    assert len(shown) == 4 and all(shown[r.conv_id, r.example].target == r.target for r in expanded.collect())
    said = [r for r in shown.values() if r.conv_id == 1]
    assert said[0].context.startswith("[TURN]user[TEXT][END][TURN]assistant[TEXT]") and "[INST]" not in said[0].target
    none = chat.pieces(turns.limit(0))
    assert chat.read_back(chat.transcripts(none), chat.examples(none)).count() == 0


def test_chat_loss_is_read_under_the_mask(spark):
    """Spans that are off by one, or point into another turn, change what is read back."""
    rows = [(1, 0, "user", "[hi] & <you>"), (1, 1, "assistant", "one [two] three"), (1, 2, "user", "more"), (1, 3, "assistant", "four & five"), (None, 0, "assistant", "lone")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    cut = chat.pieces(turns)
    told, spans = chat.transcripts(cut), chat.examples(cut)
    digest = lambda expanded: {r.conv_id: (r.loss_sha256, r.loss_chars) for r in chat.read_back(told, expanded).collect()}
    right = digest(spans)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert right == {1: (sha("one [two] threefour & five"), 26), None: (sha("lone"), 4)}
    for change in ({"target_start": F.col("target_start") + 1}, {"target_end": F.col("target_end") - 1}, {"target_start": F.col("target_start") - 1, "target_end": F.col("target_end") - 1}, {"context_end": F.col("context_end") + 1}):
        assert digest(spans.withColumns(change))[1] != right[1]


def test_chat_long_conversation(spark):
    """Cost grows with the turns, not with their square: 16,000 turns in seconds."""
    n = 16_000
    turns = spark.range(n).selectExpr("cast(1 AS long) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('w[', 20) || id AS text")
    cut = chat.pieces(turns)
    began = time.monotonic()
    row = chat.read_back(chat.transcripts(cut), chat.examples(cut)).first()
    assert time.monotonic() - began < 15
    loss = "".join("w[" * 20 + str(i) for i in range(1, n, 2))
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (n, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_topk_against_brute_force(spark):
    rng = random.Random(4)
    data = [(i, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(6)]) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(60)]
    bad = [(900, None), (901, [1.0, None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0]), (905, [])]
    v = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS w", "2 AS shard", "3 AS block")
    got = {}
    for r in topk.search(v, v.where("vec_id % 20 = 0"), 5, shard_rows=100, query_rows=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ints = {i: [int(np.floor(64 * x)) for x in e] for i, e in [*data, (904, [1.0]), (905, [])]}
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert topk.search(v.limit(0), v, 5).count() == 0


@pytest.mark.parametrize("scale", [1.0, 2.0**8, 2.0**12, 2.0**34])
def test_topk_is_exact_for_large_weights(spark, scale):
    """Sums beyond 2**53 and 2**63, and a query whose weights are larger than any candidate's."""
    rng = random.Random(3)
    candidates = [(i, [rng.randrange(-(1 << 12), 1 << 12) * scale / 64 for _ in range(5)]) for i in range(200)]
    query = (1000, [(1 << 20) + 1 / 64, 3.0, -5.0 - 1 / 64, float(1 << 34), 1.0])
    c, q = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (candidates, [query, candidates[7]]))
    ints = lambda e: [int(np.floor(64 * x)) for x in e]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(c, q, 7, shard_rows=64).collect()}
    for i, e in (query, candidates[7]):
        scores = [(min(max(sum(a * b for a, b in zip(ints(e), ints(w))), -(1 << 63)), (1 << 63) - 1), j) for j, w in candidates if j != i]
        assert [got[i, n + 1] for n in range(7)] == [(j, s) for s, j in sorted(scores, key=lambda x: (-x[0], x[1]))[:7]]


def test_topk_repeated_ids_spread(spark):
    v = spark.range(3000).selectExpr("5 AS vec_id", "array(1.0D, 2.0D) AS embedding").unionAll(spark.range(10, 12).selectExpr("id", "array(1.0D, 0.0D)"))
    got = topk.search(v, v.where("vec_id = 10"), 3, shard_rows=100).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(i, 5, 4096) for i in (1, 2, 3)]


def brute_containment(d, b):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    return sorted((i, k, len(shingles(t) & shingles(q))) for i, t, _ in d for k, q in b if shingles(q) and len(shingles(t) & shingles(q)) >= 0.8 * len(shingles(q)))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(8)
    words = ["t%d" % i for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 5, 6, 9, 15, 30, 57, 200]))) for i in range(60)] + [(99, None), (98, "")]
    rows = [(i, text(rng.randrange(50, 3000)), "s") for i in range(60)]
    for i, (_, q) in enumerate(bench[:50]):
        w = (q or "").split()
        if i % 3 == 0 and len(w) > 20:
            w[len(w) // 2] = "changed"
        body = rows[i][1].split()
        at = rng.randrange(len(body))
        rows[i] = (i, " ".join(body[:at] + [x.upper() + "," for x in w] + body[at:]), "s")
    rows += [*EDGE, (70, bench[1][1], "s")]
    d, b = docs(spark, rows, True), spark.createDataFrame(bench, "item_id long, text string")
    found = [(r.doc_id, r.item_id, r.shared) for r in decontaminate.contained_items(d, b).collect()]
    assert Counter(found) == Counter(brute_containment(rows, bench)) and len(found) > 30
    hit = {i for i, _, _ in found}
    kept = decontaminate.remove_contaminated(d, b)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _, _ in rows if i not in hit) and kept.columns == d.columns
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0 and decontaminate.contained_items(d.limit(0), b).count() == 0
    # A benchmark of a hundred times the size finds the same for these items.
    more = spark.createDataFrame([(1000 + i, text(30)) for i in range(6000)], "item_id long, text string")
    again = [(r.doc_id, r.item_id, r.shared) for r in decontaminate.contained_items(d, b.unionAll(more)).collect()]
    assert Counter(x for x in again if x[1] < 1000) == Counter(found)


def test_decontamination_filter_size(spark):
    index = decontaminate.index_table(spark.read.parquet(f"{SF}/benchmark.parquet"))
    known = decontaminate.filters(index)
    assert known.keys.words.nbytes + known.shingles.words.nbytes <= 1 << 20
    keys = np.array([k for r in index.collect() for k in r["keys"]], np.int64).view(np.uint64)
    assert len(known.keys.holds(keys)) == len(keys)
    assert len(known.keys.holds(np.random.default_rng(1).integers(0, 1 << 63, 100_000, dtype=np.uint64))) < 100


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 7), "big") for i in range(900)] + [(1000 + i, "a b c", "small") for i in range(60)] + EDGE[:4]
    d = docs(spark, rows, True)
    for target in (mixing.Target(repetitions=2.0), mixing.Target(entropy=0.6), mixing.Target(repetitions=1.0)):
        plan = {r.source: r for r in mixing.source_plan(d, target).collect()}
        assert all(r.budget >= r.total for r in plan.values())
        if target.repetitions:
            assert all(r.budget <= target.repetitions * r.total + 1 for r in plan.values())
        order = mixing.mix_order(d, target, block_tokens=500).collect()
        used = Counter((r.doc_id, r["pass"]) for r in order)
        assert max(used.values()) == 1
        uses = Counter(r.doc_id for r in order)
        assert uses == Counter(r.doc_id for r in mixing.mix(d, target).collect())
        assert set(uses) == {i for i, _, _ in rows}
        for source, r in plan.items():
            spent = sum(x.tokens for x in order if x.source == source)
            assert r.budget <= spent < r.budget + 10
        blocks = Counter(r.block for r in order)
        assert all(sorted(x.position for x in order if x.block == b) == list(range(1, n + 1)) for b, n in blocks.items())
    assert mixing.mix(d, mixing.Target(repetitions=2.0)).columns == d.columns
    assert mixing.mix_order(docs(spark, []), mixing.Target(repetitions=2.0)).count() == 0
    shares = [p**0.5 for p in (0.9, 0.1)]
    h = -sum(x / sum(shares) * np.log(x / sum(shares)) for x in shares)
    totals = spark.createDataFrame([("a", 900), ("b", 100)], "source string, total long")
    assert abs(mixing.bisect_exponent(totals, mixing.Target(entropy=float(h))) - 0.5) < 1e-9


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_bijection(n):
    index = np.arange(n, dtype=np.uint64)
    slots = training_order.permute(index, n)
    assert sorted(slots.tolist()) == list(range(n)) and (training_order.unpermute(slots, n) == index).all()
    if n > 100:
        assert (training_order.permute(index, n, 7) != slots).mean() > 0.9


def test_training_order_round_trip(spark, tmp_path):
    rows = [(i, f"Text number {i} " * (i % 40), "s") for i in range(80)] + EDGE
    ordered = training_order.training_order(docs(spark, rows, True), length=16, shard_rows=32)
    got = ordered.collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and {len(r.tokens) for r in got} == {32}
    encoding, end = training_order.tokenizer(training_order.TOKENIZER)
    by_doc = {}
    for r in sorted(got, key=lambda r: r.part):
        by_doc.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u2")[: r.n_tokens].tolist())
    for i, t, _ in rows:
        if i != 5004:
            assert by_doc[i][-1] == end and encoding.decode(by_doc[i][:-1]) == (t or "")
    folder = f"file://{tmp_path}/shards"
    for _ in range(2):
        manifest = training_order.write_shards(ordered, folder).collect()
    assert sum(m.rows for m in manifest) == len(got)
    want = np.array([np.frombuffer(r.tokens, "<u2") for r in sorted(got, key=lambda r: r.slot)])
    assert (training_order.read_slots(folder, 20, 70, 16, 32) == want[20:90]).all()
    assert (training_order.read_slots(folder, 0, 10**6, 16, 32) == want).all()
    assert training_order.training_order(docs(spark, [])).count() == 0
    # The order is one of the documents, not of the files they come in.
    d = docs(spark, rows, True)
    again = training_order.training_order(d.orderBy(F.desc("text")).repartition(5), length=16, shard_rows=32).collect()
    assert sorted((r.slot, r.tokens) for r in again) == sorted((r.slot, r.tokens) for r in got)
    by_text = sorted(((i is not None, i or 0, hashlib.sha256(t.encode()).hexdigest() if t is not None else ""), i) for i, t, _ in rows)
    index = {}
    for r in got:
        index.setdefault(int(training_order.unpermute(np.array([r.slot], np.uint64), len(got))[0]), (r.doc_id, r.part))
    assert list(dict.fromkeys(index[i][0] for i in range(len(got)))) == list(dict.fromkeys(i for _, i in by_text))


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and privacy.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_patterns_against_plain_regex():
    rng = random.Random(6)
    bits = ["a", "Z9", ".", "..", "@", "-", "+", " ", "1", "255", "256", "007", "4111 1111 1111 1111", "(2)", "x.y", "é", "%", "\n", "_", "0"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))
        assert privacy.base_spans(text) == brute_spans(text), text
    assert privacy.base_spans(None) == [] and privacy.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []


def test_pii_disclosure(spark):
    filler = ["common words fill this text number %d" % i for i in range(200)]
    secret = "agent zorblat7 quix of common words wrote from who@corp.example.com about the words"
    rows = [(i, t, "s") for i, t in enumerate(filler)] + [(500, secret, "s"), (501, secret + " again", "s"), *EDGE]
    d = docs(spark, rows, True)
    got = {r.doc_id: r for r in privacy.find(d).collect() if r.n_email}
    terms = {secret[int(a) : int(b)] for k, a, b in (x.split(":") for x in got[500].spans.split(",")) if k == "term"}
    assert "zorblat7" in terms and "quix" in terms and "common" not in terms and "words" not in terms
    assert got[500].base_sha256 == hashlib.sha256(got[500].base.encode()).hexdigest() and got[500].spans.startswith(got[500].base)
    clean = {r.doc_id: r.text for r in privacy.sanitise(d).collect()}
    assert {r.doc_id: r.sanitised for r in privacy.find(d).collect()}[500] == clean[500]
    assert "[EMAIL]" in clean[500] and "zorblat7" not in clean[500] and "quix" not in clean[500] and clean[0] == filler[0]
    assert privacy.find(d).count() == len(rows) and privacy.find(docs(spark, [])).count() == 0


def test_pii_against_brute_force(spark):
    """Terms by pointwise mutual information over whole documents, marked wherever they occur."""
    rng = random.Random(12)
    common_words = ["v%d" % i for i in range(600)]
    said = lambda n: [rng.choice(common_words) for _ in range(n)]
    texts = [" ".join(said(60)) for _ in range(400)]
    copied = [*said(80), "twin@corp.example.com"]  # near copies of one text prove nothing
    texts += [" ".join([*copied[:k], "rareword", *copied[k + 1 :]]) for k in range(0, 20, 4)]
    for k in range(6):
        mail, name = f"who{k}@corp.example.com", f"\u0130zor{'abcdef'[k]}blat"
        for _ in range(2 + k % 3):
            texts.append(" ".join([name, *said(50), mail, *said(30)]))  # the name far from the address
        texts.append(" ".join([*said(10), name.upper(), *said(5)]))  # and without it
    texts += [texts[420]] * 3 + ["", "api_key = 'a1b2c3d4e5f6a7b8'"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    word = re.compile(r"[^\W_]+")
    held = []
    for t in texts:
        spans = brute_spans(t)
        held.append(({t[a:b] for _, a, b in spans}, {m[0].lower() for m in word.finditer(t)}, {m[0].lower() for m in word.finditer(t) if not any(a < m.end() and m.start() < b for _, a, b in spans)}))
    n, marked = len(texts), set()
    for e in {e for es, _, _ in held for e in es}:
        n_e = sum(e in es for es, _, _ in held)
        sets = list({t: ws for t, (es, _, ws) in zip(texts, held) if e in es}.values())
        if len(sets) ** 2 / sum(len(a & b) / len(a | b) for a in sets for b in sets) < privacy.INDEPENDENT:
            continue
        for w in set().union(*[ws for es, _, ws in held if e in es]):
            if len({t for t, (es, _, ws) in zip(texts, held) if e in es and w in ws}) >= privacy.SUPPORT:
                n_te, n_t = sum(e in es and w in ws for es, _, ws in held), sum(w in ws for _, ws, _ in held)
                if np.log(n * n_te / (n_t * n_e)) >= -np.log(n_e / n) / privacy.ALPHA:
                    marked.add(w)
    assert {f"\u0130zor{'abcdef'[k]}blat".lower() for k in range(6)} <= marked and "rareword" not in marked
    for r in privacy.find(docs(spark, rows, True)).collect():
        t = texts[r.doc_id]
        want = sorted((m.start(), m.end()) for m in word.finditer(t) if m[0].lower() in marked and not any(a < m.end() and m.start() < b for _, a, b in brute_spans(t)))
        assert [(int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"] == want
        assert r.n_secret == ("api_key" in t) and "blat" not in r.sanitised and "a1b2c3" not in r.sanitised


def test_pipeline_against_operators(spark):
    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    current = docs_in
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, SF)
        assert after.columns == docs_in.columns, name
        current = after
    kept = {r.doc_id for r in current.select("doc_id").distinct().collect()}
    out = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert out == kept
    model = toxicity.fit(docs_in, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs_in.collect()}
    calm = {i for i, t in texts.items() if toxicity.passages(t, model)[0] < toxicity.THRESHOLD}
    sets = {i: brute_grams(texts[i]) for i in sorted(calm)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_gram = {}
    for i, grams in sets.items():
        for g in grams:
            by_gram.setdefault(g, []).append(i)
    for a, b in {p for held in by_gram.values() for p in itertools.combinations(held, 2)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    first = {root(i) for i in sets}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i, _, _ in brute_containment([(i, texts[i], "") for i in first], bench)}
    assert out == first - dirty


def test_registered_names():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
