"""Operators 11 to 13 against brute force, hostile rows, broken archives; the registered queries of all operators."""

import hashlib
import io
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from docsense.llm import phrases, queries, trie, warc
from docsense.llm.common import table
from tests.conftest import SF

# Operator 11


def brute_pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute_phrases(rows, support=10, top=2000):
    out = []
    by_lang = defaultdict(list)
    for lang, text in rows:
        by_lang["und" if lang is None else lang] += brute_pieces(text)
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(c for g, c in f.items() if len(g) == 1)
        held = {g: c for g, c in f.items() if len(g) > 1 and c >= support}
        found = []
        for g, a in held.items():
            if any(len(t) > len(g) and 100 * c >= 50 * a and any(t[i : i + len(g)] == g for i in range(len(t))) for t, c in held.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def _corpus(seed, docs, words):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(12)] + ["Éa", "éA", "the", "THE", "a\xa0b", "x\x1cy", ""]
    rows = []
    for _ in range(docs):
        text = "".join(rng.choice(vocabulary) + rng.choice([" "] * 8 + ["\t", "  ", ". ", "\n", "!", "\r\n", "\x0b"]) for _ in range(rng.randrange(words)))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, " \n\t."), ("xx", "lone"), ("fr", "copy of this line " * 30)] + [("en", "same words here")] * 12


def _frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").selectExpr("*", "1 AS a", "'x' AS phrase", "2 AS n", "0 AS key", "3 AS shard").repartition(7, "doc_id")


def test_collocations_against_brute_force(spark):
    rows = _corpus(3, 150, 200)
    got = sorted(tuple(r) for r in phrases.collocations(_frame(spark, rows)).collect())
    want = brute_phrases(rows)
    assert got == want and len(want) > 40 and {"und", "en", "fr"} <= {r[0] for r in want}


def test_collocations_first_ranks_and_low_support(spark):
    rows = _corpus(4, 30, 60)
    got = sorted(tuple(r) for r in phrases.collocations(_frame(spark, rows), support=3, top=5).collect())
    assert got == brute_phrases(rows, 3, 5)


def test_collocations_of_nothing(spark):
    df = _frame(spark, [("en", "a b")])
    assert phrases.collocations(df.limit(0)).count() == 0 and phrases.collocations(df).count() == 0
    assert phrases.collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("chunk, window", [(3, 7), (50, 20), (10**6, 1 << 20)])
def test_phrases_across_chunks_and_windows(monkeypatch, chunk, window):
    """Whatever is numbered at once, every place counts once: also in a text much longer than a chunk."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    monkeypatch.setattr(phrases, "WINDOW", window)
    rows = _corpus(chunk, 12, 80) + [("en", "long text of words, " * 200)]

    class All:
        value = property(lambda self: self)

        def holds(self, keys):
            return np.arange(len(keys))

    batch = pa.RecordBatch.from_pylist([{"lang": "und" if a is None else a, "text": b or ""} for a, b in rows])
    got = Counter()
    for out in phrases._over_chunks(phrases._counter(All()))([batch]):
        for r in out.to_pylist():
            got[r["lang"], r["words"], r["phrase"]] += r["n"]
    want = Counter()
    for lang, text in rows:
        for p in brute_pieces(text):
            lang = "und" if lang is None else lang
            want[lang, 0, ""] += len(p)
            want.update((lang, k, " ".join(p[i : i + k])) for k in (1, 2, 3) for i in range(len(p) - k + 1))
    assert {k: v for k, v in got.items() if v} == dict(want)


def test_scores_beyond_64_bits(spark):
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    row = spark.range(1).select(F.lit(a).alias("a"), F.lit(left).alias("x"), F.lit(right).alias("y")).select(phrases._score("a", "x", "y").alias("s")).first()
    assert row.s == 1000000 * a * a // (left * right)


# Operator 12

PAGES = "page_id long, url string, html string"


def brute_pages(rows):
    held = defaultdict(list)
    for page_id, _, html in rows:
        held[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        largest = max((i for i in held[html or ""] if i is not None), default=None)
        revisit = len(body) >= 1000 and largest is not None and page_id != largest
        out.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=repr)


def _pages():
    rng = random.Random(2)
    big = ["<p>" + "é%d " % i * 300 for i in range(6)]
    rows = [(i, f"http://h/{i}?q=ü x\r\nInjected: yes", rng.choice(big)) for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "u", "short"), (103, "u", "short"), (104, "u", "a" * 999), (105, "u", "a" * 999), (106, "u", "a" * 1000), (107, "u", "a" * 1000)]
    return rows + [(None, "u", "b" * 2000), (None, "v", "b" * 2000), (108, "u", "c" * 2000), (None, "u", "c" * 2000), (109, "r", "d" * 1500), (109, "r", "d" * 1500), (3, "r", "d" * 1500), (200, "u", "z\r\n\r\nWARC/1.1\r\n" * 200_000)]


def test_warc_round_trip(spark):
    rows = _pages()
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS kept", "'x' AS key", "2 AS n", "'y' AS path", "3 AS records").repartition(5)
    got = sorted((tuple(r) for r in warc.round_trip(spark, df).collect()), key=repr)
    assert got == brute_pages(rows) and sum(r[3] == "revisit" for r in got) > 30
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_rolls_and_returns_payloads(spark):
    """Several archives a task, joined duplicates, and every response's payload as it was."""
    rows = _pages()[:40]
    df = spark.createDataFrame(rows, PAGES).repartition(2)
    folder = f"{warc.shared_dir(spark)}/warc-rolled-{random.getrandbits(60):x}"
    manifest = warc.materialise(warc.write(warc.planned(df), folder, warc.dictionary_of(df), roll=200_000 // 64), "rolled")
    assert manifest.count() > 2 and manifest.agg(F.sum("records")).first()[0] == 40
    found = warc.read(manifest).collect()
    texts = {i: t for i, _, t in rows}
    assert sorted(r.page_id for r in found) == sorted(texts)
    assert all(bytes(r.payload).decode() == texts[r.page_id] for r in found if r.record_type == "response")
    assert all(r.url.startswith("http://h/") and "\n" not in r.url for r in found)
    assert not list(spark.read.format("binaryFile").load(folder).where("path rlike '/[.]'").collect())


def test_warc_copies_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_COPIES", 0)
    rows = _pages()[:60]
    got = sorted((r.page_id, r.refers_to) for r in warc.planned(spark.createDataFrame(rows[:48], PAGES)).collect())
    assert got == sorted((r[0], r[4]) for r in brute_pages(rows[:48]))


def _archive(records, dictionary=b"", leading=None, **options):
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    return (warc.preamble(dictionary) if leading is None else leading) + b"".join(pack.compress(r) for r in records)


def _read(data):
    return [(r.kind, warc.payload_of(r, at)) for at, r in warc.records(io.BytesIO(data))]


def test_warc_reader_of_other_writers(monkeypatch):
    """A raw dictionary, one frame a record, repeated headers, windows smaller than a frame."""
    monkeypatch.setattr(warc, "WINDOW", 17)
    raw = b"common words of pages " * 40
    records = [warc.encode(i, "http://x", b"common words of pages %d" % i * 50) for i in range(5)]
    records[2] = records[2].replace(b"WARC-Date:", b"WARC-Concurrent-To: <a>\r\nWARC-Concurrent-To: <b>\r\nWARC-Date:", 1)
    data = _archive(records, raw, warc.SKIPPABLE + struct.pack("<I", len(raw)) + raw)
    assert [p[2] for _, p in _read(data)] == [b"common words of pages %d" % i * 50 for i in range(5)]
    assert _read(_archive(records, raw)) == _read(data) and _read(_archive([], raw)) == []


def _changed(old, new):
    record = warc.encode(1, "u", b"payload " * 200)
    assert old in record
    return _archive([record.replace(old, new, 1)])


BROKEN = {
    "no dictionary frame": lambda: _archive([warc.encode(1, "u", b"x")])[12:],
    "dictionary cut short": lambda: warc.SKIPPABLE + struct.pack("<I", 99) + b"abc",
    "ends within a frame": lambda: _archive([warc.encode(1, "u", b"payload " * 200)])[:-6],
    "flipped byte": lambda: (d := bytearray(_archive([warc.encode(1, "u", bytes(range(256)) * 8)])), d.__setitem__(-40, d[-40] ^ 255), bytes(d))[2],
    "no version": lambda: _changed(b"WARC/1.1", b"WORC/1.1"),
    "no record id": lambda: _changed(b"WARC-Record-ID", b"WARC-Record-XX"),
    "two lengths": lambda: _changed(b"WARC-Date: ", b"Content-Length: 5\r\nWARC-Date: "),
    "length too small": lambda: _changed(b"\r\nContent-Length: 1", b"\r\nContent-Length: 0"),
    "length is no number": lambda: _changed(b"\r\nContent-Length: 1", b"\r\nContent-Length: +1"),
    "line without a name": lambda: _changed(b"WARC-Date: ", b"nothing here\r\nWARC-Date: "),
    "payload changed": lambda: _changed(b"payload payload", b"PAYLOAD payload"),
    "end missing": lambda: _archive([warc.encode(1, "u", b"x")[:-2]]),
    "no http": lambda: _changed(b"HTTP/1.1 200", b"HXXP/1.1 200"),
    "revisit without a response": lambda: _archive([warc.encode(1, "u", b"x" * 2000, 7, True).replace(b"WARC-Refers-To", b"WARC-Refers-XX")]),
    "revisit with a payload": lambda: _archive([warc.encode(1, "u", b"x" * 2000).replace(b"WARC-Type: response", b"WARC-Type: revisit")]),
}


@pytest.mark.parametrize("fault", BROKEN)
def test_warc_faults_are_told(fault):
    with pytest.raises(warc.Broken):
        _read(BROKEN[fault]())


# Operator 13


def brute_trie(conversations):
    """Nodes of {conv_id: [(role, text)]} by every prefix."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, held in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        ends = ",".join(map(str, sorted(c for c in held if len(conversations[c]) == len(p))))
        out.append((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(kids), len(leaves), sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def _trie(df):
    return sorted((tuple(r[c] for c in trie.RESULT) for r in df.collect()), key=repr)


def _conversations(seed, n, copies=30):
    rng = random.Random(seed)
    held = {c: [(rng.choice(["user", "assistant"]), rng.choice(["a", "a b", "", "c\td e"])) for _ in range(rng.randrange(0, 6))] for c in rng.sample(range(-50, 4 * n), n)}
    held |= {9000 + i: [("user", "hot hot"), ("assistant", "same")] for i in range(copies)}
    return held | {9500: [("user", "long")] * 70, 9501: [("user", "long")] * 71, 9502: [("user", "long")] * 69 + [("user", "x y z")]}


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_trie_against_brute_force(spark, parts):
    held = _conversations(int(parts), 90)
    rows = [(c, t, *turn) for c, turns in held.items() for t, turn in enumerate(turns)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS path", "2 AS words", "3 AS key", "4 AS pid", "5 AS n")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert _trie(trie.prefix_trie(df)) == brute_trie({c: turns for c, turns in held.items() if turns})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_edges(spark):
    """Null turns come first, null roles and texts are empty, null conversations don't count, ties and repeats are turns."""
    rows = [(1, 5, "user", "x"), (1, None, None, None), (2, 1, "", ""), (2, 2, "user", "x"), (None, 0, "user", "q"), (3, 0, "u", "b"), (3, 0, "u", "a"), (3, 0, "u", "a")]
    df = spark.createDataFrame(rows, TURNS)
    tied = sorted((hashlib.md5(f"1:u{t}".encode()).hexdigest(), t) for t in ("a", "a", "b"))
    assert _trie(trie.prefix_trie(df)) == brute_trie({1: [("", ""), ("user", "x")], 2: [("", ""), ("user", "x")], 3: [("u", t) for _, t in tied]})
    assert _trie(trie.prefix_trie(df.limit(0))) == []


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(6)
    held = {c: [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randrange(1, 5))] for c in [*range(0, 90, 3), 20, 40, 1000, 1001]}
    rows = [(c, t, *turn) for c, turns in held.items() for t, turn in enumerate(turns)]
    head = lambda c: zlib.crc32(str(c).encode()) % 4
    want = {c: held.get(c - c % 20, [])[: head(c)] + turns[head(c) :] for c, turns in held.items()}
    assert any(not turns for turns in want.values()) and any(c - c % 20 not in held for c in held)
    said = trie.materialise(trie.placed(spark.createDataFrame(rows, TURNS)), "test-turns")
    assert _trie(trie.nodes(trie.rebuilt(said))) == brute_trie(want)


def test_sparse_table_against_scans():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 17, 64):
        values = rng.integers(0, 6, size)
        low, least = rng.integers(0, size, 50), rng.integers(0, 7, 50)
        high = np.minimum(low + rng.integers(0, size, 50), size - 1)
        found = trie.Minima(values)
        assert found.over(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]
        right = [max(r for r in range(a, size) if (values[a + 1 : r + 1] >= x).all()) for a, x in zip(low, least)]
        left = [min(r for r in range(a + 1) if (values[r + 1 : a + 1] >= x).all()) for a, x in zip(low, least)]
        assert found.rightmost(low, least).tolist() == right and found.leftmost(low, least).tolist() == left


# The registered queries

FOLDS = {"op2_quality": (4, 2), "op4_toxicity": (3, 1)}


@pytest.mark.parametrize("name", FOLDS)
def test_registered_classifiers(spark, name):
    """Columns, types, folds, thresholds and one row a document, as plain Python finds them."""
    df = queries.queries()[name](spark, SF)
    assert [(c, t) for c, t in df.dtypes][:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    modulus, remainder = FOLDS[name]
    rows = df.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


@pytest.mark.parametrize("name", ["op5_chat_format", "op11_collocations", "op12_warc", "op13_trie"])
def test_registered_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want and want
