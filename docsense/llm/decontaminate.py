"""Benchmark decontamination by size-partitioned MinHash containment search (operator 7).

Words are runs of letters and digits of the lower-cased text; sets are of five-word shingles (a shorter text is one
shingle of all its words; a text without words has none and is never contained nor contaminated).

Benchmark items are partitioned by size: class u holds items of u/2 to u - 1 shingles. Document shingles are laid out in
windows of 2u, u apart, so a passage as long as an item lies whole in some window and the Jaccard similarity of the two
stays high however long the document is. Item and window are candidates if any of ``HASHES`` minima agree. Candidates are
verified by exact containment: shingles of the item found anywhere in the document, by their words, over all of its
shingles.

The index is a table with one row for each item, made in tasks: its shingles, and a key for each minimum of its size class.
What the documents' tasks get of it is a Bloom filter of these keys and one of the shingles, ``FILTER_BITS`` bits a key
(some 100 kB for 200 items) and at most 2**``MOST_BITS`` bits (64 MB); with more items than that suits, more rows pass and
the result stays the same. One pass over the corpus writes the documents with keys that pass, with those of their shingles
that pass; a join with the index gives the candidates, and another one verifies them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.llm.common import materialise

WORDS = re.compile(r"[^\W_]+")
SHINGLE = 5
CONTAINMENT = 0.8
HASHES = 64
#: Documents are hashed in groups of about so many shingles, which stay in a core's cache.
GROUP = 1 << 16
FILTER_BITS, PROBES, MOST_BITS = 64, 4, 29
#: Keys of contaminated texts that are broadcast at most, some 50 MB; more are joined by a shuffle.
BROADCAST_KEYS = 500_000

_rng = np.random.default_rng(20240131)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_POWERS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Added to a minimum, by size class (its binary logarithm) and hash number, to make its key.
_PLACES = _rng.integers(0, 1 << 63, (64, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordIds(dict):
    """64-bit ids of words, computed once each; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def tokens(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingle_hashes(words: list[str], ids: WordIds) -> np.ndarray:
    """One well-mixed 64-bit value for each shingle, in order."""
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - SHINGLE + 1, 1)
    mixed = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        mixed += codes[i : i + n] * _POWERS[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ (mixed >> np.uint64(29))


def shingle_text(words: list[str], at: int) -> str:
    return " ".join(words[at : at + SHINGLE])


def distinct_shingles(words: list[str]) -> list[str]:
    return list(dict.fromkeys(shingle_text(words, i) for i in range(max(len(words) - SHINGLE + 1, 1)))) if words else []


INDEX = "item_id long, n long, size int, grams array<string>, hashes array<long>, keys array<long>"


def _index_batches(batches):
    words_of = WordIds()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            words = tokens(text)
            if words:
                grams, hashes = distinct_shingles(words), np.unique(shingle_hashes(words, words_of))
                size = len(grams).bit_length()
                minima = np.array([(hashes * a + b).min() for a, b in zip(_FACTORS, _OFFSETS)], np.uint64)
                rows.append((item, len(grams), size, grams, hashes.view(np.int64), (minima + _PLACES[size]).view(np.int64)))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "n", "size", "grams", "hashes", "keys"])


def index_table(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct item with words: item (a number), item_id, n, size, grams, hashes and keys."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    return materialise(items.mapInArrow(_index_batches, INDEX).withColumn("item", F.monotonically_increasing_id()), "benchmark-index")


class Bloom:
    """A bit table of 2**``bits`` places in which 64-bit keys have ``PROBES`` places each."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """The positions of ``keys`` that pass."""
        live = np.arange(len(keys))
        step = None
        for probe in range(PROBES):
            at = (keys & self.mask) if step is None else (keys + np.uint64(probe) * step) & self.mask
            stay = (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            live, keys = live[stay], keys[stay]
            step = keys >> np.uint64(33) & self.mask if step is None else step[stay]
        return live


def bloom(keys: DataFrame) -> Bloom:
    """The filter of the column ``key``; the driver gets its words, 64 MB at most."""
    bits = min(max((keys.count() * FILTER_BITS - 1).bit_length(), 10), MOST_BITS)
    mask = F.lit((1 << bits) - 1)
    low, step = F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 33).bitwiseAND(mask)
    at = keys.select(F.explode(F.array(*[(low + probe * step).bitwiseAND(mask) for probe in range(PROBES)])).alias("at"))
    bit: Column = F.expr("shiftleft(1L, cast(at & 63 as int))")
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("held")).toArrow()
    words = np.zeros(1 << bits - 6, np.int64)
    words[found.column("word").to_numpy()] = found.column("held").to_numpy()
    return Bloom(words.view(np.uint64))


@dataclass
class Filters:
    """What the documents' tasks know of the benchmark."""

    sizes: list[int]
    keys: Bloom
    shingles: Bloom


def filters(index: DataFrame) -> Filters:
    sizes = sorted(r[0] for r in index.select("size").distinct().collect())
    return Filters(sizes, *[bloom(index.select(F.explode(c).alias("key")).distinct()) for c in ("keys", "hashes")])


def _blocks(lengths: np.ndarray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of ``unit`` when every document begins a block of its own, and each block's document."""
    per = -(-lengths // unit)
    owner = np.repeat(np.arange(len(lengths)), per)
    first = np.cumsum(per) - per
    starts = np.repeat(np.cumsum(lengths) - lengths, per) + (np.arange(len(owner)) - np.repeat(first, per)) * unit
    return starts, owner


def passing_keys(hashed: list[np.ndarray], known: Filters) -> dict[int, set[int]]:
    """The keys of a group of documents that pass the filter, by document."""
    found: dict[int, set[int]] = {}
    live = [i for i, h in enumerate(hashed) if len(h)]
    if not live:
        return found
    flat = np.concatenate([hashed[i] for i in live])
    plans, sizes, width = [], np.array([len(hashed[i]) for i in live]), 1
    for size in known.sizes:
        starts, owner = _blocks(sizes, (1 << size) // width)
        last = np.append(owner[1:] != owner[:-1], True)
        plans.append((size, starts, owner, last))
        sizes, width = np.bincount(owner, minlength=len(live)), 1 << size
    for k in range(HASHES):
        least = flat * _FACTORS[k] + _OFFSETS[k]
        for size, starts, owner, last in plans:
            least = np.minimum.reduceat(least, starts)
            window = least.copy()
            np.minimum(least[:-1], least[1:], out=window[:-1], where=~last[:-1])
            window += _PLACES[size, k]
            for w in known.keys.holds(window):
                found.setdefault(live[owner[w]], set()).add(int(window[w].astype(np.int64)))
    return found


def _hits(texts: list[str | None], known: Filters, ids: WordIds):
    """(document number, keys, shingles) of the documents with keys that pass."""
    group: list[tuple[int, list[str], np.ndarray]] = []
    size = 0

    def flush():
        for number, keys in sorted(passing_keys([h for _, _, h in group], known).items()):
            at, words, hashed = group[number]
            places = known.shingles.holds(hashed)
            if len(places):
                yield at, sorted(keys), list(dict.fromkeys(shingle_text(words, i) for i in places.tolist()))

    for at, text in enumerate(texts):
        words = tokens(text)
        hashed = shingle_hashes(words, ids)
        group.append((at, words, hashed))
        size += len(hashed)
        if size >= GROUP:
            yield from flush()
            group, size = [], 0
    yield from flush()


HITS = "doc_id long, text_key string, keys array<long>, grams array<string>"


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """`contained_items` with text_key, the MD5 of the document's text."""
    index = index_table(benchmark)
    shared = docs.sparkSession.sparkContext.broadcast(filters(index))

    def search(batches):
        ids = WordIds()
        for batch in batches:
            rows = list(_hits(batch.column("text").to_pylist(), shared.value, ids))
            of = pa.array([at for at, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(of), batch.column("text_key").take(of), pa.array([k for _, k, _ in rows], pa.list_(pa.int64())), pa.array([g for _, _, g in rows], pa.list_(pa.string()))],
                names=["doc_id", "text_key", "keys", "grams"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.md5(F.col("text").cast("binary")).alias("text_key"), "text")
    hits = materialise(texts.mapInArrow(search, HITS).withColumn("row", F.monotonically_increasing_id()), "benchmark-hits")
    keys = index.select("item", F.explode("keys").alias("key"))
    pairs = hits.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "item").distinct()
    both = pairs.join(hits.select("row", "doc_id", "text_key", "grams"), "row").join(index.select("item", "item_id", "n", F.col("grams").alias("of_item")), "item")
    counted = both.select("doc_id", "text_key", "item_id", F.size(F.array_intersect("grams", "of_item")).cast("long").alias("shared"), F.col("n").alias("item_shingles"))
    return counted.where(F.col("shared") >= threshold * F.col("item_shingles")).withColumn("containment", F.col("shared") / F.col("item_shingles"))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """One row for each document row and benchmark item with containment of at least ``threshold``: doc_id, item_id,
    shared, item_shingles, containment.

    Reads doc_id and text only. Repeated documents give repeated rows; repeated identical items count once; null texts
    and empty tables give no rows; a null id stays null; long texts are searched whole.
    """
    return contained(docs, benchmark, threshold).drop("text_key")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; columns unchanged, null texts kept."""
    bad = materialise(contained(docs, benchmark, threshold).select("text_key").distinct(), "contaminated")
    few = bad.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(bad) if few else bad, F.md5(docs["text"].cast("binary")) == bad["text_key"], "left_anti")
