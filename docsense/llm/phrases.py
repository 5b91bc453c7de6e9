"""Collocated phrases of two and three words by SON partitioning (operator 11).

Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. A
phrase is frequent in a language if it occurs ``SUPPORT`` times, overlaps included. The corpus is dealt into ``SHARDS``
shards, each every SHARDS-th partition of the input, and a shard is mined by many tasks:

1. every shard completely, at the proportional local support ``ceil(SUPPORT / SHARDS)``. A phrase with fewer occurrences in
   each shard has fewer than SUPPORT in all, so the union of the locally frequent phrases misses none. First words and
   pairs, then those triples whose pairs both are locally frequent somewhere (no other can be frequent);
2. the union's keys become a Bloom filter of bounded size, and a last pass counts every phrase that passes it, spelled out,
   over all texts. Only these counts decide; what passes by chance is counted exactly and dropped.

Keys are 64-bit hashes of language and words. Shared keys and false hits only add candidates, so they never change a result.
Tasks number the words of at most ``CHUNK`` tokens at once and aggregate before anything is shuffled, so no hot word or
phrase meets in one task. A filter has ``FILTER_BITS`` bits a key up to 2**``MOST_BITS`` bits (64 MB); with more candidates
than that it lets more through, and the last shuffle grows, up to a plain count.

Null texts are empty and null languages ``und``; repeated rows count each; an empty table, or one without frequent phrases,
gives an empty result; only lang and text are read. Texts of any length are read in windows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsense.llm.common import materialise
from docsense.llm.decontaminate import PROBES, Bloom

SUPPORT = 10
SHARDS = 4
TOP = 2000
#: A phrase goes if a longer one around it has this percentage of its occurrences.
COVERED = 50
CHUNK = 4_000_000
WINDOW = 1 << 20
FILTER_BITS, MOST_BITS = 16, 29
#: Parts in which a language's phrases are ranked before its first ``TOP`` meet.
RANKS = 32
#: Word numbers of a chunk have so many bits; three of them fit a long.
BITS = 21

_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def tokens(text: str | None):
    """The words of a text in order, in lists from windows of it; ``.`` between pieces and at the end."""
    held = (text or "").encode().lower().translate(_CUT)
    start = 0
    while start < len(held):
        end = start + WINDOW
        if end < len(held):
            end = held.find(b" ", end)
            end = len(held) if end < 0 else end
        yield held[start:end].replace(b".", b" . ").split()
        start = end
    yield [b"."]


class Numbers(dict):
    """Words by number, from 1; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def mixed(seed: int, *parts: np.ndarray) -> np.ndarray:
    """A well-mixed key of word hashes in their order."""
    out = np.full(len(parts[0]), seed, np.uint64)
    for part, step in zip(parts, _STEPS):
        out ^= part
        out *= step
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class Chunk:
    """The token streams of several texts by language. ``flush`` hands on each stream but its last two tokens, which begin the
    next chunk, so a phrase may begin anywhere."""

    def __init__(self, work):
        self.work, self.numbers, self.streams, self.size = work, Numbers(), defaultdict(list), 0

    def add(self, lang: str, words: list[bytes]):
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.streams[lang].append(ids)
        self.size += len(ids)

    def full(self) -> bool:
        return self.size >= CHUNK or len(self.numbers) >= 1 << BITS - 1

    def flush(self, last: bool = False):
        words = list(self.numbers)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        tails = {}
        for lang, stream in self.streams.items():
            ids = np.concatenate([*stream, np.zeros(2 * last, np.int64)])
            if not last:
                tails[lang] = [words[i] for i in ids[-2:]]
            if len(ids) > 2:
                yield from self.work(lang, xxhash.xxh64_intdigest(lang), ids, words, hashes)
        self.numbers, self.streams, self.size = Numbers(), defaultdict(list), 0
        for lang, tail in tails.items():
            self.add(lang, tail)


def _over_chunks(work):
    """A mapInArrow function that runs ``work`` on the chunks of its partition."""

    def run(batches):
        chunk = Chunk(work)
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text")):
                for words in tokens(text.as_py()):
                    chunk.add(lang.as_py(), words)
                    if chunk.full():
                        yield from chunk.flush()
        yield from chunk.flush(last=True)

    return run


def _keys(seed: int, ids: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """The keys of the phrases of ``width`` words that begin at each place but the last two (of no use across pieces)."""
    n = len(ids) - 2
    return mixed(seed + width & 0xFFFFFFFFFFFFFFFF, *[hashes[ids[i : i + n]] for i in range(width)])


def _within(ids: np.ndarray, width: int) -> np.ndarray:
    """Whether the words at each place but the last two are in one piece."""
    n = len(ids) - 2
    return np.logical_and.reduce([ids[i : i + n] > 0 for i in range(width)])


def _code(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = ids[at]
    for i in range(1, width):
        out = out << BITS | ids[at + i]
    return out


def _words_of(codes: np.ndarray, width: int) -> list[np.ndarray]:
    return [codes >> BITS * (width - 1 - i) & (1 << BITS) - 1 for i in range(width)]


def _pairs_that_pass(known: Bloom, seed: int, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a pair of words that passes the filter begins at each place but the last."""
    longer = np.append(ids, 0)
    out, at = np.zeros(len(ids) - 1, bool), np.flatnonzero(_within(longer, 2))
    out[at[known.holds(_keys(seed, longer, hashes, 2)[at])]] = True
    return out


def _triples(pairs: np.ndarray) -> np.ndarray:
    return np.flatnonzero(pairs[:-1] & pairs[1:])


MINED = "shard int, key long, n int"


def _mined(seed: int, codes: np.ndarray, counts: np.ndarray, hashes: np.ndarray, width: int) -> pa.RecordBatch:
    keys = mixed(seed + width & 0xFFFFFFFFFFFFFFFF, *[hashes[w] for w in _words_of(codes, width)])
    shard = np.full(len(keys), TaskContext.get().partitionId() % SHARDS, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int32))], names=["shard", "key", "n"])


def _mine_pairs(lang, seed, ids, words, hashes):
    for width in (1, 2):
        yield _mined(seed, *np.unique(_code(ids, np.flatnonzero(_within(ids, width)), width), return_counts=True), hashes, width)


def _miner_of_triples(known):
    def mine(lang, seed, ids, words, hashes):
        at = _triples(_pairs_that_pass(known.value, seed, ids, hashes))
        yield _mined(seed, *np.unique(_code(ids, at, 3), return_counts=True), hashes, 3)

    return mine


COUNTED = "lang string, words int, phrase string, n long"


def _counter(known):
    """Counts of the phrases that pass, spelled out; an empty phrase of no words for all words of the language."""

    def count(lang, seed, ids, words, hashes):
        spelled = pa.array(words, pa.binary()).cast(pa.string())
        pairs = _pairs_that_pass(known.value, seed, ids, hashes)
        single = np.flatnonzero(_within(ids, 1))
        places = {1: single, 2: np.flatnonzero(pairs[:-1]), 3: _triples(pairs)}
        for width, at in places.items():
            codes, counts = np.unique(_code(ids, at, width), return_counts=True)
            parts = _words_of(codes, width)
            if width != 2:
                live = known.value.holds(mixed(seed + width & 0xFFFFFFFFFFFFFFFF, *[hashes[w] for w in parts]))
                parts, counts = [w[live] for w in parts], counts[live]
            said = [spelled.take(pa.array(w)) for w in parts]
            phrase = pc.binary_join_element_wise(*said, " ") if width > 1 else said[0]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(counts)), pa.repeat(pa.scalar(width, pa.int32()), len(counts)), phrase, pa.array(counts)], names=["lang", "words", "phrase", "n"])
        yield pa.RecordBatch.from_pylist([{"lang": lang, "words": 0, "phrase": "", "n": len(single)}], pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())]))

    return count


def _filter(keys: DataFrame) -> Bloom:
    """The filter of the column ``key``; the driver gets its words, 64 MB at most."""
    bits = min(max((keys.count() * FILTER_BITS - 1).bit_length(), 10), MOST_BITS)
    mask = F.lit((1 << bits) - 1)
    low, step = F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 33).bitwiseAND(mask)
    at = keys.select(F.explode(F.array(*[(low + probe * step).bitwiseAND(mask) for probe in range(PROBES)])).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("held")).toArrow()
    words = np.zeros(1 << bits - 6, np.int64)
    words[found.column("word").to_numpy()] = found.column("held").to_numpy()
    return Bloom(words.view(np.uint64))


def frequent(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """lang, words (1 to 3; 0 for all words of the language together), phrase and f of everything that occurs ``support`` times."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    context, local = docs.sparkSession.sparkContext, -(-support // SHARDS)

    def mine(work, name):
        held = texts.mapInArrow(_over_chunks(work), MINED).groupBy("shard", "key").agg(F.sum("n").alias("n"))
        return materialise(held.where(F.col("n") >= local).select("key").distinct(), name)

    pairs = mine(_mine_pairs, "phrase-pairs")
    triples = mine(_miner_of_triples(context.broadcast(_filter(pairs))), "phrase-triples")
    known = context.broadcast(_filter(pairs.unionByName(triples)))
    counts = texts.mapInArrow(_over_chunks(_counter(known)), COUNTED).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
    return counts.where((F.col("words") == 0) | (F.col("f") >= support))


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) in decimals of 38 digits; counts to 10**15 fit, more are an error."""
    exact = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast(1000000 as decimal(7,0)) * {exact(a)} * {exact(a)}) div ({exact(left)} * {exact(right)})")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases.

    a are the phrase's occurrences, l and r those of its parts at the cut of the lowest score (ties: the first cut), n the
    words of the language. Phrases inside a longer one with at least ``covered`` percent of their occurrences are left out.
    """
    counts = materialise(frequent(docs, support), "phrases")
    phrases = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    join = lambda low, n: F.array_join(F.slice(word, low, n), " ")
    side = lambda cut, which, part: F.struct(F.lit(cut).alias("cut"), F.lit(which).alias("side"), part.alias("part"))
    two = F.array(side(1, "l", join(1, 1)), side(1, "r", join(2, 1)))
    three = F.array(side(1, "l", join(1, 1)), side(1, "r", join(2, 2)), side(2, "l", join(1, 2)), side(2, "r", join(3, 1)))
    asked = phrases.select("lang", "phrase", "a", F.inline(F.when(F.col("words") == 2, two).otherwise(three)))
    told = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), "f")
    at = lambda cut, which: F.max(F.when((F.col("cut") == cut) & (F.col("side") == which), F.col("f"))).alias(f"{which}{cut}")
    parts = asked.join(told, ["lang", "part"]).groupBy("lang", "phrase", "a").agg(*[at(cut, which) for cut in (1, 2) for which in "lr"])
    cuts = [F.struct(_score("a", f"l{c}", f"r{c}").alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in (1, 2)]
    scored = parts.select("lang", "phrase", "a", F.when(F.col("l2").isNull(), cuts[0]).otherwise(F.least(*cuts)).alias("low")).select("lang", "phrase", "a", "low.*")

    longer = phrases.where("words = 3").select("lang", F.col("a").alias("around"), F.explode(F.array(join(1, 2), join(2, 2))).alias("phrase"))
    widest = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = scored.join(widest, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < covered * F.col("a"), F.lit(True)))

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    in_part = Window.partitionBy("lang", "part").orderBy(*best)
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANKS))).withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
