"""Fuzzy join of words with a vocabulary by segments, with nothing left out.

The ratio of two words is 100 * 2 LCS / (both lengths), rounded; a ratio of ``least`` allows a number D of inserted and deleted
letters that follows from the two lengths. A word is cut into D // 2 + 1 segments for each length a partner may have: of D
edits at most one falls into some segment, so that segment stands in the partner as it is, with one letter less, or with
one more, and shifted by no more letters than the lengths allow. Words emit these variants of their segments, vocabulary
tokens their substrings of the lengths in question, both as 64-bit keys with length and place; only pairs that share a key
are compared. Short and common segments make large keys on the vocabulary's side only; words are few on each. Up to ``FEW`` words
are compared with every token instead, by a banded edit distance.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edits(a: int, b: int, least: int) -> int:
    """The most letters that may be inserted or deleted between words of these lengths; -1 if no pair can reach the ratio."""
    most = int((a + b) * (200 - 2 * least + 1) / 200 + 1e-9)  # rounding lets half a point pass
    most -= (a + b - most) % 2
    return most if abs(a - b) <= most else -1


@lru_cache(maxsize=4096)
def partners(n: int, least: int) -> tuple[tuple[int, int], ...]:
    """(length, edits) of the tokens that a word of ``n`` letters may match."""
    top = int(n * (201 - least) / max(least - 1, 1)) + 2
    return tuple((m, d) for m in range(top + 1) if (d := edits(n, m, least)) >= 0)


@lru_cache(maxsize=4096)
def cuts(n: int, d: int) -> tuple[tuple[int, int], ...]:
    """(start, length) of the segments of a word of ``n`` letters under ``d`` edits."""
    k = d // 2 + 1
    edges = [i * n // k for i in range(k + 1)]
    return tuple((a, b - a) for a, b in zip(edges, edges[1:]))


@lru_cache(maxsize=4096)
def lengths(m: int, least: int) -> frozenset[int]:
    """The segment lengths that words matching a token of ``m`` letters are cut into."""
    return frozenset(size for n, d in partners(m, least) for _, size in cuts(n, d))


def _key(m: int, at: int, size: int, letters: str) -> int:
    return xxhash.xxh64_intdigest(f"{m},{at},{size},{letters}") - (1 << 63)


def _without_one(letters: str) -> set[str]:
    return {letters[:i] + letters[i + 1 :] for i in range(len(letters))}


def word_keys(word: str, least: int) -> set[int]:
    n, found = len(word), set()
    for m, d in partners(n, least):
        added, lost = (d + m - n) // 2, (d + n - m) // 2
        for start, size in cuts(n, d):
            segment = word[start : start + size]
            for at in range(max(start - lost, 0), min(start + added, m) + 1):
                found.add(_key(m, at, size, segment))
                found |= {_key(m, at, size, x) for x in _without_one(segment)}
    return found


def token_keys(token: str, least: int) -> set[int]:
    m, found = len(token), set()
    for size in lengths(m, least):
        for at in range(m + 1):
            for here in (size, size - 1):
                if 0 <= here and at + here <= m:
                    found.add(_key(m, at, size, token[at : at + here]))
            if at + size + 1 <= m:
                found |= {_key(m, at, size, x) for x in _without_one(token[at : at + size + 1])}
    return found


def _keyed(df: DataFrame, column: str, keys, least: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            held = [sorted(keys(x, least)) for x in frame[column]]
            yield pd.DataFrame({column: frame[column], "key": held})

    return df.select(column).where(F.col(column).isNotNull()).mapInPandas(run, f"{column} string, key array<long>").select(column, F.explode("key").alias("key"))


#: Words up to which each is compared with every token: that costs less than a token's keys.
FEW = 64


def _compared(words: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """The pairs within the edit distance that the ratio allows, which is never below the insertions and deletions it allows."""
    pairs = vocabulary.select("token").crossJoin(F.broadcast(words)).where("word <> token")
    most = F.floor((F.length("word") + F.length("token")) * (100 - least) / 100 + 0.5).cast("int")
    near = pairs.where((F.abs(F.length("word") - F.length("token")) <= most) & (F.call_function("levenshtein", "word", "token", most) >= 0))
    return near.select("word", "token").distinct()


def candidates(words: DataFrame, vocabulary: DataFrame, least: int) -> DataFrame:
    """Distinct pairs (word, token) that can reach the ratio ``least``, equal ones left out."""
    asked = words.select("word").where("word is not null").distinct()
    if asked.limit(FEW + 1).count() <= FEW:
        return _compared(asked, vocabulary, least)
    own = _keyed(asked, "word", word_keys, least)
    theirs = _keyed(vocabulary.select("token").distinct(), "token", token_keys, least)
    return own.join(theirs, "key").where("word <> token").select("word", "token").distinct()
