"""Stems of English words by Porter's rules (1980), with the usual later amendments, for vocabularies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with stems of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Suffixes and what takes their place, in the order in which they are tried; the first that ends the word decides.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
LONG = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
MIDDLE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out[-1:] == "c" else "c"
    return out


def measure(word: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(word).count("vc")


def _closed(word: str) -> bool:
    """Consonant, vowel and consonant other than w, x and y at the end; or a vowel and a consonant alone."""
    form = shape(word)
    return form == "vc" or form[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules, least: int) -> str:
    for suffix, other in rules:
        if word.endswith(suffix):
            head = word[: len(word) - len(suffix)]
            return head + other if measure(head) >= least else word
    return word


def _without_tense(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    head = next((word[: -len(x)] for x in ("ed", "ing") if word.endswith(x) and "v" in shape(word[: -len(x)])), None)
    if head is None:
        return word
    if head.endswith(("at", "bl", "iz")):
        return head + "e"
    if head[-1] == head[-2:-1] and shape(head)[-1] == "c":
        return head if head[-1] in "lsz" else head[:-1]
    return head + "e" if measure(head) == 1 and _closed(head) else head


def _long_suffix(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]):
        return _long_suffix(word[:-2])
    if word.endswith("logi") and not any(word.endswith(x) for x, _ in LONG):
        return word[:-1] if measure(word[:-3]) else word
    return _replaced(word, LONG, 1)


def _last_suffix(word: str) -> str:
    suffix = next((x for x in LAST if word.endswith(x)), "")
    head = word[: len(word) - len(suffix)]
    fits = measure(head) > 1 and (suffix != "ion" or head[-1:] in ("s", "t"))
    return head if suffix and fits else word


def stem(word: str) -> str:
    """The stem of one lower-cased word; words of one or two letters stay."""
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _replaced(word, PLURALS, 0)
    word = _without_tense(word)
    if word.endswith("y") and len(word) > 2 and shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _last_suffix(_replaced(_long_suffix(word), MIDDLE, 1))
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or m == 1 and not _closed(word[:-1]):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stemmed(word: Column) -> Column:
    """The stem of a column of words, each distinct word of a batch once; null stays null."""

    @F.pandas_udf("string")
    def of(words: pd.Series) -> pd.Series:
        known = {w: stem(w) for w in words.dropna().unique()}
        return pd.Series([known.get(w) for w in words], dtype="object")

    return of(word)
