"""The fuzzy join against brute force over whole vocabularies."""

import random

import pytest

from docsense.operators import fuzzy, search
from docsense.plans import retrieval
from tests.conftest import SF


def _words(rng, n, letters, top):
    found = set()
    while len(found) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, top)))
        found.add(word)
        edited = list(word)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(edited) + 1)
            edited[at : at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
        found.add("".join(edited))
    return sorted(found - {""})


@pytest.mark.parametrize("least", [60, 80, 90, 100])
def test_no_pair_is_missed(least):
    """Every pair that reaches the ratio shares a key."""
    rng = random.Random(least)
    held = _words(rng, 350, "abé", 9) + _words(rng, 200, "abcdefgh", 40)
    keys = {w: (fuzzy.word_keys(w, least), fuzzy.token_keys(w, least)) for w in held}
    pairs = 0
    for a in held:
        for b in held:
            if search.indel_ratio(a, b) >= least:
                pairs += a != b
                assert keys[a][0] & keys[b][1], (a, b)
    assert pairs > 100 or least == 100


def test_matches_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = _words(rng, 500, "abcde", 14)
    asked = vocabulary[::25] + ["securty", "a", ""]
    frame = lambda values, c: spark.createDataFrame([(v,) for v in [*values, None]], f"{c} string")
    got = {(r.word, r.token): r.ratio for r in search.fuzzy_matches(frame(asked, "word"), frame(vocabulary, "token"), most=10_000).collect()}
    assert got == {(a, b): r for a in asked for b in vocabulary if a != b and (r := search.indel_ratio(a, b)) >= 80}


def test_few_words_need_no_keys(spark, monkeypatch):
    """A handful of words is compared directly, with the pairs that keys would give, and no key of a token is made."""
    rng = random.Random(9)
    vocabulary, asked = _words(rng, 500, "abcé", 14), ["abcab", "a", "", "cabébcaab"]
    frame = lambda values, c: spark.createDataFrame([(v,) for v in [*values, None]], f"{c} string")
    found = {}
    for few in (fuzzy.FEW, 0):
        monkeypatch.setattr(fuzzy, "FEW", few)
        df = search.fuzzy_matches(frame(asked, "word"), frame(vocabulary, "token"), most=10_000)
        found[few] = {tuple(r) for r in df.select("word", "token", "ratio").collect()}
        assert ("key" in df._jdf.queryExecution().analyzed().toString()) == (few == 0)
    assert found[0] == found[64] and len(found[0]) > 5


def test_few_pairs_are_compared(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(8, 13))) for _ in range(2000)]
    frame = lambda values, c: spark.createDataFrame([(v,) for v in values], f"{c} string")
    compared = fuzzy.candidates(frame(vocabulary[:100], "word"), frame(vocabulary, "token"), 80).count()
    assert compared < 0.1 * 100 * 2000


def test_correction_over_the_whole_vocabulary(spark):
    """Short and rare words of the corpus correct too."""
    words = spark.createDataFrame([("ctas",), ("dgo",), ("qqqqqqqq",)], "word string")
    vocabulary = spark.createDataFrame([("cats",), ("dog",), ("dogma",)], "token string")
    from docsense.operators.retrieval import corrected

    got = {r.word: r.correction for r in corrected(words, vocabulary).collect()}
    assert got == {"ctas": "ctas" if search.indel_ratio("ctas", "cats") < 80 else "cats", "dgo": "dgo", "qqqqqqqq": "qqqqqqqq"}
    assert retrieval.QUERIES["query_correction"](spark, SF).count() > 0
