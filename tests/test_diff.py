"""Diffs as patches: applied to the old text they give the new one; global places over many partitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docsense.operators import orderstats, versions


def patched(before, diff):
    """``before`` with a unified diff applied; hunks must fit where they say they begin."""
    lines, out, at = before.splitlines(keepends=True), [], 0
    body = diff.split("@@", 1)
    if len(body) < 2:
        return before
    hunks = re.findall(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@((?:[ +-][^\n]*\n)*)", "@@" + body[1])
    for start, count, text in hunks:
        low = int(start) - (count != "0")
        out += lines[at:low]
        at = low
        for line in text.splitlines(keepends=True):
            if line[0] in " -":
                assert lines[at] == line[1:]
                at += 1
            if line[0] in " +":
                out.append(line[1:])
    return "".join(out + lines[at:])


def _pairs():
    rng = random.Random(7)
    texts = [("", ""), ("a\n", "a\n"), ("", "a\nb\n"), ("a\nb\n", ""), ("a\nb\na\nc\n", "a\na\nb\nc\n"), ("x\n" * 5, "x\n" * 8)]
    for _ in range(60):
        old = [rng.choice("abcdef") * rng.randrange(1, 4) + "\n" for _ in range(rng.randrange(0, 40))]
        new = old[:]
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = [rng.choice("abcdefxyz") + "\n"] * rng.randrange(3)
        if rng.random() < 0.3 and new:
            new.append(new.pop(rng.randrange(len(new))))  # a moved line
        texts.append(("".join(old), "".join(new)))
    return texts


def test_unified_diffs_are_patches(spark):
    texts = _pairs()
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "i int, a string, b string").repartition(3)
    got = {r.i: r.d for r in df.select("i", versions.text_diff(F.col("a"), F.col("b"), F.lit("old"), F.lit("new")).alias("d")).collect()}
    for i, (a, b) in enumerate(texts):
        # Headers have no line ends of their own, so hunk headers are followed at once by their lines.
        told = re.sub(r"(@@ -[0-9,]+ \+[0-9,]+ @@)(?!\n)", r"\1", got[i])
        assert patched(a, told) == b
        assert (got[i] == "") == (a == b)


def test_diff_forms_and_nulls(spark):
    df = spark.createDataFrame([("a\nb\n", "a\nc\n"), (None, "x\n"), (None, None)], "a string, b string")
    told = lambda form: [r.d for r in df.select(versions.text_diff(F.col("a"), F.col("b"), F.lit("n v1"), F.lit(None).cast("string"), form).alias("d")).collect()]
    assert told("unified") == ["--- n v1+++ @@ -1,2 +1,2 @@ a\n-b\n+c\n", "--- n v1+++ @@ -0,0 +1 @@+x\n", ""]
    assert told("context")[0] == "*** n v1--- ****************** 1,2 **** a\n! b\n--- 1,2 ---- a\n! c\n".replace(" a\n", "  a\n")
    assert all("<table" in page for page in told("html"))
    with pytest.raises(ValueError):
        versions.text_diff(F.col("a"), F.col("b"), F.lit(""), F.lit(""), "side by side")


def test_places_over_all_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    got = {r.k: r.place for r in orderstats.placed(df, ["v", "k"], "place").collect()}
    assert got == {k: i for i, (_, k) in enumerate(sorted((v, k) for k, v in rows), 1)}
    assert orderstats.placed(df.limit(0), ["v", "k"], "place").count() == 0
