"""The pattern parser against a brute-force interval resolver."""

import random
import re

from pyspark.sql import functions as F

from docsense.operators import sections


def brute(text, least=50):
    """Spans of all patterns in order, each kept unless it overlaps a kept one; then the gaps."""
    if not (text or "").strip():
        return []
    kept, out = [], []
    for key, name, priority in sections.PATTERNS:
        for m in re.finditer(rf"#{{1,3}}\s*{name}.*?(?=\n#{{1,3}}|\Z)", text, re.I | re.S):
            if all(m.end() <= a or m.start() >= b for a, b in kept):
                kept.append(m.span())
                out.append((key, priority, m[0]))
    if not out:
        return [("content", 5, text)]
    edges = [0, *[x for span in sorted(kept) for x in span], len(text)]
    gaps = [g for a, b in zip(edges[::2], edges[1::2]) if len(g := text[a:b].strip()) > least]
    return out + ([("other", 4, "\n\n".join(gaps))] if gaps else [])


def test_pattern_sections_against_brute_force(spark):
    rng = random.Random(12)
    names = ["Overview", "REQUIREMENTS", "implementation", "Example", "Examples", "best practices", "Security", "Performance", "testing", "References", "Other", "overviews of Security"]
    texts = ["", " \n\t", None, "no heading", "## Overview", "#Security\n\n#\n# Testing", "####  Overview x\n#### Security y", "a # overview b # security c\nd", "\x00\x01 # Testing \x00 end\n# Next\n" + "\x00\x02 gap " * 20]
    for _ in range(150):
        lines = []
        for _ in range(rng.randrange(1, 14)):
            kind = rng.random()
            if kind < 0.45:
                lines.append("#" * rng.randrange(1, 5) + rng.choice(["", " ", "  ", "\n", "\t"]) + rng.choice(names) + rng.choice(["", " notes", " # " + rng.choice(names)]))
            else:
                lines.append(rng.choice(["", "word " * rng.randrange(1, 20), " see # Security here", "\n\n", "a#b"]))
        texts.append("\n".join(lines))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: [(s.id, s.priority, s.content) for s in r.s] for r in df.select("i", sections.parse_patterns(F.col("t")).alias("s")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert {k for found in got.values() for k, _, _ in found} >= {"overview", "security", "other", "content", "best_practices"}
