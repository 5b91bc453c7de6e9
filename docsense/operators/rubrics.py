"""Quality rubrics of Markdown documents: six sub-scores from 0 to 100, their weighted mean and what to improve.

``text`` is the whole document and ``low`` its lower case; metadata come as columns. Null text has null scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.functions.markup import heading_levels, occurrences, technical_terms

#: Words, and the weights of the sub-scores.
SECTIONS = ("purpose", "scope", "implementation", "compliance", "references", "appendix")
PASSIVE = ("is", "are", "was", "were", "been", "being")
ACTIVE = ("implement", "configure", "deploy", "execute")
CONNECTIVES = ("however", "therefore", "furthermore", "specifically", "for example")
RISK = ("risk", "threat", "vulnerability", "mitigation", "assessment")
SETUP = ("configuration", "config", "setup", "install", "deploy")
TECHNOLOGY = ("tool", "framework", "library", "platform", "technology")
WEIGHTS = {"completeness": 0.25, "consistency": 0.15, "clarity": 0.20, "compliance": 0.15, "guidance": 0.15, "maintainability": 0.10}


def _share(flags: Sequence[Column]) -> Column:
    """Share of the conditions that hold; 0 where there are none."""
    if not flags:
        return F.lit(0.0)
    return F.aggregate(F.array(*[F.coalesce(f, F.lit(False)).cast("int") for f in flags]), F.lit(0), lambda a, x: a + x) / len(flags)


def _steps(value: Column, *steps: tuple[int, int]) -> Column:
    """Points of the first bound that the value exceeds, else 0."""
    out = F
    for bound, points in steps:
        out = out.when(value > bound, points)
    return out.otherwise(0)


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def completeness(text: Column, low: Column, filled: Sequence[Column]) -> Column:
    """Named sections 30, length 20, filled metadata 20, code 15, a picture or diagram 15."""
    named = _share([low.contains(s) for s in SECTIONS])
    picture = F.when(text.contains("![") | text.contains("```mermaid"), 15).otherwise(0)
    return 30 * named + _steps(F.length(text), (2000, 20), (1000, 10)) + 20 * _share(filled) + F.when(text.contains("```"), 15).otherwise(0) + picture


def consistency(text: Column) -> Column:
    """Heading levels without jumps, terms used again, code of few languages, and links: 25 each.

    Of the ten most frequent terms, those that occur twice or more count. Needs no grouping: sorted terms meet their
    neighbours.
    """
    jumps = lambda levels: F.zip_with(levels, F.slice(levels, F.lit(2), F.size(levels)), lambda a, b: F.abs(b - a))
    part = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(0.0))
    small = lambda steps: part(F.size(F.filter(steps, lambda x: x <= 1)), F.size(steps))
    even = _let(heading_levels(text), lambda levels: _let(F.filter(jumps(levels), lambda x: x.isNotNull()), small))
    again = lambda terms: F.zip_with(terms, F.slice(terms, F.lit(2), F.size(terms)), lambda a, b: F.when(a == b, a))
    repeated = lambda terms: F.size(F.array_distinct(F.filter(again(terms), lambda x: x.isNotNull())))
    used = _let(F.array_sort(technical_terms(text)), lambda terms: part(F.least(repeated(terms), F.lit(10)), F.least(F.size(F.array_distinct(terms)), F.lit(10))))
    fences = F.regexp_extract_all(text, F.lit(r"```([A-Za-z0-9_]*)"), F.lit(1))
    alike = F.coalesce(1 - F.try_divide(F.size(F.array_distinct(fences)), F.size(fences)), F.lit(0.0))
    return 25 * even + 25 * used + 25 * alike + F.when(text.rlike(r"\[[^\[\]]+\]\([^()]+\)"), 25).otherwise(0)


def clarity(text: Column, low: Column) -> Column:
    """Mean sentence length near 15 to 20 words, mean paragraph length near 50 to 150, more active than passive words, connectives: 25 each."""
    words = F.regexp_count(text, F.lit(r"[^ \t\r\n.!?]+"))
    sentence = F.try_divide(words, F.regexp_count(text, F.lit(r"[^ \t\r\n.!?][^.!?]*")))
    blocks = F.size(F.filter(F.split(text, "\n\n"), lambda x: x.rlike(r"[^ \t\r\n]")))
    paragraph = F.try_divide(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), blocks)
    near = lambda value, a, b, c, d: _let(value, lambda v: F.when(v.between(a, b), 25).when(v.between(c, d), 20).when(v.isNotNull(), 10).otherwise(0))
    active, passive = occurrences(low, *ACTIVE), occurrences(low, *PASSIVE)
    voice = F.when(active > passive, 25).when(active > 0, 15).otherwise(0)
    return near(sentence, 15, 20, 10, 25) + near(paragraph, 50, 150, 30, 200) + voice + F.when(occurrences(low, *CONNECTIVES) > 0, 25).otherwise(0)


def compliance(text: Column, low: Column, controls: Sequence[str], frameworks: Sequence[str]) -> Column:
    """Controls mentioned 40, frameworks mentioned 30, risk words 30."""
    return 40 * _share([text.contains(x) for x in controls]) + 30 * _share([text.contains(x) for x in frameworks]) + _steps(occurrences(low, *RISK), (5, 30), (0, 20))


def guidance(text: Column, low: Column, technical: Column) -> Column:
    """Code blocks up to 30, numbered steps up to 20, setup words 20, technology words of technical documents 30."""
    blocks = F.least(10 * F.regexp_count(text, F.lit(r"```[^`]+```")), F.lit(30))
    numbered = F.least(2 * F.regexp_count(text, F.lit(r"(?m)^[0-9]+\.")), F.lit(20))
    return blocks + numbered + _steps(occurrences(low, *SETUP), (3, 20), (0, 10)) + F.when(technical, _steps(occurrences(low, *TECHNOLOGY), (5, 30), (0, 20))).otherwise(0)


def maintainability(low: Column, version: Column, author: Column, dependencies: Column, reviewed: Column) -> Column:
    """Version 25, author 20, a history 20, dependencies 15, a review beyond the draft 20."""
    points = [(version, 25), (author, 20), (low.contains("changelog") | low.contains("history"), 20), (dependencies, 15), (reviewed, 20)]
    return sum((F.when(held, p).otherwise(0) for held, p in points), F.lit(0))


def overall(scores: DataFrame) -> DataFrame:
    """The weighted mean of the sub-score columns, with two decimals, as column ``overall``."""
    return scores.withColumn("overall", F.round(sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)), 2))


def recommendations(scores: DataFrame, key: str, least: float = 60.0) -> DataFrame:
    """One row for each sub-score below the bound, with the points that are missing."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("score")) for k in WEIGHTS])
    return scores.select(key, F.inline(F.filter(each, lambda x: x["score"] < least))).withColumn("missing", F.round(least - F.col("score"), 6))


def heading_structure(text: Column, required: Sequence[str]) -> dict[str, Column]:
    """Missing section headings, a first heading of another level than one, levels that are skipped, and an open code block."""
    levels = heading_levels(text)
    down = F.zip_with(levels, F.slice(levels, F.lit(2), F.size(levels)), lambda a, b: (b > a + 1).cast("int"))
    return {
        "missing": F.array_join(F.array_compact(F.array(*[F.when(~text.contains(x), F.lit(x)) for x in required])), ","),
        "starts_lower": F.coalesce(F.get(levels, F.lit(0)) != 1, F.lit(False)),
        "skips": F.aggregate(down, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))).cast("long"),
        "open_fence": F.regexp_count(text, F.lit("```")) % 2 == 1,
    }


def record_validation(title: Column, description: Column, domain: Column, author: Column, parts: Sequence[Column]) -> dict[str, Column]:
    """Completeness, clarity and actionability of a record from 0 to 1. ``parts``: examples, guides, code examples, guidelines."""
    have = lambda c: F.when(F.length(F.trim(c)) > 0, 1).otherwise(0)
    held = [F.when(p, 1).otherwise(0) for p in parts]
    size = F.length(description)
    return {
        "valid": (have(title) + have(description) + have(domain)) == 3,
        "completeness": F.round(0.15 * (have(title) + have(description) + have(domain) + have(author)) + 0.1 * sum(held, F.lit(0)), 6),
        "clarity": F.when(F.coalesce(size, F.lit(0)) == 0, 0.0).when(size < 50, 0.3).when(size < 200, 0.7).otherwise(1.0),
        "actionability": F.round(0.3 * held[0] + 0.4 * held[1] + 0.3 * held[2], 6),
    }
