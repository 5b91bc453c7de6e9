"""Sections of Markdown documents and the shorter formats made of them; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsense.operators import tokens

#: Kinds of sections by the start of their title, with priorities.
KINDS = {"overview": 8, "requirements": 9, "implementation": 7, "example": 5, "best practices": 8, "security": 9, "performance": 7, "testing": 6, "references": 3}
OTHER = 4
HEADING = r"#{1,3}[ \t]*"


def parse(markdown: Column) -> Column:
    """Sections in order: ordinal, title, kind, priority and body.

    A section goes from its heading (levels 1 to 3) to the next one; text before the first heading has an empty title.
    A section of no named kind needs 50 characters or more; shorter ones are dropped, as are blank ones.
    """
    pieces = F.transform(F.split(markdown, rf"(?m)(?=^{HEADING}[^ \t\n#])"), lambda x, i: F.struct((i + 1).alias("n"), F.trim(F.regexp_extract(x, rf"^{HEADING}([^\n]*)", 1)).alias("title"), x.alias("body")))

    def named(p):
        low, kind, rank = F.lower(p["title"]), F, F
        for name, priority in KINDS.items():
            kind, rank = kind.when(low.startswith(name), name), rank.when(low.startswith(name), priority)
        return F.struct(p["n"].alias("n"), p["title"].alias("title"), kind.otherwise("other").alias("kind"), rank.otherwise(OTHER).alias("priority"), p["body"].alias("body"))

    return F.filter(F.transform(pieces, named), lambda s: s["body"].rlike(r"[^ \t\r\n]") & ((s["kind"] != "other") | (F.length(s["body"]) >= 50)))


#: Ids, names as patterns and priorities of the sections that token formats rest on, in the order they claim text.
PATTERNS = (
    ("overview", "Overview", 8),
    ("requirements", "Requirements", 9),
    ("implementation", "Implementation", 7),
    ("examples", "Examples?", 5),
    ("best_practices", "Best Practices", 8),
    ("security", "Security", 9),
    ("performance", "Performance", 7),
    ("testing", "Testing", 6),
    ("references", "References", 3),
)
_MARK, _LITERAL = "\x00\x01", "\x00\x02"


def heading_pattern(name: str) -> str:
    """One to three number signs anywhere, white space and the name, in any case; Java's syntax."""
    return rf"(?iU)#{{1,3}}\s*{name}"


def parse_patterns(text: Column, patterns=PATTERNS, other: int = 4, whole: int = 5, least: int = 50) -> Column:
    """Sections claimed by patterns: an array of id, title, priority and content.

    A pattern's section begins where it matches and ends before the next line that begins with a number sign, or with the
    text. Patterns claim in their order and, each, from left to right; a section that overlaps a claimed one is dropped. What
    lies between claimed sections, stripped, is kept if longer than ``least``; all such gaps together are the section
    ``other``, the last one. A text without any match is the section ``content``, a blank or null one has no sections.

    Every section ends where its block of the text ends (blocks begin at lines with a number sign), so sections overlap if
    and only if they share a block, and in each block the first pattern that matches there claims the block from its match
    on: no interval has to be searched.
    """
    blocks = F.split(text, "\n(?=#)", -1)

    def claim(block: Column, i: Column) -> Column:
        order, at = F, F
        for n, (_, name, _) in enumerate(patterns):
            hit = block.rlike(heading_pattern(name))
            order, at = order.when(hit, n), at.when(hit, F.regexp_instr(block, F.lit(heading_pattern(name))))
        return F.struct(order.otherwise(len(patterns)).alias("order"), i.alias("i"), at.otherwise(0).alias("at"), block.alias("block"))

    told = F.transform(blocks, claim)
    claimed = F.array_sort(F.filter(told, lambda b: b["at"] > 0))
    field = lambda values, n: F.get(F.array(*map(F.lit, values)), n)
    ids = [k for k, _, _ in patterns]
    section = lambda k, title, priority, content: F.struct(k.alias("id"), title.alias("title"), priority.alias("priority"), content.alias("content"))
    named = F.transform(
        claimed,
        lambda b: section(field(ids, b["order"]), field([k.replace("_", " ").title() for k in ids], b["order"]), field([r for _, _, r in patterns], b["order"]), b["block"].substr(b["at"], F.length(b["block"]))),
    )
    strip = lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")
    # Claimed parts are cut out at marks that no text holds, because the mark's first character is spelled out before.
    safe = lambda x: F.replace(x, F.lit("\x00"), F.lit(_LITERAL))
    left = F.array_join(F.transform(told, lambda b: F.when(b["at"] > 0, F.concat(safe(F.left(b["block"], b["at"] - 1)), F.lit(_MARK))).otherwise(safe(b["block"]))), "\n")
    gaps = F.filter(F.transform(F.split(left, _MARK, -1), lambda g: strip(F.replace(g, F.lit(_LITERAL), F.lit("\x00")))), lambda g: F.length(g) > least)
    rest = F.when(F.size(gaps) > 0, F.array(section(F.lit("other"), F.lit("Additional Information"), F.lit(other), F.array_join(gaps, "\n\n")))).otherwise(F.slice(named, 1, 0))
    alone = F.array(section(F.lit("content"), F.lit("Standard Content"), F.lit(whole), text))
    blank = F.coalesce(strip(text), F.lit("")) == ""
    return F.when(blank, F.slice(alone, 1, 0)).when(F.size(claimed) > 0, F.concat(named, rest)).otherwise(alone)


def key_points(body: Column, most: int = 5, width: int = 80) -> Column:
    """The first bullets and numbered items of a section, abbreviated and clipped."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^([-*•] |[0-9]+\.)"))
    return F.slice(F.transform(lines, lambda x: clip(tokens.abbreviate(x), width)), 1, most)


def clip(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 3)), F.lit("..."))).otherwise(text)


def reference_format(sections: Column, budget: int) -> Column:
    """Titles with their key points; beyond the budget, nine tenths of what fits and a note."""
    shown = F.filter(F.transform(sections, lambda s: F.struct(s["title"].alias("title"), key_points(s["body"]).alias("points"))), lambda s: F.size(s["points"]) > 0)
    text = F.array_join(F.transform(shown, lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), F.array_join(s["points"], "\n"))), "\n\n")
    n = tokens.count(text)
    kept = F.floor(F.length(text) * (F.lit(float(budget)) / F.greatest(n, F.lit(1))) * 0.9).cast("int")
    return F.when(n > budget, F.concat(F.left(text, kept), F.lit("\n\n[Content truncated due to token limit]"))).otherwise(text)


def top_sections(sections: Column, most: int = 3) -> Column:
    """The sections of the highest priority, ties in the order of the text."""
    ranked = F.array_sort(F.transform(sections, lambda s: F.struct((-s["priority"]).alias("p"), s["n"].alias("n"), s["title"].alias("title"), s["body"].alias("body"))))
    return F.slice(ranked, 1, most)


def summary_format(sections: Column, budget: int) -> Column:
    """The first line of over 50 characters of each of the top three sections, and their titles."""
    top = top_sections(sections)
    first = F.transform(top, lambda s: F.get(F.filter(F.transform(F.split(s["body"], "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) > 50) & ~x.startswith("#")), F.lit(0)))
    text = F.array_join(F.transform(F.array_compact(first), lambda x: tokens.remove_redundancy(tokens.abbreviate(x))), " ")
    cut = F.when(tokens.count(text) > budget, F.concat(F.left(text, F.lit(int(budget * 3.5) - 3)), F.lit("..."))).otherwise(text)
    return F.concat(F.lit("**Summary**: "), cut, F.lit("\n\n**Sections covered**: "), F.array_join(F.transform(top, lambda s: s["title"]), ", "))


def condensed_format(docs: DataFrame, key: str, sections: str, budget: int) -> DataFrame:
    """(key, used, text): essential lines of the sections, packed by priority; what doesn't fit is skipped.

    Each document is packed by an expression over its own array of sections, without a shuffle.
    """
    items = F.array_sort(F.transform(F.col(sections), lambda s: F.struct((-s["priority"]).alias("p"), s["n"].alias("n"), F.array_join(tokens.essential_lines(tokens.abbreviate(tokens.remove_redundancy(s["body"]))), "\n").alias("text"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(state, item):
        more = state["used"] + tokens.count(item["text"])
        return F.when(more <= budget, F.struct(more.alias("used"), F.concat(state["kept"], F.array(item["text"])).alias("kept"))).otherwise(state)

    return docs.select(key, F.aggregate(items, start, step).alias("r")).select(key, "r.used", F.array_join("r.kept", "\n\n").alias("text"))
