"""Text functions over HTML and Markdown columns; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewriting steps from HTML to Markdown: pattern and replacement, in order. The patterns need no look-around.
MARKDOWN_STEPS = [
    (r"(?i)<(script|style)[^>]*>[^<]*</(script|style)>", ""),
    (r"(?i)</?pre[^>]*>", "\n```\n"),
    (r"(?i)<h1[^>]*>", "\n\n# "),
    (r"(?i)<h2[^>]*>", "\n\n## "),
    (r"(?i)<h3[^>]*>", "\n\n### "),
    (r"(?i)<li[^>]*>", "\n- "),
    (r"(?i)<a [^<>]*href=\"([^\"<>]*)\"[^<>]*>([^<]*)</a>", "[$2]($1)"),
    (r"(?i)<br[^>]*>", "\n"),
    (r"(?i)</?(p|div|ul|ol|table|tr|article|h[1-6])( [^>]*)?>", "\n\n"),
    (r"<[^<>]*>", ""),
    (r"[ \t]+", " "),
    (r"\n +", "\n"),
    (r"\n{3,}", "\n\n"),
]

#: What an error message must not show, and what stands for it, in order.
MESSAGE_STEPS = [
    (r"(?i)(password|secret|token|api_?key)([ =:]+)[^ ,;]+", "$1$2[redacted]"),
    (r"[a-z]+://[^ /:@]+:[^ /@]+@", "[redacted]@"),
    (r"(/[A-Za-z0-9_.-]+){2,}", "[path]"),
]


def rewrite(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def to_markdown(html: Column) -> Column:
    """Headings, list items, links, code blocks and paragraphs of a page as Markdown; null stays null."""
    return rewrite(html, MARKDOWN_STEPS)


def redact_message(message: Column) -> Column:
    """Credentials and file paths removed from an error message."""
    return rewrite(message, MESSAGE_STEPS)


def occurrences(text: Column, *words: str) -> Column:
    """Non-overlapping occurrences of each word as a substring, summed over the words."""
    counts = [F.floor((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)) for w in words]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return total.cast("long")


def heading_levels(markdown: Column) -> Column:
    """Levels of the headings (number of hash signs), in order."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"(?m)^(#+)[ \t]+[^ \t\n]"), F.lit(1)), F.length)


def technical_terms(markdown: Column) -> Column:
    """Capitalised words, acronyms and inline code, repeats included."""
    words = F.regexp_extract_all(markdown, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    code = F.regexp_extract_all(markdown, F.lit(r"`([^`]+)`"), F.lit(1))
    return F.concat(F.filter(words, lambda x: x.rlike(r"^([A-Z][a-z]+|[A-Z]{2,})$")), code)


def anchor(heading: Column) -> Column:
    """Link anchor of a heading: lower case, other characters dropped, blanks as hyphens."""
    kept = F.regexp_replace(F.lower(heading), r"[^a-z0-9 _-]", "")
    return F.regexp_replace(F.trim(kept), r" +", "-")


def preview(text: Column, characters: int = 200) -> Column:
    return F.when(F.length(text) > characters, F.concat(F.left(text, F.lit(characters)), F.lit("..."))).otherwise(text)


def title_from_id(key: Column) -> Column:
    """Words of an id or file name with capitals: ``api_design-v2`` is ``Api Design V2``."""
    return F.initcap(F.regexp_replace(key, r"[_-]+", " "))
