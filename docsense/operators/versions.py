"""Section and metadata diffs, change levels and semantic versions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a breaking change, sections whose changes weigh more, and metadata fields by weight.
BREAKING = r"(?i)breaking:|deprecated|removed|no longer supported|incompatible"
CRITICAL_SECTIONS = "security|authentication|authorization|compliance"
FIELD_LEVELS = {"version": "MAJOR", "dependencies": "MAJOR", "nist_controls": "MAJOR", "compliance_frameworks": "MAJOR", "tags": "MINOR", "domain": "MINOR", "type": "MINOR", "maturity_level": "MINOR"}
FIELD_IMPACT = {"version": "high", "dependencies": "high", "nist_controls": "high", "compliance_frameworks": "medium", "domain": "medium", "type": "medium"}


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, body): Markdown cut at heading lines. Text before the first is ``introduction``; a heading without a
    line below it is dropped, and of equal headings the last wins."""
    pieces = docs.select(key, F.posexplode(F.split(text, "\n(?=#)")).alias("n", "piece"))
    headed = F.col("piece").startswith("#")
    first = F.regexp_extract("piece", r"^([^\n]*)", 1)
    name = F.replace(F.lower(F.trim(F.regexp_replace(first, "^#+|#+$", ""))), F.lit(" "), F.lit("_"))
    cut = pieces.where(~headed | F.col("piece").contains("\n")).select(
        key, "n", F.when(headed, name).otherwise("introduction").alias("section"), F.when(headed, F.regexp_replace("piece", r"^[^\n]*\n", "")).otherwise(F.col("piece")).alias("body")
    )
    return cut.groupBy(key, "section").agg(F.max_by("body", "n").alias("body"))


def impact(level: Column, section: Column) -> Column:
    return F.when(level == "MAJOR", "high").when(F.lower(section).rlike(CRITICAL_SECTIONS), "medium").otherwise("low")


def _by_field(field: Column, values: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, value in values.items():
        out = F.when(field == name, value).otherwise(out)
    return out


def field_level(field: Column) -> Column:
    return _by_field(field, FIELD_LEVELS, "METADATA")


def field_impact(field: Column) -> Column:
    return _by_field(field, FIELD_IMPACT, "low")


def section_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sections that differ between two versions, a missing side as empty text, with level and impact."""
    a, b = old.select(*keys, F.col("body").alias("before")), new.select(*keys, F.col("body").alias("after"))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    return both.where("before <> after").withColumn("level", level(F.col("before"), F.col("after"))).withColumn("change", change(F.col("before"), F.col("after")))


def level(before: Column, after: Column) -> Column:
    """MINOR for an added section, MAJOR for a removed one or breaking words, MINOR for a fifth more text, else PATCH."""
    return F.when(before == "", "MINOR").when(after == "", "MAJOR").when(after.rlike(BREAKING), "MAJOR").when(F.length(after) > 1.2 * F.length(before), "MINOR").otherwise("PATCH")


def change(before: Column, after: Column) -> Column:
    ratio = F.try_divide(F.length(after).cast("double"), F.length(before))
    return F.when(before == "", "added").when(after == "", "removed").when(ratio > 1.5, "expanded").when(ratio < 0.5, "reduced").otherwise("edited")


def parts(version: Column) -> Column:
    """Major, minor and patch numbers; null for what isn't a semantic version."""
    numbers = F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))
    ok = (F.size(numbers) == 3) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(ok, F.struct(numbers[0].alias("major"), numbers[1].alias("minor"), numbers[2].alias("patch")))


def line_diff(before: Column, after: Column) -> Column:
    """Lines of either side that the other lacks, as ``-`` and ``+`` lines in the order of their side."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    gone = F.transform(F.filter(a, lambda x: ~F.array_contains(b, x)), lambda x: F.concat(F.lit("-"), x))
    come = F.transform(F.filter(b, lambda x: ~F.array_contains(a, x)), lambda x: F.concat(F.lit("+"), x))
    return F.array_join(F.concat(gone, come), "\n")


DIFF_FORMS = ("unified", "context", "html")


def text_diff(before: Column, after: Column, old_name: Column, new_name: Column, form: str = "unified") -> Column:
    """The diff of two texts, line by line: unified or with context, in hunks with three lines around, or an HTML page.

    Lines keep their ends and headers have none, as a caller that joins the parts gets them. Repeated and moved lines are told
    apart by their places. Equal texts give an empty diff (HTML: a page without changes); null texts and names are empty.
    """
    if form not in DIFF_FORMS:
        raise ValueError(f"form must be one of {', '.join(DIFF_FORMS)}")

    @F.pandas_udf("string")
    def told(a: pd.Series, b: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for x, y, m, n in zip(a, b, old, new):
            if form == "html":
                out.append(difflib.HtmlDiff().make_file(x.splitlines(), y.splitlines(), m, n))
            else:
                make = difflib.unified_diff if form == "unified" else difflib.context_diff
                out.append("".join(make(x.splitlines(keepends=True), y.splitlines(keepends=True), m, n, lineterm="")))
        return pd.Series(out, dtype="object")

    return told(*[F.coalesce(c, F.lit("")) for c in (before, after, old_name, new_name)])


def migration_guide(changes: DataFrame, key: str) -> DataFrame:
    """One text a key: its changes with level, section and what happened, the gravest first."""
    rank = F.when(F.col("level") == "MAJOR", 0).when(F.col("level") == "MINOR", 1).otherwise(2)
    line = F.concat(F.lit("- ["), "level", F.lit("] "), "section", F.lit(": "), "change")
    listed = changes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "section", line.alias("line")))).alias("l"))
    return listed.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("guide"))


def next_version(version: Column, level: Column) -> Column:
    v = parts(version)
    bump = F.when(level == "MAJOR", F.concat_ws(".", (v["major"] + 1).cast("string"), F.lit("0"), F.lit("0"))).when(level == "MINOR", F.concat_ws(".", v["major"].cast("string"), (v["minor"] + 1).cast("string"), F.lit("0")))
    return bump.otherwise(F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), (v["patch"] + 1).cast("string")))


def compatibility(major_changes: Column, changes: Column) -> tuple[Column, Column]:
    """Level by the number of MAJOR changes, and migration complexity."""
    grade = F.when(major_changes == 0, "full").when(major_changes <= 2, "partial").otherwise("breaking")
    return grade, F.when(major_changes > 3, "high").when(changes > 5, "medium").otherwise("low")
