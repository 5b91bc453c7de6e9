"""Document and record checks, reviewer assignment, template filters and sanitised input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsense.functions import markup


def validation(standards: DataFrame, key: str) -> DataFrame:
    """Validity, errors, warnings, three scores and suggestions of standards.

    Columns title, description, domain, author and created_date (text), and booleans examples, implementation_guides,
    code_examples and guidelines.
    """
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    length = F.length(F.coalesce("description", F.lit("")))
    completeness = total([part(given(c), 0.15) for c in ("title", "description", "domain", "author")] + [part(F.col(c), 0.1) for c in ("examples", "implementation_guides", "code_examples", "guidelines")])
    clarity = F.when(length == 0, 0.0).when(length < 50, 0.3).when(length < 200, 0.7).otherwise(1.0)
    actionability = part(F.col("examples"), 0.3) + part(F.col("implementation_guides"), 0.4) + part(F.col("code_examples"), 0.3)
    scored = standards.withColumns({"completeness": F.round(F.least(completeness, F.lit(1.0)), 6), "clarity": clarity, "actionability": F.round(actionability, 6)})
    listed = lambda *xs: F.concat_ws("; ", *xs)
    errors = listed(*[F.when(~given(c), f"Missing required field: {c}") for c in ("title", "description", "domain")])
    warnings = listed(F.when(~given("created_date"), "Missing creation date"), F.when(~given("author"), "Missing author information"))
    advice = listed(F.when(F.col("completeness") < 0.8, "Add more comprehensive documentation"), F.when(F.col("actionability") < 0.6, "Include more practical examples and implementation guides"))
    return scored.select(key, "completeness", "clarity", "actionability", errors.alias("errors"), warnings.alias("warnings"), advice.alias("suggestions")).withColumn("valid", F.col("errors") == "")


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^#+[ \t]+(.+)$"), F.lit(1))


def broken_anchors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Internal links of a Markdown text whose anchor no heading has; one row each."""
    links = F.regexp_extract_all(F.col(text), F.lit(r"\[[^\]]+\]\(#([^)]+)\)"), F.lit(1))
    anchors = F.transform(headings(F.col(text)), markup.anchor)
    return docs.select(key, F.explode(F.array_distinct(F.array_except(links, anchors))).alias("anchor"))


def control_mentions(docs: DataFrame, key: str, text: str, claimed: str, known: DataFrame) -> DataFrame:
    """Controls that are claimed and unknown, claimed and not mentioned, or mentioned and not claimed: key, control, warning."""
    said = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"NIST[- ]([A-Z]{2}-[0-9]+)"), F.lit(1)))
    tagged = lambda c, w: F.transform(c, lambda x: F.struct(x.alias("control"), F.lit(w).alias("warning")))
    silent = F.filter(F.array_distinct(claimed), lambda x: ~F.col(text).contains(x))
    rows = docs.select(key, F.array_distinct(claimed).alias("claimed"), silent.alias("silent"), F.array_except(said, F.col(claimed)).alias("extra"))
    named = rows.select(key, F.inline(F.concat(tagged(F.col("claimed"), "unknown"), tagged(F.col("silent"), "not referenced"), tagged(F.col("extra"), "not in metadata"))))
    held = known.select("control").distinct().withColumn("known", F.lit(True))
    joined = named.join(held, "control", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return joined.where(F.when(F.col("warning") == "unknown", ~F.col("known")).when(F.col("warning") == "not referenced", F.col("known")).otherwise(True)).select(key, "control", "warning")


SEMVER = r"^[0-9]+\.[0-9]+\.[0-9]+$"


def metadata_errors(version: Column, kind: Column, status: Column, risk: Column) -> Column:
    """Errors of a metadata record: a semantic version and three enumerations, joined by semicolons."""
    among = lambda c, values: F.coalesce(c.isin(*values), F.lit(False))
    return F.concat_ws(
        "; ",
        F.when(~F.coalesce(version.rlike(SEMVER), F.lit(False)), "version"),
        F.when(~among(kind, ("security", "coding", "testing", "operations")), "type"),
        F.when(~among(status, ("draft", "review", "approved", "deprecated")), "status"),
        F.when(~among(risk, ("low", "moderate", "high")), "risk"),
    )


def template_fields(control: Column, level: Column, version: Column) -> dict[str, Column]:
    """What template filters make of values: a control's display name, a level's name, an upper-case risk, a version with v."""
    levels = {"1": "Initial", "2": "Managed", "3": "Defined", "4": "Measured", "5": "Optimised"}
    name = F.lit("Unknown")
    for k, v in levels.items():
        name = F.when(level == k, v).otherwise(name)
    return {
        "control": F.when(control.rlike("^NIST-"), control).otherwise(F.concat(F.lit("NIST-"), F.upper(control))),
        "level": name,
        "version": F.when(version.startswith("v"), version).otherwise(F.concat(F.lit("v"), version)),
    }


def table_of_contents(text: Column) -> Column:
    """A Markdown list with a link for each heading."""
    return F.array_join(F.transform(headings(text), lambda h: F.concat(F.lit("- ["), F.trim(h), F.lit("](#"), markup.anchor(h), F.lit(")"))), "\n")


def sanitised(text: Column, longest: int = 1000) -> Column:
    """A query text without markup, control characters and repeated blanks, at most ``longest`` long."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[<>\"'`;\\]", ""), r"[\x00-\x1F\x7F]", " ")
    return F.substring(F.trim(F.regexp_replace(plain, " +", " ")), 1, longest)


def identifier(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_-]", "_")


def classify_sql(text: Column) -> Column:
    """Kind of a query by its words, and whether it is complex or may be cached."""
    low = F.lower(text)
    kind = F.when(low.rlike(r"^\s*select"), "select").when(low.rlike(r"^\s*insert"), "insert").when(low.rlike(r"^\s*update"), "update").when(low.rlike(r"^\s*delete"), "delete").otherwise("other")
    complex_ = low.contains("join") | low.contains("group by") | low.contains("union") | low.contains("having")
    cacheable = (kind == "select") & ~low.contains("now()") & ~low.contains("random(")
    return F.struct(kind.alias("kind"), complex_.alias("complex"), cacheable.alias("cacheable"))


#: Reviewers of each stage with their role, and days until the stage is due.
STAGES = (("technical", "technical", 2, 5), ("editorial", "editorial", 1, 8), ("community", "community", 3, 10))


def assign_reviewers(documents: DataFrame, reviewers: DataFrame, key: str, start: str) -> DataFrame:
    """Reviewers of every document for each stage: those of the stage's role who are free and know the domain, the least
    loaded first (ties by id); none reviews a document twice.

    documents: key, domain and start date. reviewers: reviewer, role, domains (array), load and capacity. Stages are
    taken in turn, each against the assignments of those before. Reviewers are joined on the domain.
    """
    free = reviewers.where(F.col("load") < F.col("capacity")).select("reviewer", "role", "load", F.explode(F.array_distinct("domains")).alias("domain"))
    # No document needs more of a role and domain than its stage takes besides those that earlier stages took.
    least_loaded = Window.partitionBy("domain", "role").orderBy("load", "reviewer")
    short = free.withColumn("at", F.row_number().over(least_loaded)).where(F.col("at") <= sum(n for _, _, n, _ in STAGES))
    done = None
    for stage, role, most, days in STAGES:
        fits = documents.join(short.where(F.col("role") == role), "domain")
        if done is not None:
            fits = fits.join(done.select(key, "reviewer"), [key, "reviewer"], "left_anti")
        order = Window.partitionBy(key).orderBy("load", "reviewer")
        chosen = fits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        rows = chosen.select(key, F.lit(stage).alias("stage"), "reviewer", "place", F.date_add(start, days).alias("due"))
        done = rows if done is None else done.unionByName(rows)
    return done


def completed(assignments: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Assignments with the first completion of each; the load of a reviewer falls by those, not below zero."""
    first = events.groupBy(*key).agg(F.min("ts").alias("completed_at"))
    return assignments.join(first, key, "left").withColumn("status", F.when(F.col("completed_at").isNotNull(), "completed").otherwise("pending"))
