"""Quality scores and issues of standards, recommendations, coverage counts and reports.

A standard has title, description, domain, created_date (text), and booleans examples, guidelines, implementation_guides
and code_examples. Missing text is null or empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the quality score.
WEIGHTS = {"completeness": 0.25, "consistency": 0.2, "clarity": 0.2, "actionability": 0.15, "coverage": 0.1, "maintenance": 0.1}
REQUIRED = ("title", "description", "domain", "created_date")
OPTIONAL = ("examples", "guidelines", "implementation_guides", "code_examples")
COVERAGE = 0.8


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def _part(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def parsed_date(text: Column) -> Column:
    """ISO date or time, with Z for UTC; null where it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def maintenance(days: Column) -> Column:
    """1 for a year, then a slow decay to one half; 1 without a date."""
    return F.when(days > 365, F.greatest(F.lit(0.5), 1 - (days - 365) / 1000)).otherwise(1.0)


def quality_scores(standards: DataFrame, key: str, now: Column) -> DataFrame:
    """The six parts of the quality score and their weighted sum."""
    length = F.length(F.coalesce("description", F.lit("")))
    created = parsed_date(F.col("created_date"))
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(created)) / 86400)
    held = reduce(lambda a, b: a + b, [_part(_given(c), 1.0) for c in REQUIRED] + [_part(F.col(c), 0.5) for c in OPTIONAL])
    parts = {
        "completeness": F.least(held / (len(REQUIRED) + 0.5 * len(OPTIONAL)), F.lit(1.0)),
        "consistency": F.when(F.col("created_date").isNotNull() & created.isNull(), 0.8).otherwise(1.0),
        "clarity": F.when(length < 50, 0.3).when(length < 200, 0.7).otherwise(1.0),
        "actionability": _part(F.col("code_examples"), 0.4) + _part(F.col("implementation_guides"), 0.4) + _part(F.col("examples"), 0.2),
        "coverage": F.lit(COVERAGE),
        "maintenance": maintenance(days),
    }
    scored = standards.select(key, *[v.alias(k) for k, v in parts.items()])
    overall = reduce(lambda a, b: a + b, [F.col(k) * w for k, w in WEIGHTS.items()])
    return scored.select(key, *[F.round(c, 6).alias(c) for c in parts], F.round(overall, 6).alias("quality"))


#: What to do about a missing field.
ADVICE = {
    "title": "Add a clear, descriptive title",
    "description": "Add a comprehensive description",
    "domain": "Specify the domain or category",
    "created_date": "Add creation date for tracking",
}


def quality_issues(standards: DataFrame, key: str) -> DataFrame:
    """One row an issue: aspect, issue, effort and first step."""
    row = lambda *x: F.struct(*[F.lit(v).alias(c) for v, c in zip(x, ("aspect", "issue", "effort", "step"))])
    found = [F.when(~_given(c), row("completeness", f"Missing {c}", "low", ADVICE[c])) for c in REQUIRED]
    found.append(F.when(F.length(F.coalesce("description", F.lit(""))) < 100, row("clarity", "Description is too brief", "medium", "Expand description with more detail")))
    found.append(F.when(~F.col("code_examples") & ~F.col("implementation_guides"), row("actionability", "Lacks practical examples", "medium", "Add code examples")))
    return standards.select(key, F.inline(F.array_compact(F.array(*found))))


def quality_recommendations(scores: DataFrame, issues: DataFrame, key: str, least: float = 0.7, urgent: float = 0.5, most: int = 20) -> DataFrame:
    """Issues of the ``most`` worst standards below ``least``; high priority below ``urgent``. Ties by key."""
    worst = scores.where(F.col("quality") < least).orderBy("quality", key).limit(most).select(key, "quality")
    return worst.join(issues, key).select(key, "quality", "aspect", "issue", "effort", F.when(F.col("quality") < urgent, "high").otherwise("medium").alias("priority"))


def coverage_counts(standards: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """kind, value and n: how many standards name each value of the arrays in ``kinds``."""

    def of(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    named = F.flatten(F.array(*[of(k, c) for k, c in kinds.items()]))
    return standards.select(F.inline(named)).where("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def sparse_values(counts: DataFrame, share: float = 0.5) -> DataFrame:
    """Values with fewer than ``share`` of their kind's mean count; kinds are few, so the means are joined by kind."""
    means = counts.groupBy("kind").agg(F.avg("n").alias("mean"))
    return counts.join(means, "kind").where(F.col("n") < share * F.col("mean")).select("kind", "value", "n", F.round("mean", 6).alias("mean"))


def recommendations(**kinds: DataFrame) -> DataFrame:
    """Recommendations of several sources as one table: kind, subject, priority, reason."""
    rows = [df.select(F.lit(k).alias("kind"), F.col("subject").cast("string"), "priority", "reason") for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, rows)


def report(**sections: DataFrame) -> DataFrame:
    """One row a section and record, as JSON: what an exported report holds."""
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("record")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, rows)


def compliance_score(verified: Column, required: Column) -> Column:
    """Verified requirements over all, at most 1; 0 without any."""
    return F.least(F.coalesce(F.try_divide(F.size(verified).cast("double"), F.size(required).cast("double")), F.lit(0.0)), F.lit(1.0))
