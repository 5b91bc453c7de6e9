"""Review workflow: available reviewers, due dates, workload, overdue reviews and progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days from the assignment of a document to start and end of each stage.
STAGES = {"technical": (0, 5), "editorial": (5, 8), "community": (3, 10)}


def due_dates(assignments: DataFrame, stage: str, assigned: str) -> DataFrame:
    """Start and due date of each assignment by its stage; null for a stage that isn't known."""
    when = lambda i: F.coalesce(*[F.when(F.col(stage) == s, F.date_add(assigned, days[i])) for s, days in STAGES.items()])
    return assignments.withColumns({"starts": when(0), "due": when(1)})


def available(reviewers: DataFrame, roles: Sequence[str], domains: Sequence[str] = ()) -> DataFrame:
    """Reviewers (role, domains, capacity, load) of the roles with room left and, if domains are given, one in common."""
    fit = F.col("role").isin(*roles) & (F.col("load") < F.col("capacity"))
    return reviewers.where(fit & F.arrays_overlap("domains", F.array(*map(F.lit, domains))) if domains else fit)


def overdue(status: Column, due: Column, now: Column) -> Column:
    """The status, with ``overdue`` for open reviews past their date."""
    return F.when((status != "completed") & (due < now), "overdue").otherwise(status)


def workload(reviewers: DataFrame, assignments: DataFrame, key: str) -> DataFrame:
    """Assignments of each reviewer by status, zero for reviewers without any. Assignments are counted before the join."""
    counts = assignments.groupBy(key).agg(F.count(F.lit(1)).alias("assigned"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "overdue").alias("overdue"))
    return reviewers.select(key).join(counts, key, "left").na.fill(0, ["assigned", "completed", "overdue"])


def progress(assignments: DataFrame, key: str) -> DataFrame:
    """Assignments of each document, how many are completed, and the share in percent."""
    done = F.count_if(F.col("status") == "completed")
    return assignments.groupBy(key).agg(F.count(F.lit(1)).alias("reviews"), done.alias("completed"), F.round(100.0 * done / F.count(F.lit(1)), 6).alias("percent"))
