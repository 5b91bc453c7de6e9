"""Exact order statistics and row numbers of keys of any size, without a key in one task.

Points collapse to (key, value, count), are range-partitioned by key and value and written once, so that the ranges stay
fixed. A range's place in its key is the sum of the counts of the ranges before it, a prefix sum over as many rows as there
are ranges; a value's first rank is that plus a running sum within its range. Percentiles pick the values that cover their
ranks in a partial aggregate. One key that holds all points is spread over all ranges.

Null values are no points; NaN sorts last. Keys may be null. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsense.operators.staging import staged


def of_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys where null equals null; the columns of ``a`` and the others of ``b``."""
    renamed = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])


def ranged(rows: DataFrame, keys: list[str], order: list[str], weight: str) -> DataFrame:
    """``rows`` with _before (the weight of all rows of the key that come earlier) and _total (that of the key).

    ``order`` must tell the rows of a key apart. Rows are written once, range-partitioned by key and order.
    """
    placed = staged(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*keys, "_range").agg(F.sum(weight).alias("_sum"))
    of_key = Window.partitionBy(*keys)
    starts = sums.select(*keys, "_range", (F.sum("_sum").over(of_key.orderBy("_range")) - F.col("_sum")).alias("_start"), F.sum("_sum").over(of_key).alias("_total"))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("_running", F.sum(weight).over(within) - F.col(weight))
    return of_keys(running, starts, [*keys, "_range"]).withColumn("_before", F.col("_start") + F.col("_running")).drop("_range", "_start", "_running")


def counted(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys, value and _count: how often each key has each value."""
    return points.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with i (from 1, in order) and n (rows of the key). ``order`` must tell the rows of a key apart."""
    out = ranged(rows.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one")
    return out.withColumns({"i": F.col("_before") + 1, "n": F.col("_total")}).drop("_one", "_before", "_total")


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (an int from 1) in one order over all of them; ``order`` must tell them apart."""
    return numbered(rows.withColumn("_all", F.lit(0)), ["_all"], order).withColumn(name, F.col("i").cast("int")).drop("_all", "i", "n")


@dataclass(frozen=True)
class Rank:
    """A percentile of a key's sorted values.

    ``linear`` interpolates at share * (n - 1); ``nearest`` is the element at int(n * share), clamped to the last.
    """

    name: str
    share: float
    linear: bool = True

    def place(self) -> Column:
        n = F.col("_total")
        return (n - 1) * F.lit(float(self.share)) if self.linear else F.least(F.floor(n * F.lit(float(self.share))), n - 1).cast("double")


def of_counts(counts: DataFrame, keys: list[str], value: str, ranks: list[Rank]) -> DataFrame:
    """Keys, n and the named percentiles, from the distinct values and counts of `counted`."""
    placed = ranged(counts, keys, [value], "_count")
    last = F.col("_before") + F.col("_count") - 1
    picks = []
    for i, rank in enumerate(ranks):
        at = rank.place()
        for side, r in (("low", F.floor(at)), ("high", F.ceil(at))):
            picks.append(F.max(F.when((F.col("_before") <= r) & (r <= last), F.col(value))).alias(f"_{side}{i}"))
    picked = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)

    def between(i: int, rank: Rank) -> Column:
        part = rank.place() - F.floor(rank.place())
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    return picked.select(*keys, F.col("_total").alias("n"), *[(between(i, r) if r.linear else F.col(f"_low{i}")).alias(r.name) for i, r in enumerate(ranks)])


def percentiles(points: DataFrame, keys: list[str], value: str, ranks: list[Rank]) -> DataFrame:
    """Keys, n (points with a value) and the named percentiles."""
    return of_counts(counted(points, keys, value), keys, value, ranks)


def deviations(points: DataFrame, keys: list[str], value: str, centres: DataFrame, centre: str, name: str = "mad") -> DataFrame:
    """Keys and the median absolute deviation from ``centre``, a column of ``centres`` (one row a key)."""
    around = of_keys(counted(points, keys, value), centres.select(*keys, centre), keys)
    apart = around.groupBy(*keys, F.abs(F.col(value) - F.col(centre)).alias("_apart")).agg(F.sum("_count").alias("_count"))
    return of_counts(apart.where("_apart is not null"), keys, "_apart", [Rank(name, 0.5)]).drop("n")


#: Rows of a key that one task of a moving window takes.
BLOCK = 100_000


def blocked(rows: DataFrame, keys: list[str], order: list[str], before: int, after: int, block: int = BLOCK) -> tuple[DataFrame, Window, Column]:
    """For windows of at most ``before`` preceding and ``after`` following rows: numbered rows dealt into blocks, each with
    the neighbours its own rows look at; the window specification over a block; and which rows are a block's own.

    A window function over the specification, filtered by the last, equals one over the whole key.
    """
    at = numbered(rows, keys, order)
    own = F.floor((F.col("i") - 1) / block)
    first, last = F.floor((F.col("i") - 1 - after) / block), F.floor((F.col("i") - 1 + before) / block)
    dealt = at.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.floor((F.col("n") - 1) / block)))))
    return dealt, Window.partitionBy(*keys, "_block").orderBy("i"), F.col("_block") == own
