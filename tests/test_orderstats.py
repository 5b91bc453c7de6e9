"""Order statistics, row numbers and blocked windows against plain Python and plain windows."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docsense.operators import orderstats, stats
from docsense.operators.orderstats import Rank


def _points(spark, seed=3):
    """A hot key with two thirds of the rows and many ties, a small one, one of a single point, a null key."""
    rng = random.Random(seed)
    rows = [("hot", float(rng.randrange(40))) for _ in range(2000)] + [("small", rng.random()) for _ in range(7)] + [("one", 5.0)] + [(None, rng.random()) for _ in range(60)]
    rows += [("hot", None), ("none", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "name string, value double").repartition(5)


def _by_key(rows):
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    return held


def test_percentiles_against_numpy(spark):
    rows, df = _points(spark)
    shares = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    ranks = [Rank(f"l{i}", p) for i, p in enumerate(shares)] + [Rank(f"n{i}", p, linear=False) for i, p in enumerate(shares)]
    got = {r["name"]: r for r in orderstats.percentiles(df, ["name"], "value", ranks).collect()}
    want = _by_key(rows)
    assert got.keys() == want.keys()
    for key, values in want.items():
        ordered = sorted(values)
        assert got[key]["n"] == len(values)
        for i, p in enumerate(shares):
            assert got[key][f"l{i}"] == pytest.approx(float(np.quantile(values, p)))
            assert got[key][f"n{i}"] == ordered[min(int(len(values) * p), len(values) - 1)]


def test_deviations_against_plain(spark):
    rows, df = _points(spark, 4)
    centres = orderstats.percentiles(df, ["name"], "value", [Rank("median", 0.5)])
    got = {r["name"]: r["mad"] for r in orderstats.deviations(df, ["name"], "value", centres, "median").collect()}
    for key, values in _by_key(rows).items():
        m = statistics.median(values)
        assert got[key] == pytest.approx(statistics.median(abs(v - m) for v in values))


def test_nan_sorts_last_and_empty_is_empty(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", 2.0)], "name string, value double")
    r = orderstats.percentiles(df, ["name"], "value", [Rank("low", 0.0), Rank("middle", 0.5), Rank("top", 1.0, linear=False)]).first()
    assert (r.low, r.middle) == (1.0, 2.0) and math.isnan(r.top)
    assert orderstats.percentiles(df.limit(0), ["name"], "value", [Rank("m", 0.5)]).count() == 0


def test_one_key_is_spread_over_ranges(spark):
    """No step of the ranking meets all values of the one key in one task."""
    df = spark.range(20_000).select(F.lit("hot").alias("name"), (F.col("id") * 7 % 20_011).cast("double").alias("value"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = orderstats.ranged(orderstats.counted(df, ["name"], "value"), ["name"], ["value"], "_count").withColumn("task", F.spark_partition_id())
        tasks = [r["count"] for r in placed.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 4 and max(tasks) < 8_000


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_blocked_windows_equal_plain_ones(spark, block):
    rng = random.Random(block)
    rows = [("hot", x, rng.random()) for x in range(97)] + [("b", x, rng.random()) for x in range(4)] + [("c", 0, 1.0), (None, 5, 2.0), (None, 6, 9.0)]
    df = spark.createDataFrame(rows, "name string, x int, v double")
    plain = Window.partitionBy("name").orderBy("x")
    want = {(r["name"], r.x): (r.a, r.b) for r in df.select("name", "x", F.avg("v").over(plain.rowsBetween(-3, 2)).alias("a"), F.lag("v").over(plain).alias("b")).collect()}
    dealt, by, own = orderstats.blocked(df, ["name"], ["x"], 3, 2, block)
    got = dealt.select("name", "x", "i", F.avg("v").over(by.rowsBetween(-3, 2)).alias("a"), F.lag("v").over(by).alias("b"), own.alias("own")).where("own")
    found = {(r["name"], r.x): (r.a, r.b) for r in got.collect()}
    assert got.count() == len(rows) and found.keys() == want.keys()
    for k, (a, b) in want.items():
        assert found[k] == (pytest.approx(a), b)
    ma = {(r["name"], r.x): r.ma for r in stats.moving_average(df, "name", "x", "v", 5, block).collect()}
    hot = [v for k, _, v in rows if k == "hot"]
    assert [ma["hot", i] for i in range(93)] == [pytest.approx(sum(hot[i : i + 5]) / 5, abs=1e-6) for i in range(93)] and ("hot", 93) not in ma
