"""Timed state machines on streams equal the batch fold, in whatever order events arrive, and end by themselves."""

import random

import pytest
from pyspark.sql import functions as F

from docsense.operators import state
from docsense.streaming import timed
from docsense.streaming.usage import drain, read_events

ROWS = "user_id long, event_id long, ts timestamp_ntz, value double"


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def _run(spark, folder, batches, make):
    """The stream's rows for files that arrive one after another; the last event of all moves the watermark past the others."""
    for i, rows in enumerate([*batches, [(-1, -1, "2030-01-01 00:00:00", 0.0)], [(-1, -2, "2031-01-01 00:00:00", 0.0)]]):
        df = spark.createDataFrame([(u, e, t, v) for u, e, t, v in rows], "user_id long, event_id long, ts string, value double")
        df.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value").coalesce(1).write.mode("append").parquet(str(folder / "in"))
    events = read_events(spark, str(folder / "in"), ROWS)
    drain(make(events), str(folder / "out"), str(folder / "check"))
    return [r for r in spark.read.parquet(str(folder / "out")).collect() if r.user_id != -1]


def _at(minute):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    rng = random.Random(4)
    events = [(u, 100 * u + i, m, rng.random()) for u in range(4) for i, m in enumerate(sorted(rng.sample(range(0, 240), 25)))]
    step = state.admit(1800.0, 3)
    want = {}
    for u in range(4):
        held = None
        for _, e, m, _ in sorted((r for r in events if r[0] == u), key=lambda r: (r[2], r[1])):
            want[e], held = step(held, m * 60.0, None)
    shuffled = [(u, e, _at(m), v) for u, e, m, v in sorted(events, key=lambda r: r[2] + rng.uniform(-25, 25))]
    rows = _run(spark, tmp_path, [shuffled[i : i + 20] for i in range(0, 100, 20)], lambda s: timed.decide(s, "user_id", step, "allowed", "boolean", late="90 minutes", idle=1e6))
    assert {r.event_id: r.allowed for r in rows} == want and False in want.values()


def test_an_alert_resolves_by_its_timer(spark, tmp_path):
    """The key falls silent after firing: the timer says so, its state goes, and a later event starts anew."""
    step = state.cooldown(0.5, 3600.0)
    rows = [[(1, 1, _at(0), 0.9), (2, 2, _at(1), 0.1)], [(1, 3, _at(5), 0.95)], [(3, 9, _at(200), 0.0)], [(1, 4, _at(210), 0.7)], [(3, 10, _at(400), 0.0)]]
    make = lambda s: timed.decide(s, "user_id", step, "fired", "boolean", F.col("value"), "1 minute", 1800.0, lambda held, t: False if held else None)
    got = sorted((r.user_id, r.t / 60 - 28401120, r.event_id, r.fired) for r in _run(spark, tmp_path, rows, make) if r.user_id == 1)
    assert [(m, e, f) for _, m, e, f in got] == [(0, 1, True), (5, 3, False), (35, None, False), (210, 4, True), (240, None, False)]
