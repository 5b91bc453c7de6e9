"""Every query with SQL equals its oracle at the smallest scale; streams equal their batch twins."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docsense import catalog
from docsense.sources.tables import table
from docsense.streaming import usage as streams
from tests.conftest import SF


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        names = [x[0] for x in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_stream_equals_batch(spark, tmp_path):
    events = table(spark, SF, "events")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), events.schema)
    streams.drain(streams.windowed(stream, "0 seconds", "1 hour", "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    want = {(r.start, r.event_type): r.n for r in events.groupBy(w.alias("w"), "event_type").count().select("w.start", "event_type", F.col("count").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 5
