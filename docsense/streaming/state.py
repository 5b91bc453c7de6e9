"""Streaming twin of the stateful admission operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from docsense.operators.state import Step, seconds


def decide(events: DataFrame, key: str, step: Step, column: str, kind: str, value: Column | None = None) -> DataFrame:
    """(key, event_id, decision) of every event of a stream (key, event_id, ts) as it arrives.

    A key's events of one micro-batch are taken in order; between micro-batches the order of arrival holds. Only the
    machine's state is kept.
    """
    key_type = dict(events.dtypes)[key]
    rows = events.select(key, F.col("event_id").cast("long").alias("event_id"), seconds(F.col("ts")).alias("t"), (F.lit(None).cast("boolean") if value is None else value).alias("value"))

    def run(group: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["t", "event_id"], kind="stable")
        state = json.loads(held.get[0]) if held.exists else None
        out = []
        for t, v in zip(frame["t"].tolist(), frame["value"].tolist()):
            decision, state = step(state, t, v)
            out.append(decision)
        held.update((json.dumps(state),))
        yield pd.DataFrame({key: frame[key], "event_id": frame["event_id"], column: out})

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, event_id long, {column} {kind}", "state string", "append", GroupStateTimeout.NoTimeout)
