"""State machines on streams in event time, with state that ends.

Events wait until the watermark has passed them and are then taken in the order of their times, so decisions equal those of
the batch fold (`docsense.operators.state`) for all events within the watermark, whatever the order of arrival; later ones are
left out, as in any windowed stream. A key that sees no event for ``idle`` seconds is done: its machine may have a last word,
such as an alert that resolves by itself, and then its state is removed. Waiting events, the machine's state and one mark are
all that is kept for a key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docsense.operators.state import Step, seconds

#: What a machine says when its key has been idle: a decision, or None for nothing.
Lapse = Callable[[object, float], object]


class Ordered(StatefulProcessor):
    """Runs ``step`` over a key's events in the order of (time, event_id)."""

    def __init__(self, key: str, column: str, step: Step, idle: float, lapse: Lapse | None):
        self.key, self.column, self.step, self.idle, self.lapse = key, column, step, idle, lapse

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t double, event_id long, value string")
        self.machine = handle.getValueState("machine", "state string, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            told = list(zip(frame["t"].tolist(), frame["event_id"].tolist(), frame["value"].tolist()))
            self.waiting.appendList(told)
            for at in {int(t * 1000) for t, _, _ in told}:
                self.handle.registerTimer(at)
        yield pd.DataFrame({self.key: [], "event_id": [], self.column: [], "t": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in held if int(r[0] * 1000) <= now * 1000]
        state, last = (lambda s: (json.loads(s[0]), s[1]))(self.machine.get()) if self.machine.exists() else (None, None)
        out = []
        for t, event_id, value in due:
            if last is not None and t - last >= self.idle:
                out += self._end(key, state, last)
                state = None
            decision, state = self.step(state, t, json.loads(value))
            out.append((key[0], event_id, decision, t))
            last = t
        later = held[len(due) :]
        if due:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        if last is not None and now >= last + self.idle and not (later and later[0][0] < last + self.idle):
            out += self._end(key, state, last)
            self.machine.clear()
        elif due:
            self.machine.update((json.dumps(state), last))
            self.handle.registerTimer(int((last + self.idle) * 1000) + 1)
        yield pd.DataFrame(out, columns=[self.key, "event_id", self.column, "t"])

    def _end(self, key, state, last: float) -> list[tuple]:
        said = self.lapse(state, last + self.idle) if self.lapse else None
        return [] if said is None else [(key[0], None, said, last + self.idle)]

    def close(self) -> None:
        pass


def decide(events: DataFrame, key: str, step: Step, column: str, kind: str, value: Column | None = None, late: str = "10 minutes", idle: float = 86_400.0, lapse: Lapse | None = None) -> DataFrame:
    """key, event_id, the decision and t (seconds) of every event of a stream (key, event_id, event_time), and a row without
    event_id for each key that ``lapse`` has a last word on.

    Null keys are left out. The stream needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    key_type = dict(events.dtypes)[key]
    told = F.lit("null") if value is None else F.coalesce(F.to_json(F.array(value)), F.lit("[null]"))
    plain = told if value is None else F.expr("substring(told, 2, length(told) - 2)")
    rows = events.where(F.col(key).isNotNull()).withWatermark("event_time", late).withColumn("told", told)
    rows = rows.select(key, F.col("event_id").cast("long").alias("event_id"), "event_time", seconds(F.col("event_time").cast("timestamp_ntz")).alias("t"), plain.alias("value"))
    schema = f"{key} {key_type}, event_id long, {column} {kind}, t double"
    return rows.groupBy(key).transformWithStateInPandas(Ordered(key, column, step, idle, lapse), schema, "Append", "eventTime")
