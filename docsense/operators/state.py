"""Stateful admission: rate limits, breakers, cooldowns and caches over ordered events.

A decision depends on earlier ones, so events are taken in order. A machine is a function ``step(state, t, value)`` that
gives the decision and the next state; its state is small (at most as many numbers as events may pass) and made of plain
lists and numbers, so that the same machine serves tables (`fold`) and streams (`docsense.streaming.state`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[list | None, float, object], tuple[object, list]]


def admit(window: float, most: int) -> Step:
    """Sliding-window log: an event passes if fewer than ``most`` passed within ``window`` before it; rejections aren't logged."""

    def step(log, t, _):
        log = [x for x in log or [] if x > t - window]
        return len(log) < most, log + [t] if len(log) < most else log

    return step


def admit_tiers(tiers: list[tuple[float, int]]) -> Step:
    """All tiers must agree; a passed event counts once in each."""

    def step(logs, t, _):
        logs = [[x for x in log if x > t - window] for log, (window, _) in zip(logs or [[] for _ in tiers], tiers)]
        ok = all(len(log) < most for log, (_, most) in zip(logs, tiers))
        return ok, [log + [t] for log in logs] if ok else logs

    return step


def breaker(limit: int, rest: float) -> Step:
    """Circuit state at each call (value: whether it failed): opens after ``limit`` failures in a row, half open after ``rest``, closes on success."""

    def step(state, t, bad):
        fails, opened = state or [0, None]
        if opened is not None and t - opened < rest:
            return "open", [fails, opened]
        seen = "closed" if opened is None else "half_open"
        if not bad:
            return seen, [0, None]
        return seen, [fails + 1, t if fails + 1 >= limit or opened is not None else None]

    return step


def cooldown(limit: float, rest: float) -> Step:
    """Alerts on values above ``limit``, at most one in ``rest`` from the last one that fired; a null value doesn't fire."""

    def step(last, t, value):
        fire = value is not None and value > limit and (not last or t - last[0] >= rest)
        return fire, [t] if fire else last or []

    return step


def cache_hits(ttl: float) -> Step:
    """Hits of a cache filled on a miss and not refreshed on a hit."""

    def step(filled, t, _):
        hit = bool(filled) and t - filled[0] < ttl
        return hit, filled if hit else [t]

    return step


def alerts(limit: float, rest: float) -> Step:
    """What a threshold alert does at each value: fired, active, suppressed (within ``rest`` of the last that fired),
    resolved or none. The cooldown goes on after an alert is resolved. A null value counts as below."""

    def step(state, t, value):
        active, last = state or [False, None]
        if value is None or value <= limit:
            return ("resolved" if active else "none"), [False, last]
        if active:
            return "active", [True, last]
        if last is not None and t - last < rest:
            return "suppressed", [False, last]
        return "fired", [True, t]

    return step


def checked_alerts(limit: float, rest: float) -> Step:
    """Alerts checked at most once in ``rest``: skipped, fired (if not active), active, resolved or none."""

    def step(state, t, value):
        checked, active = state or [None, False]
        if checked is not None and t - checked < rest:
            return "skipped", [checked, active]
        over = value is not None and value > limit
        outcome = ("active" if active else "fired") if over else ("resolved" if active else "none")
        return outcome, [t, over]

    return step


def admit_queue(window: float, most: int, room: int, patience: float) -> Step:
    """A limit with a queue: allowed, queued (if fewer than ``room`` wait; one waits for ``patience`` at most) or rejected."""

    def step(state, t, _):
        log, waiting = state or [[], []]
        log, waiting = [x for x in log if x > t - window], [x for x in waiting if x > t - patience]
        if len(log) < most:
            return "allowed", [log + [t], waiting]
        if len(waiting) < room:
            return "queued", [log, waiting + [t]]
        return "rejected", [log, waiting]

    return step


def adaptive(base: int, rate: float = 0.1) -> Step:
    """The limit that a reputation gives: half again above .8, half below .3. It starts at .5 and follows successes
    (value: whether the event was bad) as a moving average."""

    def step(state, t, bad):
        reputation = (1 - rate) * (state or [0.5])[0] + rate * (0.0 if bad else 1.0)
        near = round(reputation, 9)
        return str(int(base * (1.5 if near > 0.8 else 0.5 if near < 0.3 else 1.0))), [reputation]

    return step


def replay(step: Step, times: Iterable[float], values: Iterable | None = None) -> list:
    """Decisions of a machine over events in order."""
    state, out, times = None, [], list(times)
    for t, value in zip(times, values or [None] * len(times)):
        decision, state = step(state, t, value)
        out.append(decision)
    return out


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def fold(events: DataFrame, key: str, step: Step, column: str, kind: str, value: Column | None = None) -> DataFrame:
    """(key, event_id, decision) of every event, by key in the order of ts and event_id.

    Each key's events are sorted within one partition and pass by in batches with the state carried along: memory is
    that of one batch and one state, however many events a key has. Null keys are one key.
    """
    key_type = dict(events.dtypes)[key]
    rows = events.select(key, "event_id", seconds(F.col("ts")).alias("t"), (F.lit(None).cast("boolean") if value is None else value).alias("value"))
    ordered = rows.repartition(key).sortWithinPartitions(key, "t", "event_id")

    def run(batches):
        current, state = object(), None
        for batch in batches:
            keys, times, values = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for k, t, v in zip(keys, times, values):
                if k != current:
                    current, state = k, None
                decision, state = step(state, t, v)
                out.append(decision)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_() if kind == "boolean" else pa.string())], names=[key, "event_id", column])

    return ordered.mapInArrow(run, f"{key} {key_type}, event_id long, {column} {kind}")
