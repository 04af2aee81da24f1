"""The status of scans as a state machine per scan, over events in any order.

A scan runs through stages with fixed progress values; ``done`` and ``failed``
both show 100. Events wait in the scan's state until the watermark has passed
them and are then taken in order of time and id, so that order of arrival and
repetition change nothing; a scan's waiting events are those of the watermark's
delay, no more. Timers carry both: the next waiting event, and the silence after
which a running scan counts as failed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Stages in order with the progress at their beginning and at their end.
STAGES = {"extracting": (5.0, 5.0), "reconstructing": (15.0, 73.0), "cleaning": (75.0, 78.0), "understanding": (88.0, 93.0), "previewing": (95.0, 95.0), "done": (100.0, 100.0)}
FIRST, DONE, FAILED = "extracting", "done", "failed"
#: Progress inside a stage is shown once it has grown by this much.
STEP = 1.0
#: State stores with timers need this provider.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_RANK = {name: k for k, name in enumerate(STAGES)}
_SHOWN = "scan_id long, seq int, attempt int, status string, progress int, at_us long, event_id long"


class Event(NamedTuple):
    """What a scan reports; ``fraction`` is the part of its stage that is over."""

    ts: int
    event_id: int
    status: str | None
    fraction: float | None


class State(NamedTuple):
    """Where a scan stands: rows shown so far, run, status, exact progress, last sign of life (microseconds)."""

    seq: int
    attempt: int
    status: str
    value: float
    seen: int


def expired(state: State, now: int, idle: int) -> State | None:
    """The failure of a running scan that has been silent for ``idle`` microseconds, at the moment they were over."""
    if state.status in (DONE, FAILED) or state.seen + idle > now:
        return None
    return State(state.seq + 1, state.attempt, FAILED, 100.0, state.seen + idle)


def advanced(state: State | None, event: Event) -> State | None:
    """The status after an event, or None where it changes nothing that is shown.

    A later stage, and failure, are always taken; the same stage if it has
    grown by ``STEP``; an earlier stage never. ``done`` is final. After
    ``failed`` only the first stage is taken, as a new run. A status that isn't
    known changes nothing; a scan may begin with any that is.
    """
    if event.status == FAILED:
        value = 100.0
    elif event.status in _RANK:
        begin, end = STAGES[event.status]
        value = begin + (end - begin) * min(max(event.fraction or 0.0, 0.0), 1.0)
    else:
        return None
    if state is None:
        return State(1, 1, event.status, value, event.ts)
    fresh = State(state.seq + 1, state.attempt, event.status, value, event.ts)
    if state.status == FAILED:
        return fresh._replace(attempt=state.attempt + 1) if event.status == FIRST else None
    if state.status == DONE:
        return None
    if event.status == FAILED or _RANK[event.status] > _RANK[state.status]:
        return fresh
    return fresh if event.status == state.status and value - state.value >= STEP else None


class StatusMachine(StatefulProcessor):
    """Waiting events and the status of one scan."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "seq int, attempt int, status string, value double, seen long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long, status string, fraction double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [e for frame in rows for e in _events(frame)]
        self.waiting.appendList(fresh)
        self.handle.registerTimer(min(e.ts for e in fresh) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted({e[1]: e for e in sorted((Event(*e) for e in self.waiting.get()), key=_order, reverse=True)}.values(), key=_order) if self.waiting.exists() else []
        due, later = [e for e in events if e.ts <= now], [e for e in events if e.ts > now]
        state = State(*self.current.get()) if self.current.exists() else None
        shown = []
        for event in due:
            if state and (failed := expired(state, event.ts - 1, self.idle)):
                shown.append((failed, None))
                state = failed
            if after := advanced(state, event):
                shown.append((after, event.event_id))
                state = after
            elif state:
                state = state._replace(seen=event.ts)
        if state and (failed := expired(state, now, self.idle)):
            shown.append((failed, None))
            state = failed
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if state and (due or shown):
            self.current.update(tuple(state))
        if later:
            self.handle.registerTimer(later[0].ts // 1000 + 1)
        if state and state.status not in (DONE, FAILED):
            self.handle.registerTimer((state.seen + self.idle) // 1000 + 1)
        if shown:
            yield _rows(key[0], shown)

    def close(self) -> None:
        pass


def _order(event: Event) -> tuple:
    return event.ts, event.event_id, event.status or "", event.fraction if event.fraction is not None else -1.0


def _events(frame: pd.DataFrame) -> list[Event]:
    values = zip(frame["ts_us"], frame["event_id"], frame["status"], frame["fraction"])
    return [Event(int(t), int(i), s if isinstance(s, str) else None, None if pd.isna(f) else float(f)) for t, i, s, f in values]


def _rows(scan: int, shown: list[tuple[State, int | None]]) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "scan_id": [scan] * len(shown),
            "seq": [s.seq for s, _ in shown],
            "attempt": [s.attempt for s, _ in shown],
            "status": [s.status for s, _ in shown],
            "progress": [round(s.value) for s, _ in shown],
            "at_us": [s.seen for s, _ in shown],
            "event_id": pd.array([e for _, e in shown], dtype="Int64"),
        }
    )


def transitions(events: DataFrame, late: str = "2 hours", idle_hours: float = 24.0) -> DataFrame:
    """(scan_id, seq, attempt, status, progress, at, event_id): what is shown of each scan, in order of ``seq``.

    ``events`` is a stream of (scan_id, event_id, ts, status, fraction), ``ts``
    a TIMESTAMP. Rows without scan, id or time are left out; rows that share a
    scan and an id are one, the earliest; those that come after the watermark
    has passed their time are dropped. A scan that is silent for ``idle_hours``
    fails at that moment, without an event. The session must run with ``STORE``.
    """
    whole = events.filter("scan_id is not null and event_id is not null and ts is not null").withColumn("ts_us", F.unix_micros("ts"))
    rows = whole.select("scan_id", "ts", "ts_us", F.col("event_id").cast("long"), "status", F.col("fraction").cast("double")).withWatermark("ts", late)
    machine = StatusMachine(int(idle_hours * 3_600_000_000))
    shown = rows.groupBy(F.col("scan_id").cast("long").alias("scan_id")).transformWithStateInPandas(machine, _SHOWN, "Update", "EventTime")
    return shown.select("scan_id", "seq", "attempt", "status", "progress", F.timestamp_micros("at_us").alias("at"), "event_id")
