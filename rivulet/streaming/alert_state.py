"""Streaming ``for`` hold: the life of an alert kept per (alert, series) in state.

Active elements arrive as rows ``alert, lkey, t (ms), value, for_ms``, in any order inside the lateness.
A row waits in list state until the watermark has passed its step; then the steps are evaluated in order:

* the first step of a run is ``pending``, and ``firing`` from ``for`` on;
* an event-time timer wakes the key at the step that must follow.  If that step is missing, the
  run is over: a firing alert comes out once more as ``resolved`` at the missing step, a pending
  one just ends, and the key's state is removed.

So a series that stops being active holds no state, and every step is evaluated once.  A row that comes
after the watermark has passed its step is dropped by Spark and counted in the operator's progress;
``dropped_rows`` reads that count, so nothing vanishes unnoticed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.time import instant_from_millis
from ..session import let_workers_import

OUTPUT_SCHEMA = "alert string, lkey string, t long, value double, active_since long, state string"
RESOLVED = "resolved"
LATENESS = "0 seconds"


def evaluate_hold(rows: pd.DataFrame, step_ms: int, run: tuple[int, int, int] | None, until: int):
    """(result rows, open run) of due rows (t, value, for_ms; distinct t in order) after an open run.

    A run is (first step, last step, hold in ms).  It stays open while the step after its
    last one is later than ``until``.
    """
    k, hold = rows["t"].to_numpy(np.int64) // step_ms, rows["for_ms"].to_numpy(np.int64)
    value = rows["value"].to_numpy(float)
    if run is not None:                                          # the open run's last step, evaluated before
        k, hold, value = np.r_[run[1], k], np.r_[run[2], hold], np.r_[np.nan, value]
    if not len(k):
        return _states([], [], [], []), None
    opened = np.r_[True, k[1:] != k[:-1] + 1]
    first = np.maximum.accumulate(np.where(opened, k, k[0]))
    if run is not None:
        first[first == k[0]] = run[0]
    firing = (k - first) * step_ms >= hold
    over = np.r_[opened[1:], (k[-1] + 1) * step_ms <= until]
    ended = np.flatnonzero(over & firing)
    new = np.arange(len(k)) >= (run is not None)
    t = np.r_[k[new], k[ended] + 1] * step_ms
    state = np.r_[np.where(firing[new], "firing", "pending").astype(object), np.full(len(ended), RESOLVED, object)]
    out = _states(t, np.r_[value[new], np.full(len(ended), np.nan)], np.r_[first[new], first[ended]] * step_ms, state)
    return out, None if over[-1] else (int(first[-1]), int(k[-1]), int(hold[-1]))


def _states(t, value, since, state) -> pd.DataFrame:
    value = pd.Series(np.asarray(value, float))
    return pd.DataFrame({"t": np.asarray(t, np.int64), "value": value.astype(object).where(value.notna(), None),
                         "active_since": np.asarray(since, np.int64), "state": np.asarray(state, object)})


class Hold(StatefulProcessor):
    def __init__(self, step_ms: int):
        self.step_ms = step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, value double, for_ms long")
        self.run = handle.getValueState("run", "first long, last long, for_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [r for p in rows for r in zip(p["t"], p["value"], p["for_ms"])], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues)

    def _advance(self, key, new, timerValues):
        until = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        rows = pd.DataFrame([*held, *new], columns=["t", "value", "for_ms"]).astype(
            {"t": "int64", "value": "float64", "for_ms": "int64"})
        rows = rows.sort_values("t", kind="stable").drop_duplicates("t")              # a step delivered twice counts once
        due, later = rows[rows["t"] <= until], rows[rows["t"] > until]
        run = tuple(self.run.get()) if self.run.exists() else None
        out, run = evaluate_hold(due, self.step_ms, run, until)
        wake = []
        if len(later):
            self.waiting.put([(int(t), float(v), int(f)) for t, v, f in later.itertuples(index=False)])
            wake.append(int(later["t"].iloc[0]))
        else:
            self.waiting.clear()
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
            wake.append((run[1] + 1) * self.step_ms)
        if wake:
            self.handle.registerTimer(min(wake))
        if len(out):
            out.insert(0, "lkey", key[1])
            out.insert(0, "alert", key[0])
            yield out

    def close(self) -> None:
        pass


def hold_stream(active: DataFrame, step_ms: int, lateness: str = LATENESS) -> DataFrame:
    """Pending, firing and resolved states of a stream of active elements (append output)."""
    let_workers_import(active.sparkSession)
    timed = active.withColumn("at", instant_from_millis("t")).withWatermark("at", lateness)
    return timed.groupBy("alert", "lkey").transformWithStateInPandas(Hold(step_ms), OUTPUT_SCHEMA, "Append", "EventTime")


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came too late in the micro-batches that the query still remembers."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])
