"""Sliding windows over a stream as panes: one pane per step, merged per key.

A window ``(t - range, t]`` that slides by ``step`` is the union of ``range / step`` panes.  Two chained
stateful operators build it:

1. a windowed aggregate makes one row per (key, pane) and hands it on when the watermark closes
   the pane.  Rows of a hot key are spread over its panes, and rows that arrive out of order inside the
   lateness find their pane;
2. ``transformWithStateInPandas`` keeps the panes of a key that a later step can still reach as list
   state.  An event-time timer wakes the key at its next step, so steps after a key's last pane are emitted as
   well; panes that no step can reach any more leave the state, and a key without panes has none.

Each step is emitted once, when the watermark has passed it (append mode).  State rows are panes, not
windows, and no input row is copied into the windows it belongs to.

``rate``, ``delta`` and instant vectors use panes of samples (first and last sample, increase inside
the pane); hopping tables use panes of counts and sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.time import instant_from_millis
from ..session import let_workers_import

LATENESS = "10 minutes"


# ---------------------------------------------------------------- merging panes
#
# A null and a NaN are one and the same in pandas.  So panes say whether a reading is known (``first_ok``, ``last_ok``; a
# NaN is) and of how many it is the sum (``rises``, ``known``), and every merged value comes with whether it is known.

def _sums(panes: pd.DataFrame, lo: np.ndarray, hi: np.ndarray, column: str) -> np.ndarray:
    """Sum of a column over the panes ``lo .. hi`` of each step (0 for none)."""
    padded = np.r_[panes[column].to_numpy(float), 0.0]
    bounds = np.column_stack([lo, hi + 1]).ravel()
    return np.where(lo <= hi, np.add.reduceat(padded, bounds)[::2], 0.0)


def _rise(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Counter increase between two readings; a fall is a reset, and after an unknown reading all counts."""
    return np.where(after >= before, after - before, after)


def _increase(panes, lo, hi, range_s):
    ok = panes["first_ok"].to_numpy() > 0
    cross = np.r_[0.0, _rise(panes["last_v"].to_numpy()[:-1], panes["first_v"].to_numpy()[1:])]     # from the pane before
    p = panes.assign(cross=np.where(ok, cross, 0.0), ok=ok)
    total = _sums(p, lo, hi, "inc") + _sums(p, lo + 1, hi, "cross")
    return total, _sums(p, lo, hi, "n") >= 2, _sums(p, lo, hi, "rises") + _sums(p, lo + 1, hi, "ok") > 0


def _rate(panes, lo, hi, range_s):
    total, enough, known = _increase(panes, lo, hi, range_s)
    return total / range_s, enough, known


def _delta(panes, lo, hi, range_s):
    at = np.flatnonzero(panes["last_ok"].to_numpy())                        # panes with a known reading
    first, last = np.searchsorted(at, lo, "left"), np.searchsorted(at, hi, "right") - 1
    known = first <= last
    value = np.full(len(lo), np.nan)
    value[known] = panes["last_v"].to_numpy()[at[last[known]]] - panes["first_v"].to_numpy()[at[first[known]]]
    return value, _sums(panes, lo, hi, "n") >= 2, known


def _last(panes, lo, hi, range_s):
    return panes["last_v"].to_numpy()[hi], np.ones(len(lo), bool), panes["last_ok"].to_numpy()[hi] > 0


MERGES = {"rate": _rate, "increase": _increase, "delta": _delta, "instant": _last}
SAMPLE_PANE = "end long, first_v double, last_v double, inc double, n long, first_ok long, last_ok long, rises long"
COUNT_PANE = "end long, n long, total double, known long"


def merge(panes: pd.DataFrame, kind: str, after: int | None, until: int, range_ms: int, step_ms: int):
    """(steps t, values) of the steps in ``(after, until]`` (``after`` None: up to ``until``) whose window holds panes
    (sorted by ``end``)."""
    end = panes["end"].to_numpy(np.int64)
    reach = np.minimum(end + range_ms, until + step_ms)                     # first step that doesn't hold the pane
    starts = end if after is None else np.maximum(end, after + step_ms)
    t = np.unique(np.concatenate([np.arange(a, b, step_ms) for a, b in zip(starts, reach)] or [np.empty(0, np.int64)]))
    t = t.astype(np.int64)
    if not len(t):
        return t, [np.empty(0)]
    lo, hi = np.searchsorted(end, t - range_ms, "right"), np.searchsorted(end, t, "right") - 1
    with np.errstate(invalid="ignore"):                                     # infinity less infinity
        if kind == "count":
            return t, [_sums(panes, lo, hi, "n").astype(np.int64), _sums(panes, lo, hi, "total"),
                       _sums(panes, lo, hi, "known").astype(np.int64)]
        value, enough, known = MERGES[kind](panes, lo, hi, range_ms / 1000.0)
    return t[enough], [value[enough], known[enough]]


class Sliding(StatefulProcessor):
    """Merges a key's panes into one row per step."""

    def __init__(self, kind: str, keys: Sequence[str], pane: str, values: Sequence[str], range_ms: int, step_ms: int):
        self.kind, self.keys, self.pane, self.values = kind, list(keys), pane, list(values)
        self.range_ms, self.step_ms = range_ms, step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.panes = handle.getListState("panes", self.pane)
        self.done = handle.getValueState("done", "step long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.pane.split(", ")]
        yield from self._advance(key, [tuple(r) for p in rows for r in p[names].itertuples(index=False)], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues)

    def _advance(self, key, new, timerValues):
        names = [c.split()[0] for c in self.pane.split(", ")]
        held = list(self.panes.get()) if self.panes.exists() else []
        kinds = {c: "float64" if k == "double" else "int64" for c, k in (c.split() for c in self.pane.split(", "))}
        panes = pd.DataFrame([*held, *new], columns=names).astype(kinds).sort_values("end", ignore_index=True)
        until = timerValues.getCurrentWatermarkInMs() // self.step_ms * self.step_ms
        after = self.done.get()[0] if self.done.exists() else None
        t, values = merge(panes, self.kind, after, until, self.range_ms, self.step_ms)
        kept = panes[panes["end"] > until + self.step_ms - self.range_ms]
        if len(kept):
            self.panes.put([tuple(r) for r in kept.itertuples(index=False)])
            self.done.update((until if after is None else max(after, until),))
            self.handle.registerTimer(int(max(until + self.step_ms, kept["end"].iloc[0])))
        else:
            self.panes.clear()
            self.done.clear()
        if len(t):
            out = {k: [v] * len(t) for k, v in zip(self.keys, key)} | {"t": t} | dict(zip(self.values, values))
            out["at"] = pd.to_datetime(t, unit="ms")
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def slide(panes: DataFrame, kind: str, keys: Sequence[str], pane: str, values: Sequence[str], types: Sequence[str],
          range_ms: int, step_ms: int) -> DataFrame:
    """keys, t (ms), values and ``at`` (t as the event time of the result) of every step."""
    if range_ms % step_ms:
        raise ValueError("the range must be a multiple of the step")
    let_workers_import(panes.sparkSession)
    schema = ", ".join([*[f"{k} string" for k in keys], "t long", *[f"{v} {k}" for v, k in zip(values, types)], "at timestamp"])
    return panes.groupBy(*keys).transformWithStateInPandas(
        Sliding(kind, keys, pane, values, range_ms, step_ms), schema, "Append", "EventTime", eventTimeColumnName="at")


# ---------------------------------------------------------------- samples

def _increase_inside(readings: Column) -> Column:
    """Reset-aware increase over an array of (ts, id, value), in order, and the number of known rises that it is the sum of."""
    start = F.struct(F.lit(False).alias("begun"), F.lit(None).cast("double").alias("before"), F.lit(0.0).alias("inc"),
                     F.lit(0).cast("long").alias("rises"))

    def add(a, x):
        v = x["value"]
        step = F.when(v >= a["before"], v - a["before"]).otherwise(v)
        known = a["begun"] & v.isNotNull()
        return F.struct(F.lit(True).alias("begun"), v.alias("before"), (a["inc"] + F.when(known, step).otherwise(0.0)).alias("inc"),
                        (a["rises"] + known.cast("long")).alias("rises"))
    return F.aggregate(F.array_sort(readings), start, add)


def sample_panes(samples: DataFrame, step_ms: int, lateness: str = LATENESS, increases: bool = True,
                 skip_unknown: bool = False) -> DataFrame:
    """series, lkey and the columns of ``SAMPLE_PANE`` per pane ``(end - step, end]`` of a stream of samples
    (series, lkey, ts, sample_id, value), handed on when the watermark closes it.

    ``n`` counts all samples; with ``skip_unknown`` the first and last one are those that have a value."""
    moment = F.struct("ts", F.col("sample_id").alias("id"), "value")
    ends = F.when(F.col("value").isNotNull(), moment) if skip_unknown else moment
    at = samples.withColumn("at", instant_from_millis(F.col("ts") - F.lit(1))).withWatermark("at", lateness)
    aggs = [F.min(ends).alias("first"), F.max(ends).alias("last"), F.count(F.lit(1)).alias("n")]
    if increases:
        aggs.append(F.collect_list(moment).alias("readings"))
    made = at.groupBy(F.window("at", f"{step_ms} milliseconds").alias("w"), "series", "lkey").agg(*aggs)
    inside = _increase_inside(F.col("readings")) if increases else F.struct(F.lit(0.0).alias("inc"), F.lit(0).cast("long").alias("rises"))
    made = made.withColumn("inside", inside)
    return made.select(F.window_time("w").alias("at"), "series", "lkey", F.unix_millis("w.end").alias("end"),
                       F.col("first.value").alias("first_v"), F.col("last.value").alias("last_v"), F.col("inside.inc").alias("inc"), "n",
                       F.col("first.value").isNotNull().cast("long").alias("first_ok"),
                       F.col("last.value").isNotNull().cast("long").alias("last_ok"), F.col("inside.rises").alias("rises"))


def _told(value: str, known: Column) -> Column:
    """A merged value: null where it is not known, and NaN where it is but came back as a null."""
    return F.when(known, F.coalesce(F.col(value), F.lit(float("nan")))).alias(value)


def vector_stream(samples: DataFrame, kind: str, range_ms: int, step_ms: int, lateness: str = LATENESS) -> DataFrame:
    """``rate``, ``increase``, ``delta`` or ``instant`` vector of a stream of samples: series, lkey, t, value, at."""
    panes = sample_panes(samples, step_ms, lateness, kind in ("rate", "increase"), kind == "delta")
    made = slide(panes, kind, ["series", "lkey"], SAMPLE_PANE, ["value", "known"], ["double", "boolean"], range_ms, step_ms)
    return made.select("series", "lkey", "t", _told("value", F.col("known")), "at")


def divided(left: DataFrame, right: DataFrame, ratio) -> DataFrame:
    """``left / right`` of two vector streams on equal steps and label sets.

    A stream-stream inner join: both sides carry ``at`` with a watermark, and as the join compares it for equality, a
    side's rows leave the state as soon as the other side's watermark has passed their step.
    """
    a = left.select(F.col("at"), "t", "lkey", F.col("value").alias("l"))
    b = right.select(F.col("at").alias("at_r"), F.col("lkey").alias("lkey_r"), F.col("value").alias("r"))
    joined = a.join(b, (F.col("at") == F.col("at_r")) & (F.col("lkey") == F.col("lkey_r")))
    return joined.select("t", "lkey", ratio(F.col("l"), F.col("r")).alias("value"))


# ---------------------------------------------------------------- orders

def hopping_by_state(orders: DataFrame, size_ms: int, step_ms: int, lateness: str) -> DataFrame:
    """Count and average units per state and hopping window, from one pane per (state, step)."""
    s = orders.withColumn("state", F.col("address.state")).withWatermark("event_time", lateness)
    panes = (s.groupBy(F.window("event_time", f"{step_ms} milliseconds").alias("w"), "state")
             .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("orderunits"), F.lit(0.0)).alias("total"),
                  F.count("orderunits").alias("known"))
             .select(F.window_time("w").alias("at"), "state", F.unix_millis("w.end").alias("end"), "n", "total", "known"))
    made = slide(panes, "count", ["state"], COUNT_PANE, ["n", "total", "known"], ["long", "double", "long"], size_ms, step_ms)
    told = made.withColumn("total", _told("total", F.col("known") > 0))
    return told.select("state", (F.col("t") - size_ms).alias("window_start"), F.col("t").alias("window_end"),
                       F.col("n").alias("order_count"),
                       F.when(F.col("known") > 0, F.col("total") / F.col("known")).alias("avg_units"))
