"""Instant and range vector operators over metric samples.

Vectors are DataFrames ``t, metric, labels, lkey, value`` where ``t`` is an
evaluation step (epoch ms, a multiple of the step), ``lkey`` the canonical
label text used for grouping and vector matching.

Evaluation steps are never materialised as a grid: each sample is expanded
only to the steps where it is the answer (the newest sample before its
successor arrives or it goes stale, a rate pair's window, a delta's first or
last sample), so the work is bounded by ``samples * window / step`` and grows
with the data, not with the time span times the series count.  Neighbours
come from one window per (series, window-sized time bucket); per-step
results are hash aggregates keyed by ``(series, t)`` with the label set
carried as a grouping key, which spreads a hot series over many tasks.

Semantics chosen where engines differ (documented in the README):

* look-back (staleness) window ``(t - lookback, t]``;
* ``rate``/``increase`` are the reset-aware increase of consecutive samples
  inside ``(t - range, t]`` (at least two samples), divided by the range in
  seconds for ``rate`` -- no extrapolation to the window edges;
* ``delta`` is last minus first sample inside the window (at least two).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import all_match, drop_empty, label, labels_key
from .sequence import neighbor_within

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
EMPTY_LABELS = "map<string,string>"


def select_series(samples, metric: str, matchers: Sequence = ()) -> DataFrame:
    """``metric{matchers}``: rows of one metric whose labels match.

    ``samples`` is a sample DataFrame or a source with ``for_metric`` (see
    :class:`rivulet.sources.samples.SampleSource`), which yields only that
    metric's rows.
    """
    if hasattr(samples, "for_metric"):
        return samples.for_metric(metric).where(all_match("labels", matchers))
    return samples.where((F.col("metric") == F.lit(metric)) & all_match("labels", matchers))


def by_id(sel: DataFrame) -> bool:
    """Whether samples (or a vector) name their label set by ``lid`` alone; see :mod:`rivulet.operators.series`."""
    return "lid" in sel.columns


def _series(sel: DataFrame) -> list[str]:
    return ["lid"] if by_id(sel) else ["series"]


def _steps_between(lo: Column, hi: Column, step_ms: int) -> tuple[Column, Column]:
    first = (F.ceil(lo / F.lit(step_ms)) * F.lit(step_ms)).cast("bigint")
    last = (F.floor(hi / F.lit(step_ms)) * F.lit(step_ms)).cast("bigint")
    return first, last


def _expand(df: DataFrame, lo: Column, hi: Column, step_ms: int) -> DataFrame:
    first, last = _steps_between(lo, hi, step_ms)
    return (df.withColumn("_first", first).withColumn("_last", last)
            .where(F.col("_first") <= F.col("_last"))
            .withColumn("t", F.explode(F.sequence("_first", "_last", F.lit(step_ms))))
            .drop("_first", "_last"))


def instant(sel: DataFrame, step_ms: int, lookback_ms: int = 5 * MINUTE_MS) -> DataFrame:
    """Instant vector at every step: per series the latest sample in the
    look-back window ``(t - lookback, t]``.

    Each sample is the answer for the steps from its own time until its
    successor arrives or it goes stale, whichever is first.  Only a successor
    within the look-back matters, so it comes from ``neighbor_within`` (one
    shuffle of the samples keyed by series and look-back bucket, no
    whole-series task); the sample is then expanded only over its own steps,
    so every (series, step) is produced exactly once and no aggregation -- and
    no shuffle of the expanded rows -- is needed.
    """
    n = neighbor_within(sel, _series(sel), "ts", "sample_id", ["ts"], lookback_ms, "next")
    until = F.least(F.col("ts") + F.lit(lookback_ms - 1),
                    F.coalesce(F.col("next_ts") - F.lit(1), F.col("ts") + F.lit(lookback_ms - 1)))
    ex = _expand(n, F.col("ts"), until, step_ms)
    return ex.select("t", *(["lid"] if by_id(sel) else ["metric", "labels", "lkey"]), "value")


def _pairs(sel: DataFrame, range_ms: int) -> DataFrame:
    """Consecutive sample pairs less than ``range_ms`` apart (only those can
    both fall in one range window)."""
    p = neighbor_within(sel, _series(sel), "ts", "sample_id", ["ts", "value"], range_ms, "previous", "prev_")
    return p.where(F.col("prev_ts").isNotNull() & (F.col("ts") - F.col("prev_ts") < F.lit(range_ms)))


def increase(sel: DataFrame, range_ms: int, step_ms: int, per_second: bool = False, keep_metric: bool = False) -> DataFrame:
    """Reset-aware counter increase over ``(t - range, t]`` (or per second).

    The result has no metric name, unless ``keep_metric`` says that several metrics are
    evaluated at once and told apart later."""
    pairs = _pairs(sel, range_ms).withColumn(
        "d", F.when(F.col("value") >= F.col("prev_value"), F.col("value") - F.col("prev_value"))
              .otherwise(F.col("value")))
    ex = _expand(pairs, F.col("ts"), F.col("prev_ts") + F.lit(range_ms - 1), step_ms)
    # labels are a function of the series: carried as a grouping key (the map's
    # entry array) rather than in the aggregation buffer, which keeps the
    # buffer a single double and the aggregate a hash aggregate.
    val = F.col("inc") / F.lit(range_ms / 1000.0) if per_second else F.col("inc")
    if by_id(sel):
        return ex.groupBy("lid", "t").agg(F.sum("d").alias("inc")).select("t", "lid", val.alias("value"))
    agg = (ex.groupBy("series", "metric", "t", "lkey", F.map_entries("labels").alias("_le"))
           .agg(F.sum("d").alias("inc")))
    return agg.select("t", _metric(keep_metric), F.map_from_entries("_le").alias("labels"), "lkey", val.alias("value"))


def _metric(keep: bool) -> Column:
    return F.col("metric") if keep else F.lit(None).cast("string").alias("metric")


def rate(sel: DataFrame, range_ms: int, step_ms: int, keep_metric: bool = False) -> DataFrame:
    """``rate(m[range])``: per-second increase."""
    return increase(sel, range_ms, step_ms, per_second=True, keep_metric=keep_metric)


def delta(sel: DataFrame, range_ms: int, step_ms: int, keep_metric: bool = False) -> DataFrame:
    """``delta(m[range])``: last minus first sample in ``(t - range, t]``.

    Every sample knows its neighbours within the range (one window, see
    ``neighbor_within``).  It is the window's *last* sample at the steps from
    its own time until its successor or the range end, and its *first* sample
    from when its predecessor leaves the window until it leaves itself.  Both
    roles are emitted as rows and combined per (series, step) with sums and
    maxima only -- a hash aggregate -- keeping steps where first and last are
    different samples (at least two in the window).
    """
    identity = ["lid"] if by_id(sel) else ["series", "metric", "lkey", "labels"]
    n = neighbor_within(sel, _series(sel), "ts", "sample_id", ["ts"], range_ms, "both")
    end = F.col("ts") + F.lit(range_ms - 1)
    last = _expand(n, F.col("ts"), F.least(end, F.coalesce(F.col("next_ts") - F.lit(1), end)), step_ms) \
        .select(*identity, "t", F.col("value").alias("v_last"),
                F.lit(None).cast("double").alias("v_first"), F.col("sample_id").alias("id_last"),
                F.lit(None).cast("long").alias("id_first"))
    start = F.greatest(F.col("ts"), F.coalesce(F.col("prev_ts") + F.lit(range_ms), F.col("ts")))
    first = _expand(n, start, end, step_ms) \
        .select(*identity, "t", F.lit(None).cast("double").alias("v_last"),
                F.col("value").alias("v_first"), F.lit(None).cast("long").alias("id_last"),
                F.col("sample_id").alias("id_first"))
    keys = ["lid"] if by_id(sel) else ["series", "metric", "lkey", F.map_entries("labels").alias("_le")]
    agg = (last.unionByName(first).groupBy(*keys, "t")
           .agg(F.sum("v_last").alias("v_last"), F.sum("v_first").alias("v_first"),
                F.max("id_last").alias("id_last"), F.max("id_first").alias("id_first")))
    agg = agg.where(F.col("id_last") != F.col("id_first"))
    val = (F.col("v_last") - F.col("v_first")).alias("value")
    if by_id(sel):
        return agg.select("t", "lid", val)
    return agg.select("t", _metric(keep_metric), F.map_from_entries("_le").alias("labels"), "lkey", val)


# ---------------------------------------------------------------- aggregation

_AGGS = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min,
         "count": lambda c: F.count(c).cast("double")}


def aggregate(vec: DataFrame, fn: str, by: Sequence[str] = ()) -> DataFrame:
    """``fn by (labels) (vec)`` at every step.  A step with no input rows
    yields no output row (an empty vector, not zero)."""
    keys = [label("labels", b).alias(f"_by{i}") for i, b in enumerate(by)]
    g = vec.groupBy("t", *keys).agg(_AGGS[fn]("value").alias("value"))
    if by:
        kv = []
        for i, b in enumerate(by):
            kv += [F.lit(b), F.col(f"_by{i}")]
        labels = drop_empty(F.create_map(*kv))
    else:
        labels = F.create_map().cast(EMPTY_LABELS)
    return g.select("t", F.lit(None).cast("string").alias("metric"),
                    labels.alias("labels"), labels_key(labels).alias("lkey"), "value")


_OPS = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b,
        "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


def compare_values(a: Column, op: str, b) -> Column:
    """``a OP b`` for a comparison operator given by name."""
    return _OPS[op](a, b if isinstance(b, Column) else F.lit(b))


def compare(vec: DataFrame, op: str, scalar: float) -> DataFrame:
    """``vec OP scalar`` as a filter: matching elements keep their value."""
    return vec.where(compare_values(F.col("value"), op, scalar))


def arith(vec: DataFrame, op: str, scalar: float) -> DataFrame:
    """``vec OP scalar`` arithmetic; the metric name is dropped.

    Division follows IEEE semantics (``x/0`` is +-Inf, ``0/0`` NaN) rather
    than SQL NULL.
    """
    v, s = F.col("value"), F.lit(float(scalar))
    out = {"+": v + s, "-": v - s, "*": v * s, "/": ieee_divide(v, s)}[op]
    return vec.select("t", F.lit(None).cast("string").alias("metric"), "labels", "lkey",
                      out.alias("value"))


def ieee_divide(a: Column, b: Column) -> Column:
    """Floating division with IEEE results for a zero denominator."""
    return (F.when(b != 0, a / b)
            .when(a > 0, F.lit(float("inf")))
            .when(a < 0, F.lit(float("-inf")))
            .when(a.isNotNull() & b.isNotNull(), F.lit(float("nan"))))


def binary(left: DataFrame, right: DataFrame, op: str) -> DataFrame:
    """``left OP right`` with one-to-one matching on identical label sets.

    Elements without a partner on the other side are dropped.  This is an
    equi-join on ``(t, lkey)``; both sides are step-expanded vectors of the
    same size class, so Spark plans it as a shuffle join (or broadcasts a side
    its statistics show to be small).
    """
    key = "lid" if by_id(left) else "lkey"
    r = right.select(F.col("t").alias("_rt"), F.col(key).alias("_rkey"), F.col("value").alias("_rvalue"))
    j = left.join(r, (F.col("t") == F.col("_rt")) & (F.col(key) == F.col("_rkey")), "inner")
    lv, rv = F.col("value"), F.col("_rvalue")
    out = {"+": lv + rv, "-": lv - rv, "*": lv * rv, "/": ieee_divide(lv, rv)}[op]
    if by_id(left):
        return j.select("t", "lid", out.alias("value"))
    return j.select("t", F.lit(None).cast("string").alias("metric"), "labels", "lkey", out.alias("value"))


def topk(vec: DataFrame, k: int) -> DataFrame:
    """``topk(k, vec)`` per step; ties broken by label text for determinism.

    Partitioned by step, so a task holds one step's elements -- bounded by the
    number of series, not by the sample count.
    """
    w = Window.partitionBy("t").orderBy(F.col("value").desc(), F.col("lkey"))
    return vec.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def label_replace(vec: DataFrame, dst: str, replacement: str, src: str, regex: str) -> DataFrame:
    """``label_replace``: if ``src`` matches ``regex`` in full, set ``dst`` to
    the expansion of ``replacement`` (``$1`` style); otherwise unchanged."""
    full = f"^(?:{regex})$"
    srcv = label("labels", src)
    expanded = F.regexp_replace(srcv, full, replacement)
    new = F.when(srcv.rlike(full), drop_empty(F.map_concat(
        F.map_filter("labels", lambda k, _: k != F.lit(dst)),
        F.create_map(F.lit(dst), expanded)))).otherwise(F.col("labels"))
    return vec.withColumn("labels", new).withColumn("lkey", labels_key("labels"))


def legend_calcs(vec: DataFrame) -> DataFrame:
    """Per series over the whole range: mean, last non-null, max."""
    return (vec.where(F.col("value").isNotNull()).groupBy("lkey")
            .agg(F.avg("value").alias("mean"), F.max_by("value", "t").alias("last_not_null"),
                 F.max("value").alias("max")))


# ---------------------------------------------------------------- tag queries

def tag_rollup(sel: DataFrame, interval_ms: int, space_agg: str, by: Sequence[str] = ()) -> DataFrame:
    """Tag-scoped query ``space_agg:metric{scope} by {tags}``.

    Each series is first rolled up per interval with ``avg`` (the default time
    aggregation), then the per-series values are combined across series with
    ``space_agg`` per tag group.  Both steps are partial/final aggregates.
    """
    t = (F.floor(F.col("ts") / F.lit(interval_ms)) * F.lit(interval_ms)).cast("bigint")
    per_series = (sel.groupBy("series", t.alias("t"), F.map_entries("labels").alias("_le"))
                  .agg(F.avg("value").alias("value"))
                  .withColumn("labels", F.map_from_entries("_le")).drop("_le"))
    return aggregate(per_series, space_agg, by)


def count_nonzero(vec: DataFrame) -> DataFrame:
    """Number of groups with a non-zero value at each step (0 when all are 0)."""
    return (vec.groupBy("t")
            .agg(F.count(F.when(F.col("value") != 0, 1)).alias("value")))


def label_values(sel: DataFrame, name: str) -> DataFrame:
    """Distinct values of one label among the selected series."""
    return (sel.select(F.element_at("labels", F.lit(name)).alias(name))
            .where(F.col(name).isNotNull()).distinct())
