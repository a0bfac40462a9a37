"""Alert evaluation: the ``for`` hold, annotations and severity handling.

An alert rule's expression is evaluated at every step of the rule group's
interval; every element it returns at step ``t`` is *active* there.  An
element that is active at consecutive steps forms a run; it is ``pending``
until it has been active for the rule's ``for`` duration and ``firing`` from
then on.  A step where the element is absent ends the run, and the next
appearance starts a new one.

The rows of one (alert, series) are its active steps, bounded by the
evaluated span divided by the step, so runs are found with one window
partition per key (see :func:`hold_states`).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import go_float_text, label, let


@dataclass(frozen=True)
class AlertRule:
    group: str
    alert: str
    for_s: float
    severity: str
    summary: str
    description: str


def hold_states(active: DataFrame, step_ms: int, for_col: str = "for_ms",
                keys: Sequence[str] = ("alert", "lkey")) -> DataFrame:
    """Add ``active_since`` (ms) and ``state`` (pending | firing) to the rows
    of an active-element table ``(alert, lkey, t, ..., for_ms)``.

    The rows of one (alert, series) key are its active evaluation steps, so
    their number is bounded by the evaluated time span divided by the step --
    not by the input volume.  One window partition per key is therefore
    bounded, and both window functions share one partitioning and sort:
    ``lag`` finds the gaps, a running ``max`` carries the step where the
    current run began.
    """
    k = F.col("_k")
    w = Window.partitionBy(*keys).orderBy("_k")
    run = (active.withColumn("_k", (F.col("t") / F.lit(step_ms)).cast("bigint"))
           .withColumn("_gap_at", F.when(F.lag("_k").over(w).isNull() | (k - F.lag("_k").over(w) > 1), k))
           .withColumn("_run_k", F.max("_gap_at").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    since = F.col("_run_k") * F.lit(step_ms)
    return (run.withColumn("active_since", since)
            .withColumn("state", F.when(F.col("t") - since >= F.col(for_col), F.lit("firing"))
                        .otherwise(F.lit("pending")))
            .drop("_k", "_gap_at", "_run_k"))


def resolutions(states: DataFrame, step_ms: int, keys: Sequence[str] = ("alert", "lkey")) -> DataFrame:
    """Where firing runs end: keys, ``active_since`` and ``t``, the first step at which the alert is missing.

    ``states`` is the result of :func:`hold_states`; a run is a (key, ``active_since``) group, and it fired if its
    last step lies ``for`` after its first one.
    """
    runs = states.groupBy(*keys, "active_since").agg(F.max("t").alias("_last"), F.max("for_ms").alias("_for"))
    return (runs.where(F.col("_last") - F.col("active_since") >= F.col("_for"))
            .select(*keys, "active_since", (F.col("_last") + F.lit(step_ms)).alias("t")))


# ---------------------------------------------------------------- templates

_TOKEN = re.compile(r"\{\{\s*(\$labels\.([A-Za-z_][A-Za-z0-9_]*)|\$value(?:\s*\|\s*(humanizePercentage|humanize))?)\s*\}\}")
_SI = ["", "k", "M", "G", "T", "P", "E", "Z", "Y"]


def _finite(x: Column) -> Column:
    """``x``, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def sig4(x: Column) -> Column:
    """``x`` rounded to 4 significant digits (the ``%.4g`` value); Inf and NaN stay.

    Decimals come from one division by a power of ten, so the result is the double
    nearest to the rounded decimal and prints as that decimal.
    """
    def rounded(v, e):
        up, down = F.pow(F.lit(10.0), F.lit(3) - e), F.pow(F.lit(10.0), e - F.lit(3))
        return F.when(e <= 3, F.round(v * up) / up).otherwise(F.round(v / down) * down)
    return let(x, lambda v: F.when((v == 0) | _finite(v).isNull(), v).otherwise(
        let(F.floor(F.log10(F.abs(_finite(v)))), lambda e: rounded(v, e))))


def humanize(x: Column) -> Column:
    """SI-prefixed text (``1.234G``) for values >= 1; plain text below."""
    def scaled(v, ex):
        prefix = F.element_at(F.array(*[F.lit(p) for p in _SI]), (ex + F.lit(1)).cast("int"))
        return F.concat(go_float_text(sig4(v / F.pow(F.lit(1000.0), ex))), prefix)

    def third(v):
        return F.least(F.greatest(F.floor(F.log10(F.abs(_finite(v))) / F.lit(3)), F.lit(0)), F.lit(len(_SI) - 1))
    return let(x, lambda v: F.when(v == 0, F.lit("0")).when(_finite(v).isNull(), go_float_text(v))
               .otherwise(let(third(v), lambda ex: scaled(v, ex))))


def humanize_percentage(x: Column) -> Column:
    return F.concat(go_float_text(sig4(x * F.lit(100.0))), F.lit("%"))


def number_forms(templates: Sequence[str]) -> list[str]:
    """Which forms of the value (``""``, ``humanize``, ``humanizePercentage``) templates print."""
    return sorted({m.group(3) or "" for t in templates for m in _TOKEN.finditer(t) if not m.group(2)})


def number_text(form: str, value: Column) -> Column:
    return {"": go_float_text, "humanize": humanize, "humanizePercentage": humanize_percentage}[form](value)


def render(template: str, labels: Column, value: Column, texts: dict[str, Column] | None = None) -> Column:
    """Render an annotation template with ``$labels.x`` and ``$value``.

    ``texts`` gives the value's forms as columns where many templates share them.
    """
    parts, pos = [], 0
    for m in _TOKEN.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        if m.group(2):
            parts.append(label(labels, m.group(2)))
        else:
            form = m.group(3) or ""
            parts.append(texts[form] if texts else number_text(form, value))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


# ---------------------------------------------------------------- severity

# Severity names and their numeric levels.
SEVERITY_LEVELS = {"page": 0, "critical": 1, "warning": 2, "info": 3}


def severity_level(severity: Column) -> Column:
    """Numeric level of a severity name through a literal map."""
    kv = []
    for k, v in SEVERITY_LEVELS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*kv), severity)


TIER_SCHEMA = T.StructType([
    T.StructField("signal", T.StringType()), T.StructField("tier", T.StringType()),
    T.StructField("op", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("for_s", T.DoubleType())])


def tier_matches(signals: DataFrame, tiers: DataFrame) -> DataFrame:
    """Join signal values to their tier thresholds and keep the tiers a value
    crosses.  ``tiers`` is a fixed table of a few rows; it is broadcast (its
    size is a code constant, so the bound is proven) and the big side is
    never shuffled for this join."""
    j = signals.join(F.broadcast(tiers), "signal")
    v, th = F.col("value"), F.col("threshold")
    crossed = (F.when(F.col("op") == ">", v > th).when(F.col("op") == "<", v < th)
               .when(F.col("op") == "==", v == th).when(F.col("op") == ">=", v >= th)
               .otherwise(F.lit(False)))
    return j.where(crossed)
