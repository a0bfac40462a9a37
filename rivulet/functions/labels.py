"""Label-set helpers for ``MAP<STRING,STRING>`` label columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def labels_key(labels) -> Column:
    """Canonical text of a label set: ``{a="1",b="2"}`` with names sorted."""
    entries = F.transform(F.map_entries(_c(labels)),
                          lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(F.array_sort(entries), ","), F.lit("}"))


def label(labels, name: str) -> Column:
    """A label's value; an absent label reads as the empty string."""
    return F.coalesce(F.element_at(_c(labels), F.lit(name)), F.lit(""))


def anchored(regex: str) -> str:
    """Label regexes match the whole value."""
    return f"^(?:{regex})$"


def matcher(labels, name: str, op: str, value: str) -> Column:
    """One label matcher: ``=``, ``!=``, ``=~`` or ``!~``."""
    v = label(labels, name)
    if op == "=":
        return v == F.lit(value)
    if op == "!=":
        return v != F.lit(value)
    if op == "=~":
        return v.rlike(anchored(value))
    if op == "!~":
        return ~v.rlike(anchored(value))
    raise ValueError(f"unknown matcher op {op!r}")


def all_match(labels, matchers) -> Column:
    """Conjunction of matchers given as ``(name, op, value)`` triples."""
    cond = F.lit(True)
    for name, op, value in matchers:
        cond = cond & matcher(labels, name, op, value)
    return cond



def map_last_wins(pairs) -> Column:
    """A map from an array of (key, value) structs where the last value of a repeated key stays."""
    p = _c(pairs)
    last = F.filter(p, lambda x, i: F.size(F.filter(p, lambda y, j: (j > i) & (y["key"] == x["key"]))) == 0)
    return F.map_from_entries(last)


def drop_empty(labels) -> Column:
    return F.map_filter(_c(labels), lambda _, v: v != F.lit(""))


_TEMPLATE = re.compile(r"\{\{\s*(?:\$labels\.)?([A-Za-z_][A-Za-z0-9_]*|\$value)\s*\}\}")


def render_template(template: str, labels, value=None) -> Column:
    """Render ``{{pod}}``, ``{{ $labels.env }}`` and ``{{ $value }}`` templates.

    The template is split once on the driver into literal pieces and label
    lookups; each row is then a single ``concat``.
    """
    parts, pos = [], 0
    for m in _TEMPLATE.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name = m.group(1)
        if name == "$value":
            parts.append(go_float_text(value))
        else:
            parts.append(label(labels, name))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it.

    An expression repeated in a formula is repeated in the generated code as well;
    bound to the variable of a one-element ``transform`` it is not.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def go_float_text(value) -> Column:
    """Text of a double as templates print it: shortest digits that read back as the same
    number, plain from 1e-4 up to 1e21 (``1``, ``0.25``) and with an exponent of at least two
    digits beyond (``1e+30``, ``1e-12``); ``+Inf``, ``-Inf`` and ``NaN``."""
    def finite(v, text):                                      # shortest digits, exponent below 1e-3 and from 1e7
        power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
        digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0$", "")
        steps = F.when(power == "", F.lit("0")).otherwise(power).cast("int")
        return F.when(~text.contains("E"), F.regexp_replace(text, r"\.0$", "")).otherwise(
            let(F.struct(digits.alias("d"), steps.alias("s")), lambda x: scaled(v, x["d"], x["s"])))

    def scaled(v, digits, steps):
        sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
        moved = F.replace(digits, F.lit("."), F.lit(""))      # all digits; the point moves by the exponent
        tail = F.length(moved) - 1
        up = F.when(tail <= steps, F.rpad(moved, steps + 1, "0")).otherwise(
            F.concat(F.substring(moved, F.lit(1), steps + 1), F.lit("."), F.substring(moved, steps + 2, tail)))
        down = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-steps - 1, F.lit(0))), moved)
        power = F.abs(steps).cast("string")
        exponent = F.concat(digits, F.lit("e"), F.when(steps < 0, F.lit("-")).otherwise(F.lit("+")),
                            F.lpad(power, F.greatest(F.length(power), F.lit(2)), "0"))
        plain = (F.abs(v) >= 1e-4) & (F.abs(v) < 1e21)
        return F.concat(sign, F.when(~plain, exponent).when(steps >= 0, up).otherwise(down))
    return let(_c(value).cast("double"), lambda v: (
        F.when(v.isNull(), F.lit("<nil>")).when(F.isnan(v), F.lit("NaN"))
        .when(v == F.lit(float("inf")), F.lit("+Inf")).when(v == F.lit(float("-inf")), F.lit("-Inf"))
        .when(v == 0, F.lit("0")).otherwise(let(v.cast("string"), lambda text: finite(v, text)))))
