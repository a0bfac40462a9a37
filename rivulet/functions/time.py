"""Time conversions that do not depend on the session time zone.

The source tables carry ``TIMESTAMP_NTZ`` wall-clock values that are read as
UTC.  Converting through ``timestamp_diff`` / ``timestampadd`` against the NTZ
epoch keeps results identical whatever ``spark.sql.session.timeZone`` is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_millis(ts) -> Column:
    """Epoch milliseconds (BIGINT) of an NTZ timestamp taken as UTC."""
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH_NTZ), _c(ts))



def ntz_from_millis(ms) -> Column:
    """UTC wall-clock NTZ timestamp for epoch milliseconds."""
    return F.timestamp_add("MILLISECOND", _c(ms), F.expr(_EPOCH_NTZ))


def instant_from_millis(ms) -> Column:
    """An event-time ``TIMESTAMP`` (instant) for epoch milliseconds.

    Window alignment and watermarks operate on the internal epoch value of
    this type, so they are independent of the session zone as well.
    """
    return F.timestamp_millis(_c(ms))


def timestamp_to_string(ms, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """``TIMESTAMPTOSTRING(ms, fmt)`` in UTC."""
    return F.date_format(ntz_from_millis(ms), fmt)


# Duration notations used by the rule files: '1 MINUTE' / '5 MINUTES',
# PromQL '30s' '5m' '1h' '1d' '1w', and ISO-8601 'PT1M', 'PT10S', 'P1D'.
_UNIT_SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}
_WORD_SECONDS = {"millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600,
                 "day": 86400, "week": 604800}


def duration_seconds(text: str) -> float:
    """Parse a duration literal into seconds (float)."""
    t = text.strip()
    m = re.fullmatch(r"(?i)(\d+(?:\.\d+)?)\s*([a-z]+?)s?", t)
    if m and m.group(2).lower() in _WORD_SECONDS:
        return float(m.group(1)) * _WORD_SECONDS[m.group(2).lower()]
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|[smhdwy])", t)
    if parts and "".join(a + b for a, b in parts) == t:
        return sum(float(a) * _UNIT_SECONDS[b] for a, b in parts)
    m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", t.upper())
    if m and any(m.groups()):
        d, h, mi, s = (float(g) if g else 0.0 for g in m.groups())
        return d * 86400 + h * 3600 + mi * 60 + s
    raise ValueError(f"unrecognised duration: {text!r}")
