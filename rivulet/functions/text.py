"""String-producing column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cast_varchar(col) -> Column:
    """``CAST(x AS VARCHAR)``; doubles print as ``5.0`` / ``1.0E7``."""
    return _c(col).cast("string")

