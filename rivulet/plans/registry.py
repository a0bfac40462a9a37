"""Registry of named queries and their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

_MODULES = (
    "rivulet.plans.order_queries",
    "rivulet.plans.topic_queries",
    "rivulet.plans.metric_queries",
    "rivulet.plans.alert_queries",
    "rivulet.plans.rewrite_queries",
    "rivulet.plans.stream_queries",
)


def register(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query id {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def _load():
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round computed doubles so the oracle comparison is order-insensitive."""
    return df.select(*[round6(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def round6(col, digits: int = 6):
    """Round half away from zero on the binary value: ``round(x * 10^d) / 10^d``.

    (``F.round(x, d)`` rounds the shortest decimal text of ``x`` instead, which
    differs from SQL engines on values such as 0.1288585.)"""
    m = float(10 ** digits)
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c * F.lit(m)) / F.lit(m)
