"""DuckDB SQL for the oracles of metric queries.

These builders emit straightforward SQL (whole-series ``LAG`` windows,
per-step ``unnest(range(...))``) over the same derived sample table; they are
the independent reference the Spark plans are checked against.
"""

from __future__ import annotations

from ..sources.samples import samples_sql


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def samples_cte() -> str:
    return "samples AS " + samples_sql()


def with_(*ctes: str, final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final


def matcher(name: str, op: str, value: str) -> str:
    v = f"COALESCE(labels[{lit(name)}], '')"
    return {"=": f"{v} = {lit(value)}", "!=": f"{v} <> {lit(value)}",
            "=~": f"regexp_full_match({v}, {lit(value)})",
            "!~": f"NOT regexp_full_match({v}, {lit(value)})"}[op]


def sel(name: str, metric: str, matchers=()) -> str:
    conds = [f"metric = {lit(metric)}"] + [matcher(*m) for m in matchers]
    return f"{name} AS (SELECT * FROM samples WHERE {' AND '.join(conds)})"


def _steps(lo: str, hi: str, step: int) -> str:
    return (f"unnest(range(CAST(ceil(({lo}) / {step}) AS BIGINT) * {step}, "
            f"({hi}) // {step} * {step} + 1, {step}))")


def instant(name: str, src: str, step: int, lookback: int) -> str:
    return f"""{name} AS (SELECT t, metric, labels, lkey, value FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series, t ORDER BY ts DESC, sample_id DESC) AS rn
  FROM (SELECT *, {_steps('ts', f'ts + {lookback - 1}', step)} AS t FROM {src})) WHERE rn = 1)"""


def increase(name: str, src: str, rng: int, step: int, per_second: bool) -> str:
    val = f"SUM(d) / {rng / 1000.0!r}" if per_second else "SUM(d)"
    return f"""{name} AS (
  SELECT t, CAST(NULL AS VARCHAR) AS metric, any_value(labels) AS labels, any_value(lkey) AS lkey,
         {val} AS value
  FROM (SELECT *, {_steps('ts', f'prev_ts + {rng - 1}', step)} AS t FROM (
    SELECT *, CASE WHEN value >= prev_value THEN value - prev_value ELSE value END AS d FROM (
      SELECT *, LAG(ts) OVER w AS prev_ts, LAG(value) OVER w AS prev_value FROM {src}
      WINDOW w AS (PARTITION BY series ORDER BY ts, sample_id))
    WHERE prev_ts IS NOT NULL))
  GROUP BY series, t)"""


def delta(name: str, src: str, rng: int, step: int) -> str:
    return f"""{name} AS (
  SELECT t, CAST(NULL AS VARCHAR) AS metric, any_value(labels) AS labels, any_value(lkey) AS lkey,
         arg_max(value, (ts, sample_id)) - arg_min(value, (ts, sample_id)) AS value
  FROM (SELECT *, {_steps('ts', f'ts + {rng - 1}', step)} AS t FROM {src})
  GROUP BY series, t HAVING COUNT(*) >= 2)"""


def lkey_of(pairs: list[tuple[str, str]]) -> str:
    """Canonical label text for (name, sql value) pairs, empty values dropped."""
    items = [f"CASE WHEN {v} <> '' THEN {lit(n + '=\"')} || {v} || '\"' END"
             for n, v in sorted(pairs)]
    if not items:
        return "'{}'"
    return ("'{' || array_to_string(list_filter([" + ", ".join(items)
            + "], lambda x: x IS NOT NULL), ',') || '}'")


def labels_of(pairs: list[tuple[str, str]]) -> str:
    if not pairs:
        return "MAP {}"
    return ("map_from_entries(list_filter([" + ", ".join(
        f"{{'key': {lit(n)}, 'value': {v}}}" for n, v in sorted(pairs))
        + "], lambda e: e.value <> ''))")


def aggregate(name: str, src: str, fn: str, by=()) -> str:
    keys = [(b, f"COALESCE(labels[{lit(b)}], '')") for b in by]
    agg = {"sum": "SUM(value)", "avg": "AVG(value)", "max": "MAX(value)", "min": "MIN(value)",
           "count": "CAST(COUNT(value) AS DOUBLE)"}[fn]
    inner_cols = ", ".join([f"{v} AS by_{i}" for i, (_, v) in enumerate(keys)])
    gcols = ", ".join(["t"] + [f"by_{i}" for i in range(len(keys))])
    renamed = [(b, f"by_{i}") for i, (b, _) in enumerate(keys)]
    return f"""{name} AS (
  SELECT t, CAST(NULL AS VARCHAR) AS metric, {labels_of(renamed)} AS labels,
         {lkey_of(renamed)} AS lkey, {agg} AS value
  FROM (SELECT *{', ' + inner_cols if inner_cols else ''} FROM {src})
  GROUP BY {gcols})"""


def tag_rollup(name: str, src: str, interval: int, space_agg: str, by=()) -> str:
    return (f"{name}_ts AS (SELECT series, ts // {interval} * {interval} AS t, any_value(labels) AS labels, "
            f"AVG(value) AS value FROM {src} GROUP BY series, ts // {interval} * {interval}),\n"
            + aggregate(name, f"{name}_ts", space_agg, by))


def ieee_div(a: str, b: str) -> str:
    return (f"CASE WHEN {b} <> 0 THEN {a} / {b} WHEN {a} > 0 THEN 'inf'::DOUBLE "
            f"WHEN {a} < 0 THEN '-inf'::DOUBLE WHEN {a} IS NOT NULL AND {b} IS NOT NULL "
            f"THEN 'nan'::DOUBLE END")


def binary(name: str, left: str, right: str, op: str) -> str:
    expr = {"/": ieee_div("l.value", "r.value"), "*": "l.value * r.value",
            "+": "l.value + r.value", "-": "l.value - r.value"}[op]
    return f"""{name} AS (SELECT l.t, CAST(NULL AS VARCHAR) AS metric, l.labels, l.lkey, {expr} AS value
  FROM {left} l JOIN {right} r ON l.t = r.t AND l.lkey = r.lkey)"""


def arith(name: str, src: str, op: str, scalar: float) -> str:
    expr = ieee_div("value", repr(float(scalar))) if op == "/" else f"value {op} {float(scalar)!r}"
    return f"{name} AS (SELECT t, CAST(NULL AS VARCHAR) AS metric, labels, lkey, {expr} AS value FROM {src})"


def vector_out(src: str) -> str:
    """Final projection used by registered vector queries."""
    return f"SELECT t // 1000 AS t, lkey, ROUND(value, 6) AS value FROM {src}"
