"""Queries for bean-name rewriting and target relabeling."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import rulesets as RS
from ..functions.labels import labels_key
from ..operators import rewrite as rw
from ..sources.beans import (bean_readings, readings_sql_cte, scrape_targets, scrape_targets_sql,
                             service_endpoints, service_endpoints_sql)
from .registry import register
from .sqlgen import lit

COMPONENTS = ("kafka", "kraftcontroller", "connect", "ksqldb", "schemaregistry", "kafkarestproxy")


def rewritten(spark, sf, components=COMPONENTS):
    readings = bean_readings(spark, sf, components)
    out = rw.apply_bean_rules(readings, {c: RS.RULES_BY_COMPONENT[c] for c in components})
    return out.select("component", "ts", "sample_id", "metric", "lkey", "type", "value", "rule")


# ---------------------------------------------------------------- SQL side

def _ngroups(regex: str) -> int:
    return re.compile(regex).groups


def _expand_sql(src: str, regex: str, template: str, flavor: str = "java") -> str:
    n = _ngroups(regex)
    names = "[" + ", ".join(f"'g{i}'" for i in range(1, n + 1)) + "]"
    parts = []
    for p in rw.template_pieces(template, flavor):
        if isinstance(p, str):
            parts.append(lit(p))
        elif 1 <= p <= n:
            parts.append(f"regexp_extract({src}, {lit(regex)}, {names})['g{p}']")
        elif p == 0:
            parts.append(f"regexp_extract({src}, {lit(regex)}, 0)")
    return "(" + (" || ".join(parts) if parts else "''") + ")"


def _safe(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9:]+', '_', 'g'), '^([0-9])', '_\\1')"


_BEAN = r"^([^<]*)<([^>]*)><([^>]*)>([^:]*)"


def _lkey_from_pairs_list(pairs_list: str) -> str:
    """lkey SQL from a list of {'k':..,'v':..} structs (empty keys dropped)."""
    return ("'{' || array_to_string(list_sort(list_transform(list_filter(" + pairs_list
            + ", lambda e: e.k <> ''), lambda e: e.k || '=\"' || e.v || '\"')), ',') || '}'")


def _default_sql(bean: str) -> tuple[str, str]:
    dom = f"regexp_extract({bean}, {lit(_BEAN)}, 1)"
    props = f"regexp_extract({bean}, {lit(_BEAN)}, 2)"
    attr = f"regexp_extract({bean}, {lit(_BEAN)}, 4)"
    first = f"regexp_extract({props}, '^[^=]*=([^,]*)', 1)"
    rest = f"regexp_extract({props}, '^[^,]*,\\s*(.*)$', 1)"
    name = _safe(f"concat_ws('_', {dom}, {first}, {attr})")
    pairs = (f"CASE WHEN {rest} = '' THEN [] ELSE list_transform(string_split(regexp_replace({rest}, ',\\s+', ',', 'g'), ','), "
             f"lambda p: {{'k': split_part(p, '=', 1), 'v': split_part(p, '=', 2)}}) END")
    return name, _lkey_from_pairs_list(pairs)


def rules_sql(component: str) -> str:
    rules = RS.RULES_BY_COMPONENT[component]
    idx = " ".join(f"WHEN regexp_full_match(bean, {lit(r.full)}) THEN {i}" for i, r in enumerate(rules))
    names, lkeys, types, values = [], [], [], []
    for i, r in enumerate(rules):
        if r.name:
            nm = _safe(_expand_sql("bean", r.full, r.name))
            pairs = "[" + ", ".join(
                f"{{'k': {_safe(_expand_sql('bean', r.full, k))}, 'v': {_expand_sql('bean', r.full, v)}}}"
                for k, v in r.labels.items()) + "]"
            lk = _lkey_from_pairs_list(pairs) if r.labels else "'{}'"
        else:
            nm, lk = _default_sql("bean")
        names.append(f"WHEN {i} THEN {nm}")
        lkeys.append(f"WHEN {i} THEN {lk}")
        types.append(f"WHEN {i} THEN {lit(r.type or 'UNTYPED')}")
        values.append(f"WHEN {i} THEN {float(r.value)!r}" if r.value is not None else f"WHEN {i} THEN value")
    return f"""SELECT component, ts, sample_id,
  CASE rule {' '.join(names)} END AS metric,
  CASE rule {' '.join(lkeys)} END AS lkey,
  CASE rule {' '.join(types)} END AS type,
  CAST(CASE rule {' '.join(values)} END AS DOUBLE) AS value, rule
FROM (SELECT *, CASE {idx} END AS rule FROM {readings_sql_cte(component)}) m
WHERE rule IS NOT NULL"""


def all_rules_sql(components=COMPONENTS) -> str:
    return "\nUNION ALL\n".join(f"({rules_sql(c)})" for c in components)


# ---------------------------------------------------------------- bean queries

@register("bean_rename_rules", oracle=all_rules_sql())
def q_bean_rename_rules(spark, sf):
    return rewritten(spark, sf)


@register("bean_const_value", oracle=f"""SELECT * FROM ({rules_sql('connect')}) x
WHERE metric = 'kafka_connect_app_info'""")
def q_bean_const_value(spark, sf):
    return rewritten(spark, sf, ("connect",)).where(F.col("metric") == "kafka_connect_app_info")


def _rules(component: str, wanted) -> list[int]:
    """Indexes of a component's rules with a property, read off the rules themselves."""
    return [i for i, r in enumerate(RS.RULES_BY_COMPONENT[component]) if wanted(r)]


def _by_rule(parts: dict) -> F.Column:
    cond = F.lit(False)
    for c, idx in parts.items():
        cond = cond | ((F.col("component") == c) & F.col("rule").isin(idx))
    return cond


# Fixed values for the oracles: positions, in the rule files, of the rules with a captured
# label name (``$n`` as a label's name), and of the trailing ``.*``.
DYNAMIC_SQL = ("(component = 'connect' AND rule IN (9, 10)) OR "
               "(component = 'kafka' AND rule IN (4, 5, 6, 7, 8, 10, 12, 19, 20, 21)) OR "
               "(component IN ('ksqldb', 'kafkarestproxy') AND rule IN (0, 1)) OR "
               "(component = 'schemaregistry' AND rule = 0)")
CATCH_ALL_SQL = "component = 'connect' AND rule = 11"


@register("bean_dynamic_label", oracle=f"""SELECT component, metric, lkey, COUNT(*) AS n
FROM ({all_rules_sql()}) x
WHERE {DYNAMIC_SQL} GROUP BY component, metric, lkey""")
def q_bean_dynamic_label(spark, sf):
    """Series whose label names were captured from the bean (``$2: "$3"``)."""
    found = {c: idx for c in COMPONENTS if (idx := _rules(c, lambda r: r.dynamic))}
    return (rewritten(spark, sf, tuple(found)).where(_by_rule(found))
            .groupBy("component", "metric", "lkey").agg(F.count(F.lit(1)).alias("n")))


@register("bean_catch_all", oracle=f"""SELECT * FROM ({rules_sql("connect")}) x WHERE {CATCH_ALL_SQL}""")
def q_bean_catch_all(spark, sf):
    """Readings that only the trailing ``.*`` rule takes; just the components that have one."""
    found = {c: idx for c in COMPONENTS if (idx := _rules(c, lambda r: r.catch_all))}
    return rewritten(spark, sf, tuple(found)).where(_by_rule(found))


@register("percentile_label", oracle=f"""SELECT component, metric, lkey, COUNT(*) AS n,
       ROUND(AVG(value), 6) AS avg_value
FROM ({all_rules_sql(("kafka", "kraftcontroller"))}) x
WHERE lkey LIKE '%quantile=%' GROUP BY component, metric, lkey""")
def q_percentile_label(spark, sf):
    from .registry import round6
    r = rewritten(spark, sf, ("kafka", "kraftcontroller")).where(F.col("lkey").contains("quantile="))
    return (r.groupBy("component", "metric", "lkey")
            .agg(F.count(F.lit(1)).alias("n"), round6(F.avg("value")).alias("avg_value")))


# ---------------------------------------------------------------- relabel queries

def _joined_sql(names, sep=";") -> str:
    if not names:
        return "''"
    return "concat_ws(" + lit(sep) + ", " + ", ".join(f"COALESCE(labels[{lit(n)}], '')" for n in names) + ")"


def _without(m: str, key: str) -> str:
    return f"map_from_entries(list_filter(map_entries({m}), lambda e: e.key <> {lit(key)}))"


def relabel_sql(steps, src: str) -> str:
    cur = f"(SELECT sample_id, ts, labels, value FROM {src})"
    for i, st in enumerate(steps):
        full = f"^(?:{st.regex})$"
        j = _joined_sql(st.source_labels, st.separator)
        if st.action == "keep":
            cur = f"(SELECT * FROM {cur} s{i} WHERE regexp_full_match({j}, {lit(full)}))"
        elif st.action == "drop":
            cur = f"(SELECT * FROM {cur} s{i} WHERE NOT regexp_full_match({j}, {lit(full)}))"
        elif st.action == "replace":
            val = _expand_sql(j, full, st.replacement, "go")
            rest = _without("labels", st.target_label)
            new = (f"CASE WHEN {val} = '' THEN {rest} ELSE map_concat({rest}, "
                   f"MAP {{{lit(st.target_label)}: {val}}}) END")
            cur = (f"(SELECT sample_id, ts, CASE WHEN regexp_full_match({j}, {lit(full)}) THEN {new} "
                   f"ELSE labels END AS labels, value FROM {cur} s{i})")
        elif st.action == "labelmap":
            ren = _expand_sql("e.key", full, st.replacement, "go")
            mapped = (f"list_transform(list_filter(map_entries(labels), lambda e: regexp_full_match(e.key, {lit(full)})), "
                      f"lambda e: {{'key': {ren}, 'value': e.value}})")
            cur = (f"(SELECT sample_id, ts, map_from_entries(list_concat(list_filter(map_entries(labels), "
                   f"lambda e: NOT list_contains(list_transform({mapped}, lambda x: x.key), e.key)), {mapped})) AS labels, "
                   f"value FROM {cur} s{i})")
    return cur


_LK = ("'{' || array_to_string(list_sort(list_transform(map_entries(labels), "
       "lambda e: e.key || '=\"' || e.value || '\"')), ',') || '}'")


def _relabel_query(qid: str, steps, drop_meta: bool = False, endpoints: bool = False):
    src_df = service_endpoints if endpoints else scrape_targets
    src_sql = service_endpoints_sql() if endpoints else scrape_targets_sql()
    final_labels = ("map_from_entries(list_filter(map_entries(labels), lambda e: NOT starts_with(e.key, '__')))"
                    if drop_meta else "labels")
    sql = (f"SELECT sample_id, ts, {_LK.replace('labels', 'l2')} AS lkey, value FROM "
           f"(SELECT sample_id, ts, {final_labels} AS l2, value FROM {relabel_sql(steps, src_sql)} z)")

    @register(qid, oracle=sql)
    def _q(spark, sf):
        df = rw.relabel(src_df(spark, sf), steps)
        labels = rw.drop_meta(F.col("labels")) if drop_meta else F.col("labels")
        return df.select("sample_id", "ts", labels_key(labels).alias("lkey"), "value")
    return _q


_relabel_query("relabel_keep", RS.CONNECT_RELABEL[:2])
_relabel_query("relabel_drop", RS.SERVICEMONITOR_RELABEL[:1], endpoints=True)
_relabel_query("relabel_replace", RS.BROKER_RELABEL[:1])
_relabel_query("relabel_copy", RS.CONNECT_RELABEL[2:3])
_relabel_query("relabel_static", RS.CONNECT_RELABEL[3:5])
_relabel_query("relabel_labelmap", RS.LABELMAP_RELABEL)
_relabel_query("relabel_job_connect", RS.CONNECT_RELABEL, drop_meta=True)
_relabel_query("relabel_job_broker", RS.BROKER_RELABEL, drop_meta=True)
_relabel_query("relabel_servicemonitor", RS.SERVICEMONITOR_RELABEL, drop_meta=True, endpoints=True)
_relabel_query("relabel_pod_monitoring", RS.POD_MONITORING_RELABEL, drop_meta=True)
