"""Metric queries: label matching, aggregation, time-series functions and
tag-scoped queries over the derived sample table.

Two parameter sets are registered: the reference's own (60 s evaluation
step, 5 m ranges and look-back) and a dense form (1 h step, 6 h ranges,
2 h look-back) that yields populated results on the hourly-sparse test data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import render_template
from ..operators import timeseries as ts
from ..operators.series import named
from ..sources.samples import SampleSource
from . import sqlgen as q
from .registry import register, round6

MIN = 60_000
HOUR = 3_600_000
STEP, LOOKBACK, RANGE = MIN, 5 * MIN, 5 * MIN            # reference parameters
DSTEP, DLOOKBACK, DRANGE = HOUR, 2 * HOUR, 6 * HOUR      # dense parameters
TAG_INTERVAL = HOUR

# dashboard template variables resolved to the generated deployment
BROKER_SCOPE = [("namespace", "=~", "confluent"), ("env", "=~", "dev"),
                ("cluster", "=~", "local"), ("pod", "=~", "kafka-.*")]
TAG_SCOPE = [("kube_namespace", "=", "confluent"), ("kube_container_name", "=", "connect")]


def out(vec):
    return vec.select((F.col("t") / 1000).cast("bigint").alias("t"), "lkey",
                      round6("value").alias("value"))


def S(spark, sf):
    return SampleSource(spark, sf)


def over(spark, sf, metric, function, *args):
    """A range function of one metric: evaluated by label-set id, then named from the catalogue."""
    s = S(spark, sf)
    return named(function(s.by_id(metric), *args), s.catalogue(metric))


def _sql(*ctes, final=None, src="v"):
    return q.with_(q.samples_cte(), *ctes, final=final or q.vector_out(src))


# ---------------------------------------------------------------- selectors

@register("label_eq", oracle=_sql(
    q.sel("s", "kafka_server_fetcherlagmetrics_consumerlag", [("topic", "=", "Orders")]),
    q.instant("v", "s", STEP, LOOKBACK)))
def q_label_eq(spark, sf):
    s = ts.select_series(S(spark, sf), "kafka_server_fetcherlagmetrics_consumerlag",
                         [("topic", "=", "Orders")])
    return out(ts.instant(s, STEP, LOOKBACK))


@register("label_neq", oracle=_sql(
    q.sel("s", "kafka_connect_connector_status", [("status", "!=", "running")]),
    q.instant("v", "s", STEP, LOOKBACK)))
def q_label_neq(spark, sf):
    s = ts.select_series(S(spark, sf), "kafka_connect_connector_status",
                         [("status", "!=", "running")])
    return out(ts.instant(s, STEP, LOOKBACK))


UP_RE = "kafka-broker|kafka-connect|schemaregistry|ksqldb"


@register("label_regex", oracle=_sql(
    q.sel("s", "up", [("job", "=~", UP_RE)]), q.instant("v", "s", DSTEP, DLOOKBACK)))
def q_label_regex(spark, sf):
    s = ts.select_series(S(spark, sf), "up", [("job", "=~", UP_RE)])
    return out(ts.instant(s, DSTEP, DLOOKBACK))


@register("instant_lookup", oracle=_sql(
    q.sel("s", "up"), q.instant("v", "s", STEP, LOOKBACK)))
def q_instant_lookup(spark, sf):
    return out(ts.instant(ts.select_series(S(spark, sf), "up"), STEP, LOOKBACK))


@register("instant_lookup_dense", oracle=_sql(
    q.sel("s", "up"), q.instant("v", "s", DSTEP, DLOOKBACK)))
def q_instant_lookup_dense(spark, sf):
    return out(ts.instant(ts.select_series(S(spark, sf), "up"), DSTEP, DLOOKBACK))


# ---------------------------------------------------------------- aggregation

MEM = "container_memory_working_set_bytes"
LIMITS = "kube_pod_container_resource_limits"
MEM_LIMIT = BROKER_SCOPE + [("resource", "=", "memory"), ("container", "=", "kafka")]
CPU_LIMIT = BROKER_SCOPE + [("resource", "=", "cpu"), ("container", "=", "kafka")]
CPU = "container_cpu_usage_seconds_total"


@register("sum_by", oracle=_sql(
    q.sel("s", MEM, BROKER_SCOPE), q.instant("i", "s", DSTEP, DLOOKBACK),
    q.aggregate("v", "i", "sum", ["pod"])))
def q_sum_by(spark, sf):
    s = ts.select_series(S(spark, sf), MEM, BROKER_SCOPE)
    return out(ts.aggregate(ts.instant(s, DSTEP, DLOOKBACK), "sum", ["pod"]))


MSGS = "kafka_server_brokertopicmetrics_messagesinpersec_count"


@register("sum_all", oracle=_sql(
    q.sel("s", MSGS), q.increase("r", "s", DRANGE, DSTEP, True), q.aggregate("v", "r", "sum")))
def q_sum_all(spark, sf):
    r = ts.rate(ts.select_series(S(spark, sf), MSGS), DRANGE, DSTEP)
    return out(ts.aggregate(r, "sum"))


@register("count_all", oracle=_sql(
    q.sel("s", "up", [("job", "=", "kafka-broker")]), q.instant("i", "s", STEP, LOOKBACK),
    "f AS (SELECT * FROM i WHERE value = 1.0)", q.aggregate("v", "f", "count")))
def q_count_all(spark, sf):
    i = ts.instant(ts.select_series(S(spark, sf), "up", [("job", "=", "kafka-broker")]), STEP, LOOKBACK)
    return out(ts.aggregate(ts.compare(i, "==", 1.0), "count"))


@register("scalar_arith", oracle=_sql(
    q.sel("s", LIMITS, CPU_LIMIT), q.instant("i", "s", DSTEP, DLOOKBACK),
    q.aggregate("a", "i", "sum", ["pod"]), q.arith("v", "a", "*", 1000)))
def q_scalar_arith(spark, sf):
    i = ts.instant(ts.select_series(S(spark, sf), LIMITS, CPU_LIMIT), DSTEP, DLOOKBACK)
    return out(ts.arith(ts.aggregate(i, "sum", ["pod"]), "*", 1000))


RATIO_SQL = _sql(
    q.sel("a", "jvm_memory_bytes_used", [("area", "=", "heap")]),
    q.sel("b", "jvm_memory_bytes_max", [("area", "=", "heap")]),
    q.instant("ia", "a", STEP, LOOKBACK), q.instant("ib", "b", STEP, LOOKBACK),
    q.binary("v", "ia", "ib", "/"))


@register("ratio_vector", oracle=RATIO_SQL)
def q_ratio_vector(spark, sf):
    s, heap = S(spark, sf), [("area", "=", "heap")]
    used, most = "jvm_memory_bytes_used", "jvm_memory_bytes_max"
    ratio = ts.binary(ts.instant(s.by_id(used, heap), STEP, LOOKBACK), ts.instant(s.by_id(most, heap), STEP, LOOKBACK), "/")
    return out(named(ratio, s.catalogue(used, most)))


@register("ratio_sum_by", oracle=_sql(
    q.sel("a", MEM, BROKER_SCOPE), q.sel("b", LIMITS, MEM_LIMIT),
    q.instant("ia", "a", DSTEP, DLOOKBACK), q.instant("ib", "b", DSTEP, DLOOKBACK),
    q.aggregate("sa", "ia", "sum", ["pod"]), q.aggregate("sb", "ib", "sum", ["pod"]),
    q.binary("d", "sa", "sb", "/"), q.arith("v", "d", "*", 100)))
def q_ratio_sum_by(spark, sf):
    s = S(spark, sf)
    a = ts.aggregate(ts.instant(ts.select_series(s, MEM, BROKER_SCOPE), DSTEP, DLOOKBACK), "sum", ["pod"])
    b = ts.aggregate(ts.instant(ts.select_series(s, LIMITS, MEM_LIMIT), DSTEP, DLOOKBACK), "sum", ["pod"])
    return out(ts.arith(ts.binary(a, b, "/"), "*", 100))


LAG = "kafka_server_fetcherlagmetrics_consumerlag"


@register("compare_filter", oracle=_sql(
    q.sel("s", LAG), q.instant("i", "s", STEP, LOOKBACK),
    final="SELECT t // 1000 AS t, lkey, ROUND(value, 6) AS value FROM i WHERE value > 10000"))
def q_compare_filter(spark, sf):
    i = ts.instant(ts.select_series(S(spark, sf), LAG), STEP, LOOKBACK)
    return out(ts.compare(i, ">", 10000))


# ---------------------------------------------------------------- range functions

RATE_5M_SQL = _sql(q.sel("s", MSGS), q.increase("v", "s", RANGE, STEP, True))
RATE_DENSE_SQL = _sql(q.sel("s", CPU), q.increase("v", "s", DRANGE, DSTEP, True))
DELTA_5M_SQL = _sql(q.sel("s", LAG), q.delta("v", "s", RANGE, STEP))
DELTA_DENSE_SQL = _sql(q.sel("s", LAG), q.delta("v", "s", DRANGE, DSTEP))


@register("rate_5m", oracle=RATE_5M_SQL)
def q_rate_5m(spark, sf):
    return out(over(spark, sf, MSGS, ts.rate, RANGE, STEP))


@register("rate_dense", oracle=RATE_DENSE_SQL)
def q_rate_dense(spark, sf):
    return out(over(spark, sf, CPU, ts.rate, DRANGE, DSTEP))


@register("increase_dense", oracle=_sql(
    q.sel("s", "jvm_gc_collection_seconds_count"),
    q.increase("v", "s", DRANGE, DSTEP, False)))
def q_increase_dense(spark, sf):
    return out(over(spark, sf, "jvm_gc_collection_seconds_count", ts.increase, DRANGE, DSTEP))


@register("delta_5m", oracle=DELTA_5M_SQL)
def q_delta_5m(spark, sf):
    return out(over(spark, sf, LAG, ts.delta, RANGE, STEP))


@register("delta_dense", oracle=DELTA_DENSE_SQL)
def q_delta_dense(spark, sf):
    return out(over(spark, sf, LAG, ts.delta, DRANGE, DSTEP))


@register("topk_by_instant", oracle=_sql(
    q.sel("s", CPU), q.increase("r", "s", DRANGE, DSTEP, True),
    q.aggregate("a", "r", "sum", ["pod"]),
    """v AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY t ORDER BY value DESC, lkey)
          AS rk FROM a) WHERE rk <= 3)"""))
def q_topk_by_instant(spark, sf):
    r = over(spark, sf, CPU, ts.rate, DRANGE, DSTEP)
    return out(ts.topk(ts.aggregate(r, "sum", ["pod"]), 3))


CPU_MS_SQL = (q.sel("s", CPU, BROKER_SCOPE), q.increase("r", "s", DRANGE, DSTEP, True),
              q.aggregate("a", "r", "sum", ["pod"]), q.arith("v", "a", "*", 1000))


def _cpu_millicores(spark, sf):
    r = ts.rate(ts.select_series(S(spark, sf), CPU, BROKER_SCOPE), DRANGE, DSTEP)
    return ts.arith(ts.aggregate(r, "sum", ["pod"]), "*", 1000)


@register("legend_calcs", oracle=_sql(*CPU_MS_SQL, final="""
SELECT lkey, ROUND(AVG(value), 6) AS mean, ROUND(arg_max(value, t), 6) AS last_not_null,
       ROUND(MAX(value), 6) AS max
FROM v WHERE value IS NOT NULL GROUP BY lkey"""))
def q_legend_calcs(spark, sf):
    c = ts.legend_calcs(_cpu_millicores(spark, sf))
    return c.select("lkey", *[round6(x).alias(x) for x in ("mean", "last_not_null", "max")])


@register("label_values", oracle=q.with_(q.samples_cte(), final=f"""
SELECT DISTINCT labels['pod'] AS pod FROM samples
WHERE metric = '{LIMITS}' AND {' AND '.join(q.matcher(*m) for m in BROKER_SCOPE + [("container", "=", "kafka")])}
  AND labels['pod'] IS NOT NULL"""))
def q_label_values(spark, sf):
    s = ts.select_series(S(spark, sf), LIMITS, BROKER_SCOPE + [("container", "=", "kafka")])
    return ts.label_values(s, "pod")


PVC = "kube_persistentvolumeclaim_resource_requests_storage_bytes"
PVC_SCOPE = [("namespace", "=~", "confluent"), ("env", "=~", "dev"), ("cluster", "=~", "local"),
             ("persistentvolumeclaim", "=~", "data0-kafka-.*")]
LR_SQL = """v AS (SELECT t, metric,
   CASE WHEN regexp_full_match(COALESCE(labels['persistentvolumeclaim'], ''), 'data0-(.*)')
        THEN map_concat(labels, MAP {'instance': regexp_extract(labels['persistentvolumeclaim'], '^data0-(.*)$', 1)})
        ELSE labels END AS labels, value FROM i),
w AS (SELECT t, metric, labels, '{' || array_to_string(list_sort(list_transform(map_entries(labels),
   lambda e: e.key || '="' || e.value || '"')), ',') || '}' AS lkey, value FROM v)"""


@register("label_replace", oracle=_sql(
    q.sel("s", PVC, PVC_SCOPE), q.instant("i", "s", DSTEP, DLOOKBACK), LR_SQL, src="w"))
def q_label_replace(spark, sf):
    i = ts.instant(ts.select_series(S(spark, sf), PVC, PVC_SCOPE), DSTEP, DLOOKBACK)
    return out(ts.label_replace(i, "instance", "$1", "persistentvolumeclaim", "data0-(.*)"))


@register("legend_format", oracle=_sql(
    q.sel("s", MEM, BROKER_SCOPE), q.instant("i", "s", DSTEP, DLOOKBACK),
    q.aggregate("v", "i", "sum", ["pod"]),
    final="SELECT t // 1000 AS t, COALESCE(labels['pod'], '') || ' - Usage' AS legend, "
          "ROUND(value, 6) AS value FROM v"))
def q_legend_format(spark, sf):
    s = ts.select_series(S(spark, sf), MEM, BROKER_SCOPE)
    v = ts.aggregate(ts.instant(s, DSTEP, DLOOKBACK), "sum", ["pod"])
    return v.select((F.col("t") / 1000).cast("bigint").alias("t"),
                    render_template("{{pod}} - Usage", "labels").alias("legend"),
                    round6("value").alias("value"))


@register("usage_vs_limit", oracle=_sql(
    q.sel("a", MEM, BROKER_SCOPE), q.sel("b", LIMITS, MEM_LIMIT),
    q.instant("ia", "a", DSTEP, DLOOKBACK), q.instant("ib", "b", DSTEP, DLOOKBACK),
    q.aggregate("sa", "ia", "sum", ["pod"]), q.aggregate("sb", "ib", "sum", ["pod"]),
    final="""SELECT t // 1000 AS t, COALESCE(labels['pod'], '') || ' - Usage' AS legend, ROUND(value, 6) AS value FROM sa
UNION ALL SELECT t // 1000 AS t, COALESCE(labels['pod'], '') || ' - Limit' AS legend, ROUND(value, 6) AS value FROM sb"""))
def q_usage_vs_limit(spark, sf):
    s = S(spark, sf)
    a = ts.aggregate(ts.instant(ts.select_series(s, MEM, BROKER_SCOPE), DSTEP, DLOOKBACK), "sum", ["pod"])
    b = ts.aggregate(ts.instant(ts.select_series(s, LIMITS, MEM_LIMIT), DSTEP, DLOOKBACK), "sum", ["pod"])

    def fmt(v, tmpl):
        return v.select((F.col("t") / 1000).cast("bigint").alias("t"),
                        render_template(tmpl, "labels").alias("legend"),
                        round6("value").alias("value"))
    return fmt(a, "{{pod}} - Usage").unionByName(fmt(b, "{{pod}} - Limit"))


LOG = "kafka_log_log_size"
LOG_SCOPE = [("job", "=", "kafka-broker"), ("namespace", "=~", "confluent"),
             ("cluster", "=~", "local"), ("env", "=~", "dev"), ("instance", "=~", "kafka-.*")]


@register("capacity_trend", oracle=_sql(
    q.sel("a", LOG, LOG_SCOPE), q.instant("ia", "a", DSTEP, DLOOKBACK),
    q.aggregate("sa", "ia", "sum", ["instance"]),
    q.sel("s", PVC, PVC_SCOPE), q.instant("i", "s", DSTEP, DLOOKBACK), LR_SQL,
    final="""SELECT sa.t // 1000 AS t, sa.labels['instance'] AS instance, ROUND(sa.value, 6) AS log_bytes,
       ROUND(w.value, 6) AS capacity_bytes, ROUND(sa.value / w.value, 6) AS used_ratio
FROM sa JOIN w ON sa.t = w.t AND sa.labels['instance'] = w.labels['instance']"""))
def q_capacity_trend(spark, sf):
    s = S(spark, sf)
    used = ts.aggregate(ts.instant(ts.select_series(s, LOG, LOG_SCOPE), DSTEP, DLOOKBACK),
                        "sum", ["instance"])
    cap = ts.label_replace(ts.instant(ts.select_series(s, PVC, PVC_SCOPE), DSTEP, DLOOKBACK),
                           "instance", "$1", "persistentvolumeclaim", "data0-(.*)")
    u = used.select("t", F.element_at("labels", F.lit("instance")).alias("instance"),
                    F.col("value").alias("log_bytes"))
    c = cap.select("t", F.element_at("labels", F.lit("instance")).alias("instance"),
                   F.col("value").alias("capacity_bytes"))
    j = u.join(c, ["t", "instance"])
    return j.select((F.col("t") / 1000).cast("bigint").alias("t"), "instance",
                    round6("log_bytes").alias("log_bytes"),
                    round6("capacity_bytes").alias("capacity_bytes"),
                    round6(ts.ieee_divide(F.col("log_bytes"), F.col("capacity_bytes"))).alias("used_ratio"))


# ---------------------------------------------------------------- tag-scoped queries

RUNNING = "confluent.kafka.connect.worker.connector_running_task_count"
FAILED = "confluent.kafka.connect.worker.connector_failed_task_count"
WRITE_RATE = "confluent.kafka.connect.source_task.source_record_write_rate"


@register("tag_scope", oracle=_sql(
    q.sel("s", "jvm.heap_memory", TAG_SCOPE), q.tag_rollup("v", "s", TAG_INTERVAL, "avg")))
def q_tag_scope(spark, sf):
    s = ts.select_series(S(spark, sf), "jvm.heap_memory", TAG_SCOPE)
    return out(ts.tag_rollup(s, TAG_INTERVAL, "avg"))


@register("tag_avg_by", oracle=_sql(
    q.sel("s", WRITE_RATE, TAG_SCOPE), q.tag_rollup("v", "s", TAG_INTERVAL, "avg", ["connector"])))
def q_tag_avg_by(spark, sf):
    s = ts.select_series(S(spark, sf), WRITE_RATE, TAG_SCOPE)
    return out(ts.tag_rollup(s, TAG_INTERVAL, "avg", ["connector"]))


@register("tag_sum_by", oracle=_sql(
    q.sel("s", RUNNING, TAG_SCOPE), q.tag_rollup("v", "s", TAG_INTERVAL, "sum", ["connector"])))
def q_tag_sum_by(spark, sf):
    s = ts.select_series(S(spark, sf), RUNNING, TAG_SCOPE)
    return out(ts.tag_rollup(s, TAG_INTERVAL, "sum", ["connector"]))


@register("count_nonzero", oracle=_sql(
    q.sel("s", FAILED, TAG_SCOPE), q.tag_rollup("g", "s", TAG_INTERVAL, "sum", ["connector"]),
    final="SELECT t // 1000 AS t, COUNT(CASE WHEN value <> 0 THEN 1 END) AS value FROM g GROUP BY t"))
def q_count_nonzero(spark, sf):
    s = ts.select_series(S(spark, sf), FAILED, TAG_SCOPE)
    c = ts.count_nonzero(ts.tag_rollup(s, TAG_INTERVAL, "sum", ["connector"]))
    return c.select((F.col("t") / 1000).cast("bigint").alias("t"), "value")


@register("unit_divide_guard", oracle=_sql(
    q.sel("a", "jvm.heap_memory", TAG_SCOPE), q.sel("b", "jvm.heap_memory_max", TAG_SCOPE),
    q.tag_rollup("ra", "a", TAG_INTERVAL, "avg"), q.tag_rollup("rb", "b", TAG_INTERVAL, "avg"),
    q.binary("d", "ra", "rb", "/"), q.arith("v", "d", "*", 100)))
def q_unit_divide_guard(spark, sf):
    s = S(spark, sf)
    a = ts.tag_rollup(ts.select_series(s, "jvm.heap_memory", TAG_SCOPE), TAG_INTERVAL, "avg")
    b = ts.tag_rollup(ts.select_series(s, "jvm.heap_memory_max", TAG_SCOPE), TAG_INTERVAL, "avg")
    return out(ts.arith(ts.binary(a, b, "/"), "*", 100))


# ---------------------------------------------------------------- broker dashboard panels

PANEL_SCOPE = [("job", "=", "kafka-broker"), ("env", "=~", "dev"), ("namespace", "=~", "confluent"),
               ("cluster", "=~", "local"), ("instance", "=~", "kafka-.*")]
DISK = "kafka_server_kafkaserver_value"


def _legend(vec, template):
    return vec.select((F.col("t") / 1000).cast("bigint").alias("t"),
                      render_template(template, "labels").alias("legend"), round6("value").alias("value"))


def _legend_sql(src: str, *parts: str) -> str:
    text = " || ".join(f"COALESCE(labels['{p[1:]}'], '')" if p.startswith("$") else q.lit(p) for p in parts)
    return f"SELECT t // 1000 AS t, {text} AS legend, ROUND(value, 6) AS value FROM {src}"


@register("dashboard_disk_io", oracle=_sql(
    q.sel("r", DISK, PANEL_SCOPE + [("name", "=", "linux-disk-read-bytes")]),
    q.sel("w", DISK, PANEL_SCOPE + [("name", "=", "linux-disk-write-bytes")]),
    q.instant("ir", "r", DSTEP, DLOOKBACK), q.instant("iw", "w", DSTEP, DLOOKBACK),
    final=_legend_sql("ir", "$instance", " - Read") + " UNION ALL " + _legend_sql("iw", "$instance", " - Write")))
def q_dashboard_disk_io(spark, sf):
    """Disk read / write bytes per broker (two series on one panel)."""
    s = S(spark, sf)
    r = ts.instant(ts.select_series(s, DISK, PANEL_SCOPE + [("name", "=", "linux-disk-read-bytes")]), DSTEP, DLOOKBACK)
    w = ts.instant(ts.select_series(s, DISK, PANEL_SCOPE + [("name", "=", "linux-disk-write-bytes")]), DSTEP, DLOOKBACK)
    return _legend(r, "{{instance}} - Read").unionByName(_legend(w, "{{instance}} - Write"))


HEAP = [("area", "=", "heap")]


@register("dashboard_heap_pct", oracle=_sql(
    q.sel("a", "jvm_memory_bytes_used", PANEL_SCOPE + HEAP), q.sel("b", "jvm_memory_bytes_max", PANEL_SCOPE + HEAP),
    q.instant("ia", "a", DSTEP, DLOOKBACK), q.instant("ib", "b", DSTEP, DLOOKBACK),
    q.binary("d", "ia", "ib", "/"), q.arith("v", "d", "*", 100), final=_legend_sql("v", "$instance")))
def q_dashboard_heap_pct(spark, sf):
    """Heap used / max x 100 per broker."""
    s = S(spark, sf)
    a = ts.instant(ts.select_series(s, "jvm_memory_bytes_used", PANEL_SCOPE + HEAP), DSTEP, DLOOKBACK)
    b = ts.instant(ts.select_series(s, "jvm_memory_bytes_max", PANEL_SCOPE + HEAP), DSTEP, DLOOKBACK)
    return _legend(ts.arith(ts.binary(a, b, "/"), "*", 100), "{{instance}}")


@register("dashboard_gc_time", oracle=_sql(
    q.sel("s", "jvm_gc_collection_seconds_sum", PANEL_SCOPE), q.increase("v", "s", DRANGE, DSTEP, True),
    final=_legend_sql("v", "$instance", " - ", "$gc")))
def q_dashboard_gc_time(spark, sf):
    """GC seconds per second per broker and collector."""
    r = ts.rate(ts.select_series(S(spark, sf), "jvm_gc_collection_seconds_sum", PANEL_SCOPE), DRANGE, DSTEP)
    return _legend(r, "{{instance}} - {{gc}}")


@register("dashboard_threads", oracle=_sql(
    q.sel("s", "jvm_threads_current", PANEL_SCOPE), q.instant("v", "s", DSTEP, DLOOKBACK),
    final=_legend_sql("v", "$instance")))
def q_dashboard_threads(spark, sf):
    """Live JVM threads per broker."""
    return _legend(ts.instant(ts.select_series(S(spark, sf), "jvm_threads_current", PANEL_SCOPE), DSTEP, DLOOKBACK),
                   "{{instance}}")


# The four chained template variables of the broker dashboard: each lists a
# label's values under the selections made for the previous ones.
VAR_CHAIN = [
    ("namespace", [("pod", "=~", "kafka-.*"), ("container", "=", "kafka")]),
    ("cluster", [("namespace", "=~", "confluent"), ("pod", "=~", "kafka-.*"), ("container", "=", "kafka")]),
    ("env", [("namespace", "=~", "confluent"), ("cluster", "=~", "local"), ("pod", "=~", "kafka-.*"),
             ("container", "=", "kafka")]),
    ("pod", [("namespace", "=~", "confluent"), ("env", "=~", "dev"), ("cluster", "=~", "local"),
             ("pod", "=~", "kafka-.*"), ("container", "=", "kafka")]),
]


@register("label_values_chain", oracle=q.with_(q.samples_cte(), final=" UNION ALL ".join(
    f"SELECT DISTINCT '{var}' AS variable, labels['{var}'] AS value FROM samples WHERE metric = '{LIMITS}' AND "
    + " AND ".join(q.matcher(*m) for m in scope) + f" AND labels['{var}'] IS NOT NULL"
    for var, scope in VAR_CHAIN)))
def q_label_values_chain(spark, sf):
    """Drop-down values of the dashboard's chained variables."""
    s = S(spark, sf)
    parts = [ts.label_values(ts.select_series(s, LIMITS, scope), var)
             .select(F.lit(var).alias("variable"), F.col(var).alias("value")) for var, scope in VAR_CHAIN]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Guide queries over the metrics: lag by topic and ingress by topic.
BYTES_IN = "kafka_server_brokertopicmetrics_bytesinpersec_count"


@register("lag_by_topic_metric", oracle=_sql(
    q.sel("s", LAG), q.instant("i", "s", STEP, LOOKBACK), q.aggregate("v", "i", "sum", ["topic"])))
def q_lag_by_topic_metric(spark, sf):
    """``sum by (topic) (kafka_server_fetcherlagmetrics_consumerlag)``."""
    i = ts.instant(ts.select_series(S(spark, sf), LAG), STEP, LOOKBACK)
    return out(ts.aggregate(i, "sum", ["topic"]))


@register("bytes_in_by_topic", oracle=_sql(
    q.sel("s", BYTES_IN), q.increase("r", "s", DRANGE, DSTEP, True), q.aggregate("v", "r", "sum", ["topic"])))
def q_bytes_in_by_topic(spark, sf):
    """``sum by (topic) (rate(kafka_server_brokertopicmetrics_bytesinpersec_count[range]))``."""
    r = ts.rate(ts.select_series(S(spark, sf), BYTES_IN), DRANGE, DSTEP)
    return out(ts.aggregate(r, "sum", ["topic"]))
