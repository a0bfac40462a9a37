"""Alert rule evaluation queries.

The rule texts, hold durations, severities and annotation templates below are
fixed values taken from the rule files; each rule's expression is given as a vector
expression tree (``EXPR_TREE``) that builds the Spark plan.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.time import duration_seconds
from ..operators import alerts as al
from ..sources.samples import SampleSource
from . import rules
from . import sqlgen as q
from .registry import register, round6
from .vexpr import Agg, Bin, Cmp, Delta, Inst, Params, Rate

REF = Params(step_ms=60_000, lookback_ms=300_000)                         # 60 s groups
DENSE = Params(step_ms=3_600_000, lookback_ms=7_200_000, range_scale=72)  # 1 h grid, 6 h ranges

# ---------------------------------------------------------------- fixed values
# (group, alert, for, severity, summary, description)
RULE_TEXT = [
    ("kafka-brokers", "ActiveControllerCountNotOne", "10s", "page",
     "Active controller count for env {{ $labels.env }}",
     "Active controller count for env {{ $labels.env }} is {{ $value }}."),
    ("kafka-brokers", "OfflinePartitionCount", "10s", "page",
     "Offline partitions for env {{ $labels.env }}",
     "Offline partitions count for env {{ $labels.env }} is {{ $value }}."),
    ("kafka-brokers", "UncleanLeaderElections", "1m", "page",
     "UncleanLeaderElections for env {{ $labels.env }}",
     "UncleanLeaderElections count for env {{ $labels.env }} is {{ $value }}."),
    ("kafka-brokers", "UnderReplicatedPartitions", "1m", "page",
     "UnderReplicatedPartitions for env {{ $labels.env }}",
     "UnderReplicatedPartitions for env {{ $labels.env }} is {{ $value }}."),
    ("kafka-brokers", "UnderMinIsrPartitionCount", "1m", "page",
     "UnderMinIsrPartitionCount for env {{ $labels.env }}",
     "UnderMinIsrPartitionCount for env {{ $labels.env }} is {{ $value }}."),
    ("kafka-brokers", "KafkaBrokerCountChanged", "1m", "warning",
     "Kafka broker count is below expected",
     "Expected 3 brokers but only {{ $value }} are up."),
    ("kafka-brokers", "KafkaBrokerDown", "30s", "critical",
     "Kafka broker {{ $labels.instance }} is down",
     "Kafka broker {{ $labels.instance }} has been down for more than 30 seconds."),
    ("kafka-brokers", "KafkaHighRequestLatency", "5m", "warning",
     "High Kafka request latency",
     "99th percentile request latency is {{ $value }}ms for {{ $labels.request }} requests."),
    ("kafka-brokers", "KafkaRequestHandlerIdleLow", "5m", "warning",
     "Kafka request handlers are overloaded",
     "Request handler idle percent is {{ $value }}, indicating high broker load."),
    ("kafka-consumers", "KafkaConsumerLagHigh", "5m", "warning",
     "High consumer lag detected",
     "Consumer lag for {{ $labels.topic }}-{{ $labels.partition }} is {{ $value }} messages."),
    ("kafka-consumers", "KafkaConsumerLagGrowing", "10m", "warning",
     "Consumer lag is growing",
     "Consumer lag for {{ $labels.topic }}-{{ $labels.partition }} has increased by {{ $value }} in the last 5 minutes."),
    ("kafka-connect", "KafkaConnectDown", "30s", "critical",
     "Kafka Connect worker is down",
     "Kafka Connect worker {{ $labels.instance }} has been down for more than 30 seconds."),
    ("kafka-connect", "KafkaConnectTaskFailed", "1m", "critical",
     "Kafka Connect task failed",
     "Connector {{ $labels.connector }} task {{ $labels.task }} has failed."),
    ("kafka-connect", "KafkaConnectorNotRunning", "2m", "warning",
     "Kafka connector is not running",
     "Connector {{ $labels.connector }} is in {{ $labels.status }} state."),
    ("kafka-connect", "KafkaConnectNoConnectors", "10m", "info",
     "No connectors deployed",
     "Kafka Connect has no connectors deployed for more than 10 minutes."),
    ("jvm-health", "JvmHeapUsageHigh", "5m", "warning",
     "JVM heap usage is high",
     "JVM heap usage for {{ $labels.kubernetes_pod_name }} is above 90%."),
    ("jvm-health", "JvmGcFrequent", "10m", "warning",
     "Frequent JVM garbage collection",
     "{{ $labels.kubernetes_pod_name }} is experiencing frequent GC."),
    ("schema-registry", "SchemaRegistryDown", "30s", "critical",
     "Schema Registry is down",
     "Schema Registry {{ $labels.instance }} has been down for more than 30 seconds."),
    ("ksqldb", "KsqlDBDown", "30s", "critical",
     "ksqlDB is down",
     "ksqlDB {{ $labels.instance }} has been down for more than 30 seconds."),
    # custom and production rules from the guides
    ("custom", "OrdersTopicNoThroughput", "10m", "warning",
     "Orders topic has zero throughput",
     "No messages have been produced to the Orders topic for 10 minutes."),
    ("production", "KafkaDiskUsageHigh", "5m", "warning",
     "Kafka disk usage above 70%",
     "Disk usage is {{ $value | humanizePercentage }}"),
    ("production", "KafkaNetworkThroughputHigh", "10m", "warning",
     "High network throughput on Kafka",
     "Ingress rate is {{ $value | humanize }}B/s"),
]

RULES = [al.AlertRule(g, a, duration_seconds(f), s, su, de) for g, a, f, s, su, de in RULE_TEXT]
RULE_BY_NAME = {r.alert: r for r in RULES}

# The rules' expressions.
M5 = 300_000
PVC_KAFKA = (("persistentvolumeclaim", "=~", ".*kafka.*"),)
EXPR_TREE = {
    "ActiveControllerCountNotOne": Cmp("!=", 1, Agg("sum", ("env",), Inst(
        "kafka_controller_kafkacontroller_value", (("name", "=", "ActiveControllerCount"),)))),
    "OfflinePartitionCount": Cmp(">", 0, Agg("sum", ("env",), Inst(
        "kafka_controller_kafkacontroller_value", (("name", "=", "OfflinePartitionsCount"),)))),
    "UncleanLeaderElections": Cmp(">", 0, Agg("sum", ("env",), Inst(
        "kafka_controller_controllerstats_oneminuterate", (("name", "=", "UncleanLeaderElectionsPerSec"),)))),
    "UnderReplicatedPartitions": Cmp(">", 0, Agg("sum", ("env",), Inst(
        "kafka_server_replicamanager_value", (("name", "=", "UnderReplicatedPartitions"),)))),
    "UnderMinIsrPartitionCount": Cmp(">", 0, Agg("sum", ("env",), Inst(
        "kafka_server_replicamanager_value", (("name", "=", "UnderMinIsrPartitionCount"),)))),
    "KafkaBrokerCountChanged": Cmp("<", 3, Agg("count", (), Cmp("==", 1, Inst(
        "up", (("job", "=", "kafka-broker"),))))),
    "KafkaBrokerDown": Cmp("==", 0, Inst("up", (("job", "=", "kafka-broker"),))),
    "KafkaHighRequestLatency": Cmp(">", 1000, Inst(
        "kafka_network_requestmetrics_99thpercentile", (("name", "=", "TotalTimeMs"),))),
    "KafkaRequestHandlerIdleLow": Cmp("<", 0.3, Inst(
        "kafka_server_kafkarequesthandlerpool_oneminuterate", (("name", "=", "RequestHandlerAvgIdlePercent"),))),
    "KafkaConsumerLagHigh": Cmp(">", 10000, Inst("kafka_server_fetcherlagmetrics_consumerlag")),
    "KafkaConsumerLagGrowing": Cmp(">", 1000, Delta("kafka_server_fetcherlagmetrics_consumerlag", (), M5)),
    "KafkaConnectDown": Cmp("==", 0, Inst("up", (("job", "=", "kafka-connect"),))),
    "KafkaConnectTaskFailed": Cmp(">", 0, Inst("kafka_connect_connector_task_status", (("status", "=", "failed"),))),
    "KafkaConnectorNotRunning": Cmp(">", 0, Inst("kafka_connect_connector_status", (("status", "!=", "running"),))),
    "KafkaConnectNoConnectors": Cmp("==", 0, Inst("kafka_connect_worker_connector_count")),
    "JvmHeapUsageHigh": Cmp(">", 0.9, Bin("/", Inst("jvm_memory_bytes_used", (("area", "=", "heap"),)),
                                          Inst("jvm_memory_bytes_max", (("area", "=", "heap"),)))),
    "JvmGcFrequent": Cmp(">", 0.5, Rate("jvm_gc_collection_seconds_count", (), M5)),
    "SchemaRegistryDown": Cmp("==", 0, Inst("up", (("job", "=", "schemaregistry"),))),
    "KsqlDBDown": Cmp("==", 0, Inst("up", (("job", "=", "ksqldb"),))),
    "OrdersTopicNoThroughput": Cmp("==", 0, Agg("sum", (), Rate(
        "kafka_server_brokertopicmetrics_messagesinpersec_count", (("topic", "=", "Orders"),), M5))),
    "KafkaDiskUsageHigh": Cmp(">", 0.7, Bin("/", Inst("kubelet_volume_stats_used_bytes", PVC_KAFKA),
                                            Inst("kubelet_volume_stats_capacity_bytes", PVC_KAFKA))),
    "KafkaNetworkThroughputHigh": Cmp(">", 100000000, Rate(
        "kafka_server_brokertopicmetrics_bytesinpersec_count", (), M5)),
}

GROUPS = {
    "alert_broker": [r.alert for r in RULES if r.group == "kafka-brokers"],
    "alert_consumer": [r.alert for r in RULES if r.group == "kafka-consumers"],
    "alert_connect": [r.alert for r in RULES if r.group == "kafka-connect"],
    "alert_jvm": [r.alert for r in RULES if r.group == "jvm-health"],
    "alert_service_down": ["SchemaRegistryDown", "KsqlDBDown"],
    "alert_disk": ["KafkaDiskUsageHigh"],
    "alert_ingress": ["KafkaNetworkThroughputHigh"],
}


# ---------------------------------------------------------------- Spark side

def active_elements(samples, names, p: Params):
    """Every rule's active elements with the rule's hold."""
    found = rules.evaluate(samples, {n: EXPR_TREE[n] for n in names}, p)
    hold = F.create_map(*[F.lit(x) for n in names for x in (n, int(RULE_BY_NAME[n].for_s * 1000))])
    return found.select(F.col("rule").alias("alert"), "t", "labels", "lkey", "value",
                        F.element_at(hold, F.col("rule")).cast("bigint").alias("for_ms"))


def annotate(states, names):
    """Severity and annotation texts, looked up by the rule's name.

    Placed above the hold's window, so that the value is printed by one expression for all
    rules instead of one per branch of the union.
    """
    chosen = [RULE_BY_NAME[n] for n in names]
    forms = al.number_forms([x for r in chosen for x in (r.summary, r.description)])
    texts = {f: F.col(f"_text_{f}") for f in forms}

    def by_rule(make):
        case = None
        for r in chosen:
            hit = (F.col("alert") == F.lit(r.alert), make(r))
            case = F.when(*hit) if case is None else case.when(*hit)
        return case
    shown = states.withColumn("_shown", round6("value")).select(
        "*", *[al.number_text(f, F.col("_shown")).alias(f"_text_{f}") for f in forms])
    return shown.withColumns({
        "severity": by_rule(lambda r: F.lit(r.severity)),
        "summary": by_rule(lambda r: al.render(r.summary, F.col("labels"), F.col("_shown"), texts)),
        "description": by_rule(lambda r: al.render(r.description, F.col("labels"), F.col("_shown"), texts))})


def evaluate(samples, names, p: Params):
    st = annotate(al.hold_states(active_elements(samples, names, p), p.step_ms), names)
    return st.select(
        "alert", (F.col("t") / 1000).cast("bigint").alias("t"), "lkey", "state",
        (F.col("active_since") / 1000).cast("bigint").alias("active_since"),
        F.col("_shown").alias("value"), "severity",
        al.severity_level(F.col("severity")).alias("severity_level"), "summary", "description")


# ---------------------------------------------------------------- SQL side

_TOKEN = re.compile(r"\{\{\s*(\$labels\.([A-Za-z_][A-Za-z0-9_]*)|\$value(?:\s*\|\s*(humanizePercentage|humanize))?)\s*\}\}")


def _go_text(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '<nil>' ELSE regexp_replace(regexp_replace("
            f"CAST(CAST({x} AS DECIMAL(38,10)) AS VARCHAR), '0+$', ''), '\\.$', '') END")


def _sig4(x: str) -> str:
    sc = f"pow(10.0, floor(log10(abs({x}))) - 3)"
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE round({x} / {sc}) * {sc} END)"


def _humanize(x: str) -> str:
    ex = f"least(greatest(floor(log10(abs({x})) / 3), 0), 8)"
    prefix = f"(['', 'k', 'M', 'G', 'T', 'P', 'E', 'Z', 'Y'])[CAST({ex} AS BIGINT) + 1]"
    return f"(CASE WHEN {x} = 0 THEN '0' ELSE {_go_text(_sig4(f'({x}) / pow(1000.0, {ex})'))} || {prefix} END)"


def render_sql(template: str, value: str = "ROUND(value, 6)") -> str:
    parts, pos = [], 0
    for m in _TOKEN.finditer(template):
        if m.start() > pos:
            parts.append(q.lit(template[pos:m.start()]))
        if m.group(2):
            parts.append(f"COALESCE(labels[{q.lit(m.group(2))}], '')")
        elif m.group(3) == "humanize":
            parts.append(_humanize(value))
        elif m.group(3) == "humanizePercentage":
            parts.append(f"{_go_text(_sig4(f'({value}) * 100.0'))} || '%'")
        else:
            parts.append(_go_text(value))
        pos = m.end()
    if pos < len(template):
        parts.append(q.lit(template[pos:]))
    return " || ".join(parts) if parts else "''"


def evaluate_sql(names, p: Params) -> str:
    ctes = [q.samples_cte()]
    selects = []
    for n in names:
        r = RULE_BY_NAME[n]
        v = EXPR_TREE[n].sql(ctes, p)
        selects.append(
            f"SELECT {q.lit(r.alert)} AS alert, t, labels, lkey, value, "
            f"CAST({int(r.for_s * 1000)} AS BIGINT) AS for_ms, {q.lit(r.severity)} AS severity, "
            f"{render_sql(r.summary)} AS summary, {render_sql(r.description)} AS description FROM {v}")
    ctes.append("act AS (" + "\n  UNION ALL ".join(selects) + ")")
    step = p.step_ms
    ctes.append(f"""g AS (SELECT *, t // {step} - ROW_NUMBER() OVER (PARTITION BY alert, lkey ORDER BY t) AS grp
  FROM act)""")
    ctes.append(f"h AS (SELECT *, MIN(t // {step}) OVER (PARTITION BY alert, lkey, grp) * {step} AS since FROM g)")
    levels = " ".join(f"WHEN {q.lit(k)} THEN {v}" for k, v in al.SEVERITY_LEVELS.items())
    return q.with_(*ctes, final=f"""SELECT alert, t // 1000 AS t, lkey,
  CASE WHEN t - since >= for_ms THEN 'firing' ELSE 'pending' END AS state,
  since // 1000 AS active_since, ROUND(value, 6) AS value, severity,
  CASE severity {levels} END AS severity_level, summary, description
FROM h""")


def _reg(qid: str, names, p: Params):
    @register(qid, oracle=evaluate_sql(names, p))
    def _q(spark, sf):
        return evaluate(SampleSource(spark, sf), names, p)
    return _q


for _qid, _names in GROUPS.items():
    _reg(_qid, _names, REF)

def trace(samples, name: str, p: Params):
    """Every step of a rule's expression (before its comparison) with the
    alert state there: ``inactive`` where the condition does not hold."""
    tree = EXPR_TREE[name]
    base = tree.child.df(samples, p)
    st = al.hold_states(active_elements(samples, [name], p), p.step_ms).select("t", "lkey", "state")
    j = base.join(st, ["t", "lkey"], "left")
    return j.select((F.col("t") / 1000).cast("bigint").alias("t"), "lkey",
                    round6("value").alias("value"),
                    F.coalesce(F.col("state"), F.lit("inactive")).alias("state"))


def trace_sql(name: str, p: Params) -> str:
    ctes = [q.samples_cte()]
    v = EXPR_TREE[name].child.sql(ctes, p)
    base = q.with_(*ctes, final=q.vector_out(v))
    return f"""SELECT b.t, b.lkey, b.value, COALESCE(e.state, 'inactive') AS state
FROM ({base}) b LEFT JOIN ({evaluate_sql([name], p)}) e ON b.t = e.t AND b.lkey = e.lkey"""


@register("alert_no_traffic", oracle=trace_sql("OrdersTopicNoThroughput", REF))
def q_alert_no_traffic(spark, sf):
    return trace(SampleSource(spark, sf), "OrdersTopicNoThroughput", REF)


# The whole rule set on the dense grid, where holds of minutes are reachable.
_reg("alert_for", [r.alert for r in RULES], DENSE)


@register("alert_resolved", oracle=f"""SELECT alert, lkey, severity, active_since, MAX(t) + {DENSE.step_ms // 1000} AS t
FROM ({evaluate_sql([r.alert for r in RULES], DENSE)}) ev
GROUP BY alert, lkey, severity, active_since HAVING bool_or(state = 'firing')""")
def q_alert_resolved(spark, sf):
    """The ends of all alerts that fired: the step from which each one is resolved."""
    names = [r.alert for r in RULES]
    held = al.hold_states(active_elements(SampleSource(spark, sf), names, DENSE), DENSE.step_ms)
    ends = al.resolutions(held, DENSE.step_ms)
    severity = F.create_map(*[F.lit(x) for r in RULES for x in (r.alert, r.severity)])
    return ends.select("alert", "lkey", F.element_at(severity, F.col("alert")).alias("severity"),
                       (F.col("active_since") / 1000).cast("bigint").alias("active_since"),
                       (F.col("t") / 1000).cast("bigint").alias("t"))


@register("severity_map", oracle=f"""SELECT severity, severity_level, state, COUNT(*) AS n_rows,
       COUNT(DISTINCT alert) AS n_alerts
FROM ({evaluate_sql([r.alert for r in RULES], DENSE)}) ev
GROUP BY severity, severity_level, state""")
def q_severity_map(spark, sf):
    """Alert activity per severity level (the numeric level map applied to
    every evaluated alert row)."""
    ev = evaluate(SampleSource(spark, sf), [r.alert for r in RULES], DENSE)
    return (ev.groupBy("severity", "severity_level", "state")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("alert").alias("n_alerts")))


# ---------------------------------------------------------------- severity tiers

# Production thresholds per signal -- (signal, tier, op,
# threshold, hold seconds).
TIERS = [
    ("under_replicated", "warning", ">", 0.0, 60.0), ("under_replicated", "critical", ">", 0.0, 300.0),
    ("offline_partitions", "critical", ">", 0.0, 0.0),
    ("consumer_lag", "warning", ">", 10000.0, 300.0), ("consumer_lag", "critical", ">", 100000.0, 300.0),
    ("disk_usage", "warning", ">", 0.70, 0.0), ("disk_usage", "critical", ">", 0.85, 0.0),
    ("cpu_usage", "warning", ">", 0.70, 600.0), ("cpu_usage", "critical", ">", 0.90, 300.0),
    ("jvm_heap", "warning", ">", 0.80, 0.0), ("jvm_heap", "critical", ">", 0.90, 0.0),
    ("request_latency", "warning", ">", 500.0, 0.0), ("request_latency", "critical", ">", 2000.0, 0.0),
    ("broker_down", "critical", "==", 0.0, 0.0),
]

SIGNALS = {
    "under_replicated": Inst("kafka_server_replicamanager_value", (("name", "=", "UnderReplicatedPartitions"),)),
    "offline_partitions": Agg("sum", ("env",), Inst(
        "kafka_controller_kafkacontroller_value", (("name", "=", "OfflinePartitionsCount"),))),
    "consumer_lag": Inst("kafka_server_fetcherlagmetrics_consumerlag"),
    "disk_usage": Bin("/", Inst("kubelet_volume_stats_used_bytes", PVC_KAFKA),
                      Inst("kubelet_volume_stats_capacity_bytes", PVC_KAFKA)),
    "cpu_usage": Bin("/", Agg("sum", ("pod",), Rate("container_cpu_usage_seconds_total", (), M5)),
                     Agg("sum", ("pod",), Inst("kube_pod_container_resource_limits", (("resource", "=", "cpu"),)))),
    "jvm_heap": Bin("/", Inst("jvm_memory_bytes_used", (("area", "=", "heap"),)),
                    Inst("jvm_memory_bytes_max", (("area", "=", "heap"),))),
    "request_latency": Inst("kafka_network_requestmetrics_99thpercentile", (("name", "=", "TotalTimeMs"),)),
    "broker_down": Inst("up", (("job", "=", "kafka-broker"),)),
}


def tiered(samples, p: Params):
    sig = rules.evaluate(samples, SIGNALS, p).select(F.col("rule").alias("signal"), "t", "lkey", "value")
    tiers = samples.spark.createDataFrame(TIERS, al.TIER_SCHEMA)
    m = al.tier_matches(sig, tiers).withColumn("for_ms", (F.col("for_s") * 1000).cast("bigint"))
    st = al.hold_states(m, p.step_ms, keys=("signal", "tier", "lkey"))
    return st.select("signal", "tier", (F.col("t") / 1000).cast("bigint").alias("t"), "lkey",
                     round6("value").alias("value"), "state")


def tiered_sql(p: Params) -> str:
    ctes = [q.samples_cte()]
    sel = []
    for s, tree in SIGNALS.items():
        v = tree.sql(ctes, p)
        sel.append(f"SELECT {q.lit(s)} AS signal, t, lkey, value FROM {v}")
    ctes.append("sig AS (" + " UNION ALL ".join(sel) + ")")
    vals = ", ".join(f"({q.lit(a)}, {q.lit(b)}, {q.lit(c)}, {d!r}, {e!r})" for a, b, c, d, e in TIERS)
    ctes.append(f"tiers AS (SELECT * FROM (VALUES {vals}) x(signal, tier, op, threshold, for_s))")
    ctes.append("""m AS (SELECT s.signal, tr.tier, s.t, s.lkey, s.value, CAST(tr.for_s * 1000 AS BIGINT) AS for_ms
  FROM sig s JOIN tiers tr ON s.signal = tr.signal
  WHERE (tr.op = '>' AND s.value > tr.threshold) OR (tr.op = '<' AND s.value < tr.threshold)
     OR (tr.op = '==' AND s.value = tr.threshold) OR (tr.op = '>=' AND s.value >= tr.threshold))""")
    st = p.step_ms
    ctes.append(f"""g AS (SELECT *, t // {st} - ROW_NUMBER() OVER (PARTITION BY signal, tier, lkey ORDER BY t) AS grp FROM m)""")
    ctes.append(f"h AS (SELECT *, MIN(t // {st}) OVER (PARTITION BY signal, tier, lkey, grp) * {st} AS since FROM g)")
    return q.with_(*ctes, final="""SELECT signal, tier, t // 1000 AS t, lkey, ROUND(value, 6) AS value,
  CASE WHEN t - since >= for_ms THEN 'firing' ELSE 'pending' END AS state FROM h""")


@register("severity_tiers", oracle=tiered_sql(REF))
def q_severity_tiers(spark, sf):
    """Warning and critical tiers per signal, each with its own hold."""
    return tiered(SampleSource(spark, sf), REF)
