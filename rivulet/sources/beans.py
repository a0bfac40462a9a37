"""Raw managed-bean readings and scrape targets derived from ``events``.

Each ``events`` row is one scrape of one component (the same mapping as the
sample table): the component's pods expose the readings listed here, in the
``domain<properties><keys>attribute: value`` form the rewrite rules match.
Readings are SQL expressions over the event columns, shared by the Spark job
and the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import epoch_millis
from .tables import read_table, spread

_U3 = "CAST(user_id % 3 AS STRING)"
_U6 = "CAST(user_id % 6 AS STRING)"
_CONN = "CASE WHEN user_id % 2 = 0 THEN 'datagen-orders' ELSE 'jdbc-sink-orders' END"
_INT = "CAST(CAST(ROUND({}) AS BIGINT) AS STRING)"
_DBL = "CAST({} AS STRING)"

# (event_type, component, bean text SQL, value SQL, value text SQL)
READINGS = [
    ("click", "kafka", "'kafka.server<type=ReplicaManager, name=UnderReplicatedPartitions><>Value'",
     "CASE WHEN value > 300 THEN 1 ELSE 0 END", None),
    ("click", "kafka", "'kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=Orders><>OneMinuteRate'",
     "value", None),
    ("click", "kafka", "'kafka.server<type=BrokerTopicMetrics, name=MessagesInPerSec, topic=Orders><>Count'",
     "CAST(event_id AS DOUBLE)", None),
    ("click", "kafka", "'kafka.server<type=BrokerTopicMetrics, name=BytesInPerSec><>FiveMinuteRate'",
     "value * 100", None),
    ("click", "kafka", "'kafka.network<type=RequestMetrics, name=RequestsPerSec, request=Produce, version=9><>OneMinuteRate'",
     "value / 10", None),
    ("click", "kafka", "'kafka.network<type=RequestMetrics, name=TotalTimeMs, request=Produce><>99thPercentile'",
     "value * 10", None),
    ("click", "kafka", "'kafka.network<type=RequestMetrics, name=RequestQueueTimeMs><>50thPercentile'",
     "value / 4", None),
    ("click", "kafka", f"'kafka.log<type=Log, name=Size, topic=Orders, partition=' || {_U6} || '><>Value'",
     "value * 1000", None),
    ("click", "kafka", f"'kafka.server<type=FetcherLagMetrics, name=ConsumerLag, clientId=ReplicaFetcherThread-0-' || {_U3} || ', topic=Orders, partition=' || {_U6} || '><>Value'",
     "value * 200", None),
    ("click", "kafka", "'kafka.coordinator.group<type=GroupMetadataManager, name=NumGroups><>Value'", "3", None),
    ("click", "kafka", "'kafka.server<type=KafkaServer, name=linux-disk-read-bytes><>Value'", "value * 4096", None),
    ("click", "kafka", "'kafka.network<type=RequestMetrics, name=DeprecatedRequestsPerSec, request=Fetch, version=11, clientSoftwareName=apache-kafka-java, clientSoftwareVersion=3.6.0><>Count'",
     "1", None),
    ("click", "kafka", "'kafka.server<type=raft-metrics><>commit-latency-avg'", "value / 100", None),
    ("click", "kafka", f"'confluent.licensing<type=LicenseDetails, component=kafka-' || {_U3} || '><>Value'", "1", None),
    ("click", "kafka", "'java.lang<type=Memory><HeapMemoryUsage>used'", "value * 1000", "int"),
    ("error", "kraftcontroller", "'kafka.controller<type=KafkaController, name=ActiveControllerCount><>Value'",
     "CASE WHEN value > 100 THEN 1 ELSE 0 END", None),
    ("error", "kraftcontroller", "'kafka.controller<type=ControllerStats, name=UncleanLeaderElectionsPerSec><>Count'",
     "CASE WHEN value > 250 THEN 1 ELSE 0 END", None),
    ("error", "kraftcontroller", "'kafka.controller<type=ControllerEventManager, name=EventQueueTimeMs><>99thPercentile'",
     "value", None),
    ("error", "kraftcontroller", "'kafka.controller<type=ControllerChannelManager, name=TotalQueueSize><>Value'",
     "CAST(user_id % 5 AS DOUBLE)", None),
    ("error", "kraftcontroller", "'kafka.server<type=raft-metrics><>current-leader'", "CAST(user_id % 3 AS DOUBLE)", None),
    ("view", "connect", "'kafka.connect<type=connect-worker-metrics><>connector-count'",
     "CASE WHEN value < 1 THEN 0 ELSE 2 END", None),
    ("view", "connect", f"'kafka.connect<type=connect-worker-metrics, connector=' || {_CONN} || '><>connector-running-task-count'",
     "CASE WHEN value > 300 THEN 0 ELSE 1 END", None),
    ("view", "connect", f"'kafka.connect<type=connector-metrics, connector=' || {_CONN} || '><>connector-startup-attempts-total'",
     "1", None),
    ("view", "connect", "'kafka.connect<type=sink-task-metrics, connector=jdbc-sink-orders, task=0><>sink-record-read-rate'",
     "value", None),
    ("view", "connect", f"'kafka.connect<type=connector-task-metrics, connector=' || {_CONN} || ', task=0><>batch-size-avg'",
     "value / 2", None),
    ("view", "connect", f"'kafka.connect<type=task-error-metrics, connector=' || {_CONN} || ', task=0><>total-record-errors'",
     "CASE WHEN value > 300 THEN 1 ELSE 0 END", None),
    ("view", "connect", f"'kafka.connect<type=connect-coordinator-metrics, client-id=connect-' || {_U3} || '><>assigned-connectors'",
     "1", None),
    ("view", "connect", f"'kafka.connect<type=connect-metrics, client-id=connect-' || {_U3} || '><>request-rate'",
     "value / 10", None),
    ("view", "connect", f"'kafka.connect<type=app-info, client-id=connect-' || {_U3} || '><>version'",
     "CAST(NULL AS DOUBLE)", "'7.6.0'"),
    ("view", "connect", "'kafka.connect<type=connect-worker-rebalance-metrics><>completed-rebalances-total'",
     "CAST(user_id % 7 AS DOUBLE)", None),
    ("view", "connect", f"'kafka.connect<type=connector-predicate-metrics, connector=' || {_CONN} || '><>predicate-count'",
     "1", None),
    ("view", "connect", "'java.lang<type=Runtime><>Uptime'", "CAST(event_id AS DOUBLE)", "int"),
    ("signup", "ksqldb", "'io.confluent.ksql.metrics<type=ksql-engine-query-stats><>num-active-queries'", "6", None),
    ("signup", "ksqldb", "'io.confluent.ksql.metrics<type=ksql-queries, query-id=CTAS_ORDERS_BY_STATE_1, status=RUNNING><>processing-rate'",
     "value", None),
    ("signup", "ksqldb", f"'io.confluent.ksql.metrics<type=consumer-metrics, client-id=ksql-' || {_U3} || '><>messages-consumed-per-sec'",
     "value / 3", None),
    ("signup", "ksqldb", "'java.lang<type=GarbageCollector, name=G1 Young Generation><>CollectionCount'",
     "CAST(event_id AS DOUBLE)", "int"),
    ("signup", "ksqldb", "'java.lang<type=Threading><>ThreadCount'", "40", "int"),
    ("purchase", "schemaregistry", "'kafka.schema.registry<type=jetty-metrics><>connections-active'",
     "CAST(user_id % 4 AS DOUBLE)", None),
    ("purchase", "schemaregistry", "'kafka.schema.registry<type=jersey-metrics, path=subjects><>request-rate'",
     "value / 5", None),
    ("purchase", "schemaregistry", "'java.lang<type=GarbageCollector, name=G1 Old Generation><>CollectionTime'",
     "value * 3", "int"),
    ("purchase", "kafkarestproxy", "'kafka.rest<type=jersey-metrics, path=topics, method=POST><>request-rate'",
     "value / 5", None),
    ("purchase", "kafkarestproxy", "'kafka.rest<type=jetty-metrics><>connections-active'", "2", None),
    ("purchase", "kafkarestproxy", "'java.lang<type=Memory><NonHeapMemoryUsage>committed'", "value * 500", "int"),
]


def _value_text(value_sql: str, kind) -> str:
    if kind == "int":
        return _INT.format(value_sql)
    if kind:
        return kind
    return _DBL.format(f"CAST({value_sql} AS DOUBLE)")


def reading_sql(component=None) -> list[tuple[str, str, str, str]]:
    """(event_type, component, bean-with-value SQL, value SQL) per reading;
    ``component`` is one name or a collection of names (None = all)."""
    if isinstance(component, str):
        component = (component,)
    out = []
    for et, comp, bean, val, kind in READINGS:
        if component and comp not in component:
            continue
        out.append((et, comp, f"{bean} || ': ' || {_value_text(val, kind)}", f"CAST({val} AS DOUBLE)"))
    return out


def _by_index(cases: list[str]) -> str:
    """``CASE`` over the index ``i`` of a reading; readings with equal SQL share a branch."""
    shared: dict[str, list[str]] = {}
    for i, sql in enumerate(cases):
        shared.setdefault(sql, []).append(str(i))
    return "CASE " + " ".join(f"WHEN i IN ({', '.join(on)}) THEN {sql}" for sql, on in shared.items()) + " END"


def bean_readings(spark: SparkSession, sf_dir: str, component=None) -> DataFrame:
    """``component, bean, ts (epoch ms), sample_id, value`` per reading.

    An event is expanded into the indices of its readings, and a reading's text is made from its index: names and values are
    two ``CASE`` expressions, and the value is printed by one expression for all.  (One array of all
    finished readings per event makes a generated method that is too long for the JVM to compile.)
    """
    if isinstance(component, str):
        component = (component,)
    rs = [r for r in READINGS if not component or r[1] in component]
    types = sorted({et for et, *_ in rs})
    ev = (read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "user_id"])
          .where(F.col("event_type").isin(types)))
    ev = spread(ev, "event_id")                                  # one event makes many readings
    found = "CASE " + " ".join(
        f"WHEN event_type = '{et}' THEN array({', '.join(str(i) for i, r in enumerate(rs) if r[0] == et)})" for et in types) + " END"
    indexed = ev.select("event_id", "ts", "value", "user_id", F.explode(F.expr(found)).alias("i"))
    # a one-element array is expanded once, however many columns and filters take from it
    made = F.struct(F.expr(_by_index([f"'{comp}'" for _, comp, *_ in rs])).alias("component"),
                    F.expr(_by_index([bean for _, _, bean, *_ in rs])).alias("name"),
                    F.expr(_by_index([f"CAST({val} AS DOUBLE)" for *_, val, _ in rs])).alias("value"))
    named = indexed.select("event_id", "ts", "i", F.explode(F.array(made)).alias("r"))
    text = F.expr(_by_index([_value_text("r.value", kind) for *_, kind in rs]))
    whole = named.select("event_id", "ts", "r", F.explode(F.array(F.concat("r.name", F.lit(": "), text))).alias("bean"))
    return whole.select("r.component", "bean", epoch_millis("ts").alias("ts"), F.col("event_id").alias("sample_id"), "r.value")


def readings_sql_cte(component=None) -> str:
    parts = [f"SELECT '{comp}' AS component, {b} AS bean, epoch_us(ts) // 1000 AS ts, "
             f"event_id AS sample_id, {v} AS value FROM events WHERE event_type = '{et}'"
             for et, comp, b, v in reading_sql(component)]
    return "(" + "\n UNION ALL ".join(parts) + ")"


# ---------------------------------------------------------------- scrape targets

_PREFIX = ("CASE event_type WHEN 'click' THEN 'kafka' WHEN 'error' THEN 'kraftcontroller' "
           "WHEN 'view' THEN 'connect' WHEN 'purchase' THEN 'schemaregistry' ELSE 'ksqldb' END")
_POD = f"{_PREFIX} || '-' || {_U3}"

# Discovered-target metadata of the scraped pod (label name -> SQL expression).
TARGET_LABELS = {
    "__address__": f"{_POD} || '.' || {_PREFIX} || '.confluent.svc.cluster.local:7778'",
    "__meta_kubernetes_pod_name": _POD,
    "__meta_kubernetes_namespace": "'confluent'",
    "__meta_kubernetes_pod_label_app": _PREFIX,
    "__meta_kubernetes_pod_label_platform_confluent_io_type": _PREFIX,
    "__meta_kubernetes_pod_container_port_name": "CASE WHEN value < 5 THEN 'jmx' ELSE 'prometheus' END",
    "__meta_kubernetes_service_name": _PREFIX,
    "__name__": "'up'",
}


def scrape_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled ``up`` reading per scrape, with target metadata labels."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "user_id"])
    kv = []
    for k in sorted(TARGET_LABELS):
        kv += [F.lit(k), F.expr(TARGET_LABELS[k])]
    return ev.select(F.col("event_id").alias("sample_id"), epoch_millis("ts").alias("ts"),
                     F.create_map(*kv).alias("labels"),
                     F.when(F.col("value") < 2, 0.0).otherwise(1.0).alias("value"))


def scrape_targets_sql() -> str:
    m = "MAP {" + ", ".join(f"'{k}': {TARGET_LABELS[k]}" for k in sorted(TARGET_LABELS)) + "}"
    return (f"(SELECT event_id AS sample_id, epoch_us(ts) // 1000 AS ts, {m} AS labels, "
            f"CAST(CASE WHEN value < 2 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS value FROM events)")


def _internal_service_sql() -> str:
    return f"{_PREFIX} || '-' || {_U3} || '-internal'"


def service_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets as service discovery reports them: every pod is found once
    through its component's headless service and once through its own
    ``<pod>-internal`` service, so each scrape appears twice (one scan, one
    two-element explode)."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "user_id"])
    svc_key = "__meta_kubernetes_service_name"
    kv = []
    for k in sorted(TARGET_LABELS):
        if k != svc_key:
            kv += [F.lit(k), F.expr(TARGET_LABELS[k])]
    svc = F.explode(F.array(F.expr(TARGET_LABELS[svc_key]), F.expr(_internal_service_sql())))
    return (ev.select(F.col("event_id").alias("sample_id"), epoch_millis("ts").alias("ts"),
                      F.create_map(*kv).alias("base"), svc.alias("svc"),
                      F.when(F.col("value") < 2, 0.0).otherwise(1.0).alias("value"))
            .select("sample_id", "ts", F.map_concat("base", F.create_map(F.lit(svc_key), F.col("svc"))).alias("labels"),
                    "value"))


def service_endpoints_sql() -> str:
    svc_key = "__meta_kubernetes_service_name"
    base = "MAP {" + ", ".join(f"'{k}': {TARGET_LABELS[k]}" for k in sorted(TARGET_LABELS) if k != svc_key) + "}"
    return (f"(SELECT sample_id, ts, map_concat(base, MAP {{'{svc_key}': svc}}) AS labels, value FROM "
            f"(SELECT event_id AS sample_id, epoch_us(ts) // 1000 AS ts, {base} AS base, "
            f"unnest([{TARGET_LABELS[svc_key]}, {_internal_service_sql()}]) AS svc, "
            f"CAST(CASE WHEN value < 2 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS value FROM events))")
