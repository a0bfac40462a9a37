"""Labelled metric samples derived from the ``events`` table.

Each ``events`` row is read as one scrape of one component of the platform
that carries the order stream: ``event_type`` names the component, ``user_id``
picks which of its three replicas was scraped, ``ts`` is the scrape time and
``value`` drives the readings.  One scrape yields one sample per metric family
of that component (the families below), so the sample table grows linearly
with ``events``.

Counter families accumulate an integer increment per scrape (a running sum per
series) and restart from zero at ``COUNTER_RESET_MS`` -- a planted process
restart so that every counter series contains one reset.  Cumulative gauges
accumulate the same way without the restart.

The family table is the single description of the derivation: the Spark job
evaluates its SQL expressions with ``F.expr`` and the SQL oracle pastes the
same expressions into DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import all_match, labels_key
from ..functions.time import epoch_millis
from ..operators.sequence import running_sum
from ..operators.series import catalogue, label_id
from .tables import read_table, spread

# ---------------------------------------------------------------- fixed values
# Component per event type: (job label, pod name prefix, container name).
COMPONENTS = {
    "click": ("kafka-broker", "kafka", "kafka"),
    "error": ("kafka-controller", "kraftcontroller", "kraftcontroller"),
    "view": ("kafka-connect", "connect", "connect"),
    "purchase": ("schemaregistry", "schemaregistry", "schemaregistry"),
    "signup": ("ksqldb", "ksqldb", "ksqldb"),
}
REPLICAS = 3
ENV = "dev"
NAMESPACE = "confluent"
CLUSTER = "local"
COUNTER_RESET_MS = 1705276800000          # 2024-01-15T00:00:00Z
# Bucket width of the per-series running sums: bounds the rows one task sorts
# for a hot series (a minute of it) while the per-bucket summary never has
# more rows than the input.
SEQ_BUCKET_MS = 60_000


@dataclass(frozen=True)
class Family:
    components: tuple[str, ...]       # event types that emit it; () = all
    metric: str
    kind: str                         # gauge | counter | cumulative
    expr: str                         # gauge value, or integer increment
    labels: dict = field(default_factory=dict)   # name -> SQL expression
    scale: float = 1.0                # counter value = running increments * scale


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CONNECTOR = "CASE WHEN user_id % 2 = 0 THEN 'datagen-orders' ELSE 'jdbc-sink-orders' END"
_UNITS = "CAST(ROUND(value * 100) AS BIGINT)"
_PVC = "PVC"   # placeholder replaced by 'data0-' || pod

FAMILIES: tuple[Family, ...] = (
    # every component
    Family((), "up", "gauge", "CASE WHEN value < 2 THEN 0.0 ELSE 1.0 END"),
    Family((), "jvm_memory_bytes_used", "gauge", "value * 10000000.0", {"area": _lit("heap")}),
    Family((), "jvm_memory_bytes_max", "gauge", "4500000000.0", {"area": _lit("heap")}),
    Family((), "jvm_gc_collection_seconds_count", "counter", "1", {"gc": _lit("G1 Young Generation")}),
    Family((), "jvm_gc_collection_seconds_sum", "counter", _UNITS, {"gc": _lit("G1 Young Generation")}, 0.001),
    Family((), "container_memory_working_set_bytes", "gauge", "value * 10000000.0", {"container": "CONTAINER"}),
    Family((), "kube_pod_container_resource_limits", "gauge", "4000000000.0",
           {"container": "CONTAINER", "resource": _lit("memory")}),
    Family((), "kube_pod_container_resource_limits", "gauge", "2.0",
           {"container": "CONTAINER", "resource": _lit("cpu")}),
    Family((), "container_cpu_usage_seconds_total", "counter", _UNITS, {"container": "CONTAINER"}, 0.0001),
    # brokers
    Family(("click",), "kafka_server_replicamanager_value", "gauge",
           "CASE WHEN value > 300 THEN 1.0 ELSE 0.0 END", {"name": _lit("UnderReplicatedPartitions")}),
    Family(("click",), "kafka_server_replicamanager_value", "gauge",
           "CASE WHEN value > 400 THEN 1.0 ELSE 0.0 END", {"name": _lit("UnderMinIsrPartitionCount")}),
    Family(("click",), "kafka_network_requestmetrics_99thpercentile", "gauge", "value * 10.0",
           {"name": _lit("TotalTimeMs"), "request": _lit("Produce")}),
    Family(("click",), "kafka_server_kafkarequesthandlerpool_oneminuterate", "gauge",
           "1.0 - value / 400.0", {"name": _lit("RequestHandlerAvgIdlePercent")}),
    Family(("click",), "kafka_server_fetcherlagmetrics_consumerlag", "gauge", "value * 200.0",
           {"topic": _lit("Orders"), "partition": "CAST(user_id % 6 AS STRING)"}),
    Family(("click",), "kafka_server_brokertopicmetrics_messagesinpersec_count", "counter", "1",
           {"topic": _lit("Orders")}),
    Family(("click",), "kafka_server_brokertopicmetrics_bytesinpersec_count", "counter", _UNITS,
           {"topic": _lit("Orders")}, 10000000.0),
    Family(("click",), "kafka_log_log_size", "cumulative", _UNITS, {"topic": _lit("Orders")}, 1000000.0),
    Family(("click",), "kube_persistentvolumeclaim_resource_requests_storage_bytes", "gauge",
           "10000000000000.0", {"persistentvolumeclaim": _PVC}),
    Family(("click",), "kubelet_volume_stats_used_bytes", "cumulative", _UNITS,
           {"persistentvolumeclaim": _PVC}, 1000000.0),
    Family(("click",), "kubelet_volume_stats_capacity_bytes", "gauge", "4000000000000.0",
           {"persistentvolumeclaim": _PVC}),
    # controllers
    Family(("error",), "kafka_controller_kafkacontroller_value", "gauge",
           "CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END", {"name": _lit("ActiveControllerCount")}),
    Family(("error",), "kafka_controller_kafkacontroller_value", "gauge",
           "CASE WHEN value > 450 THEN 1.0 ELSE 0.0 END", {"name": _lit("OfflinePartitionsCount")}),
    Family(("error",), "kafka_controller_controllerstats_oneminuterate", "gauge",
           "CASE WHEN value > 250 THEN value / 1000.0 ELSE 0.0 END",
           {"name": _lit("UncleanLeaderElectionsPerSec")}),
    # connect workers
    Family(("view",), "kafka_connect_connector_task_status", "gauge", "1.0",
           {"connector": _CONNECTOR, "task": _lit("0"),
            "status": "CASE WHEN value > 300 THEN 'failed' ELSE 'running' END"}),
    Family(("view",), "kafka_connect_connector_status", "gauge", "1.0",
           {"connector": _CONNECTOR,
            "status": "CASE WHEN value > 250 THEN 'paused' ELSE 'running' END"}),
    Family(("view",), "kafka_connect_worker_connector_count", "gauge",
           "CASE WHEN value < 1 THEN 0.0 ELSE 2.0 END"),
    Family(("view",), "confluent.kafka.connect.worker.connector_running_task_count", "gauge",
           "CASE WHEN value > 300 THEN 0.0 ELSE 1.0 END", {"connector": _CONNECTOR}),
    Family(("view",), "confluent.kafka.connect.worker.connector_failed_task_count", "gauge",
           "CASE WHEN value > 300 THEN 1.0 ELSE 0.0 END", {"connector": _CONNECTOR}),
    Family(("view",), "confluent.kafka.connect.worker.connector_paused_task_count", "gauge",
           "CASE WHEN value > 250 AND value <= 300 THEN 1.0 ELSE 0.0 END", {"connector": _CONNECTOR}),
    Family(("view",), "confluent.kafka.connect.worker.connector_total_task_count", "gauge", "1.0",
           {"connector": _CONNECTOR}),
    Family(("view",), "confluent.kafka.connect.source_task.source_record_write_rate", "gauge", "value",
           {"connector": _CONNECTOR}),
    Family(("view",), "jvm.heap_memory", "gauge", "value * 1000000.0"),
    Family(("view",), "jvm.heap_memory_max", "gauge", "1000000000.0"),
    Family(("view",), "jvm.cpu_load.process", "gauge", "value / 500.0"),
    # dashboard panels: threads on every component, broker disk I/O counters
    Family((), "jvm_threads_current", "gauge", "20.0 + FLOOR(value / 10)"),
    Family(("click",), "kafka_server_kafkaserver_value", "cumulative", _UNITS,
           {"name": _lit("linux-disk-read-bytes")}, 4096.0),
    Family(("click",), "kafka_server_kafkaserver_value", "cumulative", _UNITS,
           {"name": _lit("linux-disk-write-bytes")}, 8192.0),
)


def _emitting(fam: Family) -> list[str]:
    return list(fam.components) if fam.components else list(COMPONENTS)


def _label_exprs(fam: Family, comp: str) -> dict[str, str]:
    """All labels of a family for one component, as SQL expressions."""
    job, prefix, container = COMPONENTS[comp]
    pod = f"'{prefix}-' || CAST(user_id % {REPLICAS} AS STRING)"
    base = {"job": _lit(job), "instance": pod, "pod": pod, "namespace": _lit(NAMESPACE),
            "env": _lit(ENV), "cluster": _lit(CLUSTER)}
    if "." in fam.metric:      # tag-style metrics carry the agent's tag names
        base.update({"kube_namespace": _lit(NAMESPACE), "kube_container_name": _lit(container)})
    for k, v in fam.labels.items():
        if v == "CONTAINER":
            v = _lit(container)
        elif v == _PVC:
            v = f"'data0-' || {pod}"
        base[k] = v
    return base


# ---------------------------------------------------------------- Spark side

def _struct_sql(fam: Family, comp: str) -> str:
    """One family's sample struct as Spark SQL text (parsed once on the JVM)."""
    lab = _label_exprs(fam, comp)
    kv = ", ".join(f"{_lit(k)}, CAST({lab[k]} AS STRING)" for k in sorted(lab))
    acc = fam.kind != "gauge"
    gauge = "CAST(NULL AS DOUBLE)" if acc else f"CAST({fam.expr} AS DOUBLE)"
    inc = f"CAST({fam.expr} AS BIGINT)" if acc else "CAST(NULL AS BIGINT)"
    return (f"named_struct('metric', {_lit(fam.metric)}, 'labels', map({kv}), 'kind', {_lit(fam.kind)}, "
            f"'gauge', {gauge}, 'inc', {inc}, 'scale', CAST({fam.scale!r} AS DOUBLE))")


def _scrapes(events: DataFrame, families) -> DataFrame:
    by_comp: dict[str, list[str]] = {}
    for fam in families:
        for comp in _emitting(fam):
            by_comp.setdefault(comp, []).append(_struct_sql(fam, comp))
    case = "CASE " + " ".join(f"WHEN event_type = {_lit(c)} THEN array({', '.join(st)})"
                              for c, st in by_comp.items()) + " END"
    return events.select(
        F.col("event_id").alias("sample_id"),
        epoch_millis("ts").alias("ts"),
        F.explode(F.expr(case)).alias("s")).select("sample_id", "ts", "s.*")


def metric_samples(spark: SparkSession, sf_dir: str, families=FAMILIES,
                   bucket_ms: int = SEQ_BUCKET_MS, many: bool = False) -> DataFrame:
    """``metric, labels, lkey, series, ts (epoch ms), sample_id, value``.

    ``lkey`` is the canonical text of the label set and ``series`` the metric
    name plus ``lkey``; they are the identity used for grouping and matching
    (maps cannot be grouping or join keys).
    """
    comps = sorted({c for f in families for c in _emitting(f)})
    events = (read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "user_id"])
              .where(F.col("event_type").isin(comps)))
    if many:                                                     # one event makes many samples
        events = spread(events, "event_id")
    gauges = [f for f in families if f.kind == "gauge"]
    accs = [f for f in families if f.kind != "gauge"]
    parts = []
    if gauges:
        g = _scrapes(events, gauges)
        parts.append(g.select("metric", "labels", "ts", "sample_id", F.col("gauge").alias("value")))
    if accs:
        a = _scrapes(events, accs)
        a = a.withColumn("series", F.concat(F.col("metric"), labels_key("labels")))
        a = a.withColumn("_epoch", F.when((F.col("kind") == "counter")
                                          & (F.col("ts") >= F.lit(COUNTER_RESET_MS)), 1).otherwise(0))
        a = running_sum(a, ["series", "_epoch"], "ts", "sample_id", "inc", "_run", bucket_ms)
        parts.append(a.select("metric", "labels", "ts", "sample_id",
                              (F.col("_run") * F.col("scale")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lk = labels_key("labels")
    return out.select("metric", "labels", lk.alias("lkey"),
                      F.concat(F.col("metric"), lk).alias("series"), "ts", "sample_id", "value")


def samples_by_id(spark: SparkSession, sf_dir: str, families, matchers=(), bucket_ms: int = SEQ_BUCKET_MS) -> DataFrame:
    """``lid, ts, sample_id, value``: samples that name their label set by a fixed-width id.

    Matchers and ids are evaluated where the labels are made, in the scan's stage: no label text or map is shuffled.
    For the families of one metric, as the id does not tell metrics apart.
    """
    comps = sorted({c for f in families for c in _emitting(f)})
    events = (read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "user_id"])
              .where(F.col("event_type").isin(comps)))
    s = _scrapes(events, families).where(all_match("labels", matchers)).withColumn("lid", label_id(labels_key("labels")))
    if all(f.kind == "gauge" for f in families):
        return s.select("lid", "ts", "sample_id", F.col("gauge").alias("value"))
    if any(f.kind == "gauge" for f in families):
        raise ValueError("a metric is either a gauge or accumulated")
    restarted = (F.col("kind") == "counter") & (F.col("ts") >= F.lit(COUNTER_RESET_MS))
    a = s.select("lid", F.when(restarted, 1).otherwise(0).alias("_epoch"), "ts", "sample_id", "inc", "scale")
    a = running_sum(a, ["lid", "_epoch"], "ts", "sample_id", "inc", "_run", bucket_ms)
    return a.select("lid", "ts", "sample_id", (F.col("_run") * F.col("scale")).alias("value"))


def sample_catalogue(spark: SparkSession, sf_dir: str, families) -> DataFrame:
    """The label sets of the families: one row per id, from the columns that labels are made of."""
    comps = sorted({c for f in families for c in _emitting(f)})
    events = (read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value", "user_id"])
              .where(F.col("event_type").isin(comps)))
    return catalogue(_scrapes(events, families))


class SampleSource:
    """Lazily derived samples, built per metric name.

    A selector names its metric, so only that metric's families are expanded
    and only the components that emit it are read (the ``event_type`` filter
    reaches the parquet scan).  This plays the role that partitioning a stored
    sample table by ``metric`` plays at scale: a selector never touches other
    metrics' rows.  The per-metric DataFrames are memoised so that a query
    using one selector twice gets one plan subtree (and reused exchanges).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, families=FAMILIES,
                 bucket_ms: int = SEQ_BUCKET_MS):
        self.spark, self.sf_dir, self.families, self.bucket_ms = spark, sf_dir, families, bucket_ms
        self._memo: dict[str, DataFrame] = {}

    def metrics(self) -> list[str]:
        return sorted({f.metric for f in self.families})

    def for_metrics(self, metrics) -> DataFrame:
        """Samples of several metrics from one pass over ``events``."""
        fams = [f for f in self.families if f.metric in set(metrics)]
        missing = sorted(set(metrics) - {f.metric for f in fams})
        if missing:
            raise KeyError(f"no samples are derived for metrics {missing}")
        return metric_samples(self.spark, self.sf_dir, fams, self.bucket_ms, many=True)

    def for_metric(self, metric: str) -> DataFrame:
        if metric not in self._memo:
            fams = [f for f in self.families if f.metric == metric]
            if not fams:
                raise KeyError(f"no samples are derived for metric {metric!r}")
            self._memo[metric] = metric_samples(self.spark, self.sf_dir, fams, self.bucket_ms)
        return self._memo[metric]

    def _of(self, *metrics: str) -> list[Family]:
        missing = sorted(set(metrics) - {f.metric for f in self.families})
        if missing:
            raise KeyError(f"no samples are derived for metrics {missing}")
        return [f for f in self.families if f.metric in metrics]

    def by_id(self, metric: str, matchers=()) -> DataFrame:
        """Samples of one metric with ids for their label sets."""
        return samples_by_id(self.spark, self.sf_dir, self._of(metric), matchers, self.bucket_ms)

    def catalogue(self, *metrics: str) -> DataFrame:
        """The label sets behind the ids of these metrics."""
        return sample_catalogue(self.spark, self.sf_dir, self._of(*metrics))

    def all(self) -> DataFrame:
        return metric_samples(self.spark, self.sf_dir, self.families, self.bucket_ms)

    def memo(self, key: tuple, build):
        """Memoise a derived DataFrame (e.g. a metric's instant vector) so that
        expressions sharing it reference one plan subtree."""
        k = ("derived",) + tuple(key)
        if k not in self._memo:
            self._memo[k] = build()
        return self._memo[k]


# ---------------------------------------------------------------- SQL side

def _sql_map(lab: dict[str, str]) -> str:
    keys = sorted(lab)
    return "MAP {" + ", ".join(f"{_lit(k)}: CAST({lab[k]} AS VARCHAR)" for k in keys) + "}"


def samples_sql(families=FAMILIES) -> str:
    """DuckDB CTE body producing the same table as :func:`metric_samples`."""
    selects = []
    for fam in families:
        for comp in _emitting(fam):
            lab = _label_exprs(fam, comp)
            if fam.kind == "gauge":
                val, inc = f"CAST({fam.expr} AS DOUBLE)", "CAST(NULL AS BIGINT)"
            else:
                val, inc = "CAST(NULL AS DOUBLE)", f"CAST({fam.expr} AS BIGINT)"
            selects.append(
                f"SELECT event_id AS sample_id, epoch_us(ts) // 1000 AS ts, {_lit(fam.metric)} AS metric, "
                f"{_sql_map(lab)} AS labels, {_lit(fam.kind)} AS kind, {val} AS gauge, {inc} AS inc, "
                f"CAST({fam.scale!r} AS DOUBLE) AS scale FROM events WHERE event_type = {_lit(comp)}")
    raw = "\n  UNION ALL ".join(selects)
    lk = ("'{' || array_to_string(list_sort(list_transform(map_entries(labels), "
          "lambda e: e.key || '=\"' || e.value || '\"')), ',') || '}'")
    return f"""(
  WITH raw AS ({raw}),
  keyed AS (SELECT *, {lk} AS lkey FROM raw),
  valued AS (
    SELECT metric, labels, lkey, ts, sample_id,
      CASE WHEN kind = 'gauge' THEN gauge
           ELSE SUM(inc) OVER (PARTITION BY metric, lkey,
                                 CASE WHEN kind = 'counter' AND ts >= {COUNTER_RESET_MS} THEN 1 ELSE 0 END
                               ORDER BY ts, sample_id ROWS UNBOUNDED PRECEDING) * scale END AS value
    FROM keyed)
  SELECT metric, labels, lkey, metric || lkey AS series, ts, sample_id, value FROM valued)"""
