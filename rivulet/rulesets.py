"""Rule lists used by the rewrite and relabel operators.

Fixed values: these patterns, name templates, label templates and types are
the component rule lists as configured (order matters: first match wins).
"""

from .operators.rewrite import BeanRule as R
from .operators.rewrite import Relabel

# ---------------------------------------------------------------- fixed values
KAFKA_RULES = (
    R(r"kafka.network<type=RequestMetrics, name=DeprecatedRequestsPerSec, request=(.+), version=(.+), clientSoftwareName=(.+), clientSoftwareVersion=(.+)><>(Count)",
      "kafka_network_requestmetrics_deprecatedrequestspersec_$5",
      {"api_name": "$1", "api_version": "$2", "client_software_name": "$3", "client_software_version": "$4"}, "COUNTER"),
    R(r"kafka.server<type=(.+), name=(.+), clientId=(.+), topic=(.+), partition=(.*)><>Value",
      "kafka_server_$1_$2", {"clientId": "$3", "topic": "$4", "partition": "$5"}, "GAUGE"),
    R(r"kafka.(\w+)<type=(.+), name=(.+), topic=(.+), partition=(.+)><>Value",
      "kafka_$1_$2_$3", {"topic": "$4", "partition": "$5"}, "GAUGE"),
    R(r"kafka.server<type=(.+), name=(.+), clientId=(.+), brokerHost=(.+), brokerPort=(.+)><>Value",
      "kafka_server_$1_$2", {"clientId": "$3", "broker": "$4:$5"}, "GAUGE"),
    R(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.+), (.+)=(.+), (.+)=(.+), (.+)=(.+)><>(Count|Value)",
      "kafka_$1_$2_$3", {"$4": "$5", "$6": "$7", "$8": "$9", "$10": "$11"}),
    R(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.+), (.+)=(.+), (.+)=(.+)><>(Count|Value)",
      "kafka_$1_$2_$3", {"$4": "$5", "$6": "$7", "$8": "$9"}),
    R(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.+), (.+)=(.+)><>(Count|Value)",
      "kafka_$1_$2_$3", {"$4": "$5", "$6": "$7"}),
    R(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.+)><>(Count|Value)",
      "kafka_$1_$2_$3", {"$4": "$5"}),
    R(r"kafka.(\w+)<type=(.+), (.+)=(.+), (.+)=(.+)><>(Count|Value)",
      "kafka_$1_$2", {"$3": "$4", "$5": "$6"}),
    R(r"kafka.(\w+)<type=(.+), name=(.+)><>(Count|Value)", "kafka_$1_$2_$3"),
    R(r"kafka.(\w+)<type=(.+), (.+)=(.+)><>Value", "kafka_$1_$2", {"$3": "$4"}),
    R(r"kafka.coordinator.(\w+)<type=(.+), name=(.+)><>(Count|Value)", "kafka_coordinator_$1_$2_$3"),
    R(r"kafka.(\w+)<type=(.+), name=(.+), (.+)=(.*)><>(\d+)thPercentile",
      "kafka_$1_$2_$3", {"$4": "$5", "quantile": "0.$6"}, "GAUGE"),
    R(r"kafka.(\w+)<type=(.+), name=(.+)><>(\d+)thPercentile",
      "kafka_$1_$2_$3", {"quantile": "0.$4"}, "GAUGE"),
    R(r"kafka.server<type=BrokerTopicMetrics, name=(MessagesInPerSec|BytesInPerSec|BytesOutPerSec|TotalProduceRequestsPerSec|TotalFetchRequestsPerSec), topic=(.+)><>(Count|OneMinuteRate|FiveMinuteRate|FifteenMinuteRate)",
      "kafka_server_brokertopicmetrics_$1_$3", {"topic": "$2"}, "GAUGE"),
    R(r"kafka.server<type=BrokerTopicMetrics, name=(MessagesInPerSec|BytesInPerSec|BytesOutPerSec)><>(Count|OneMinuteRate|FiveMinuteRate|FifteenMinuteRate)",
      "kafka_server_brokertopicmetrics_$1_$2_alltopics", {}, "GAUGE"),
    R(r"kafka.network<type=RequestMetrics, name=RequestsPerSec, request=(.+), version=([0-9]+)><>(Count|OneMinuteRate|FiveMinuteRate|FifteenMinuteRate)",
      "kafka_network_requestmetrics_requestspersec_$3", {"request": "$1"}, "GAUGE"),
    R(r"kafka.server<type=raft-metrics><>(.+):(.*)", "kafka_server_raft_metrics_$1", {}, "GAUGE"),
    R(r"kafka.server<type=transaction-coordinator-metrics><>(.+):(.*)",
      "kafka_server_transaction_coordinator_metrics_$1", {}, "GAUGE"),
    R(r"confluent.(\w+)<type=(.+), (.+)=(.+), (.+)=(.+), (.+)=(.+)><>(Value|Count)",
      "confluent_$1_$2", {"$3": "$4", "$5": "$6", "$7": "$8"}, "GAUGE"),
    R(r"confluent.(.+)<type=(.+), (.+)=(.+), (.+)=(.+)><>Value",
      "confluent_$1_$2", {"$3": "$4", "$5": "$6"}, "GAUGE"),
    R(r"confluent.(.+)<type=(.+), (.+)=(.+)><>Value", "confluent_$1_$2", {"$3": "$4"}, "GAUGE"),
)

CONNECT_RULES = (
    R(r"kafka.connect<type=connect-worker-rebalance-metrics><>([a-zA-Z-]+)",
      "kafka_connect_connect_worker_rebalance_metrics_$1"),
    R(r"kafka.connect<type=connect-worker-metrics><>([a-zA-Z-]+)", "kafka_connect_connect_worker_metrics_$1"),
    R(r"kafka.connect<type=connect-worker-metrics, connector=(.+)><>([a-zA-Z-]+)",
      "kafka_connect_connect_worker_metrics_$2", {"connector": "$1"}),
    R(r"kafka.connect<type=connector-metrics, connector=(.+)><>([a-zA-Z-]+)",
      "kafka_connect_connector_metrics_$2", {"connector": "$1"}),
    R(r"kafka.connect<type=([a-zA-Z]+)-task-metrics, connector=(.+), task=([0-9]+)><>([a-zA-Z-]+)",
      "kafka_connect_$1_task_metrics_$4", {"connector": "$2", "task": "$3"}),
    R(r"kafka.connect<type=connector-task-metrics, connector=(.+), task=([0-9]+)><>([a-zA-Z-]+)",
      "kafka_connect_connector_task_metrics_$3", {"connector": "$1", "task": "$2"}),
    R(r"kafka.connect<type=task-error-metrics, connector=(.+), task=([0-9]+)><>([a-zA-Z-]+)",
      "kafka_connect_task_error_metrics_$3", {"connector": "$1", "task": "$2"}),
    R(r"kafka.connect<type=connect-coordinator-metrics, client-id=(.+)><>([a-zA-Z-]+)",
      "kafka_connect_connect_coordinator_metrics_$2", {"client_id": "$1"}),
    R(r"kafka.connect<type=connect-metrics, client-id=(.+)><>([a-zA-Z-]+)",
      "kafka_connect_connect_metrics_$2", {"client_id": "$1"}),
    R(r"kafka.connect<type=app-info, client-id=(.+)><>([a-zA-Z-]+): (.+)",
      "kafka_connect_app_info", {"client_id": "$1", "$2": "$3"}, None, "1"),
    R(r"kafka.connect<type=(.+), (.+)=(.+)><>([a-zA-Z-]+)", "kafka_connect_$1_$4", {"$2": "$3"}),
    R(r".*"),
)

_JVM_RULES = (
    R(r"java.lang<type=Memory><HeapMemoryUsage>(.+)", "jvm_memory_heap_$1", {}, "GAUGE"),
    R(r"java.lang<type=Memory><NonHeapMemoryUsage>(.+)", "jvm_memory_nonheap_$1", {}, "GAUGE"),
    R(r"java.lang<type=GarbageCollector, name=(.+)><>CollectionCount", "jvm_gc_collection_count",
      {"gc": "$1"}, "COUNTER"),
    R(r"java.lang<type=GarbageCollector, name=(.+)><>CollectionTime", "jvm_gc_collection_time_ms",
      {"gc": "$1"}, "COUNTER"),
    R(r"java.lang<type=Threading><>ThreadCount", "jvm_threads_current", {}, "GAUGE"),
)

KSQLDB_RULES = (
    R(r"io.confluent.ksql.metrics<type=(.+), (.+)=(.+), (.+)=(.+)><>(.+):",
      "io_confluent_ksql_metrics_$1_$6", {"$2": "$3", "$4": "$5"}),
    R(r"io.confluent.ksql.metrics<type=(.+), (.+)=(.+)><>(.+):", "io_confluent_ksql_metrics_$1_$4", {"$2": "$3"}),
    R(r"io.confluent.ksql.metrics<type=(.+)><>(.+):", "io_confluent_ksql_metrics_$1_$2"),
) + _JVM_RULES

KRAFT_RULES = (
    R(r"kafka.controller<type=KafkaController, name=(.+)><>Value", "kafka_controller_kafkacontroller_$1", {}, "GAUGE"),
    R(r"kafka.controller<type=ControllerStats, name=(.+)><>(Count|Value)",
      "kafka_controller_controllerstats_$1_$2", {}, "GAUGE"),
    R(r"kafka.controller<type=ControllerStats, name=(.+)><>(\d+)thPercentile",
      "kafka_controller_controllerstats_$1", {"quantile": "0.$2"}, "GAUGE"),
    R(r"kafka.controller<type=ControllerEventManager, name=(.+)><>(Count|Value)",
      "kafka_controller_controllereventmanager_$1_$2", {}, "GAUGE"),
    R(r"kafka.controller<type=ControllerEventManager, name=(.+)><>(\d+)thPercentile",
      "kafka_controller_controllereventmanager_$1", {"quantile": "0.$2"}, "GAUGE"),
    R(r"kafka.controller<type=(.+), name=(.+)><>(Count|Value)", "kafka_controller_$1_$2"),
    R(r"kafka.server<type=raft-metrics><>(.+):(.*)", "kafka_server_raft_metrics_$1", {}, "GAUGE"),
)

RESTPROXY_RULES = (
    R(r"kafka.rest<type=(.+), (.+)=(.+), (.+)=(.+)><>(.+):", "kafka_rest_$1_$6", {"$2": "$3", "$4": "$5"}),
    R(r"kafka.rest<type=(.+), (.+)=(.+)><>(.+):", "kafka_rest_$1_$4", {"$2": "$3"}),
    R(r"kafka.rest<type=(.+)><>(.+):", "kafka_rest_$1_$2"),
) + _JVM_RULES

SCHEMAREGISTRY_RULES = (
    R(r"kafka.schema.registry<type=(.+), (.+)=(.+)><>(.+):", "kafka_schema_registry_$1_$4", {"$2": "$3"}),
    R(r"kafka.schema.registry<type=(.+)><>(.+):", "kafka_schema_registry_$1_$2"),
) + _JVM_RULES

CONTROLCENTER_RULES = (R(r".*"),)

RULES_BY_COMPONENT = {
    "kafka": KAFKA_RULES, "connect": CONNECT_RULES, "ksqldb": KSQLDB_RULES,
    "kraftcontroller": KRAFT_RULES, "kafkarestproxy": RESTPROXY_RULES,
    "schemaregistry": SCHEMAREGISTRY_RULES, "controlcenter": CONTROLCENTER_RULES,
}

# Relabel steps of the scrape jobs.
BROKER_RELABEL = (
    Relabel("replace", ("__address__",), r"(.+)\.kafka\.confluent\.svc\.cluster\.local:.+", "instance", "${1}"),
    Relabel("replace", (), "(.*)", "env", "dev-eks"),
)
CONNECT_RELABEL = (
    Relabel("keep", ("__meta_kubernetes_pod_label_app",), "connect"),
    Relabel("keep", ("__meta_kubernetes_pod_container_port_name",), "prometheus"),
    Relabel("replace", ("__meta_kubernetes_pod_name",), "(.*)", "instance"),
    Relabel("replace", (), "(.*)", "env", "dev-eks"),
    Relabel("replace", (), "(.*)", "kafka_connect_cluster_id", "connect-cluster"),
)
SERVICEMONITOR_RELABEL = (
    Relabel("drop", ("__meta_kubernetes_service_name",), ".*-[0-9]+-internal"),
    Relabel("replace", ("__meta_kubernetes_pod_name",), "(.*)", "instance"),
    Relabel("replace", (), "(.*)", "job", "kafka-broker"),
    Relabel("replace", (), "(.*)", "env", "local-poc"),
    Relabel("replace", (), "(.*)", "namespace", "confluent"),
    Relabel("replace", (), "(.*)", "cluster", "docker-desktop"),
)
# Pod monitoring: select pods by app label, copy pod and namespace metadata,
# then the metric relabeling that sets a constant env.
POD_MONITORING_RELABEL = (
    Relabel("keep", ("__meta_kubernetes_pod_label_app",), "kafka"),
    Relabel("replace", ("__meta_kubernetes_pod_name",), "(.*)", "pod"),
    Relabel("replace", ("__meta_kubernetes_namespace",), "(.*)", "namespace"),
    Relabel("replace", (), "(.*)", "env", "dev-gke"),
)
# Standard pod-label mapping (the guide lists the action without a config).
LABELMAP_RELABEL = (Relabel("labelmap", (), "__meta_kubernetes_pod_label_(.+)"),)
