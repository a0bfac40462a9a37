"""Topic read, replay, offset, lag, sizing and mirroring queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import topics as tp
from ..sources.log import TopicLog, stored_log
from ..sources.tables import listings
from ..sources.topic import COMMITS, REWIND_EVERY, commit_history, first_order_records, order_records, records_sql
from .order_queries import ORDER_STREAM_SQL
from .registry import register, round6

REC = records_sql(ORDER_STREAM_SQL)
OFF = '"offset"'   # reserved word in the oracle dialect
BASE_COLS = f"topic, partition, {OFF}, timestamp, key, value"

# Parameters of the sample procedures (points in the generated month).
REPLAY_FROM_MS = 1705276800000        # 2024-01-15T00:00:00Z
RESET_TO_MS = 1705708800000           # 2024-01-20T00:00:00Z
GROUPS = (("jdbc-sink-orders", 1705968000000),    # consumed up to 2024-01-23
          ("orders-analytics", 1705104000000))    # consumed up to 2024-01-13
RETENTION_DAYS, REPLICATION, BROKERS = 7, 3, 3    # sizing example parameters


def R(spark, sf):
    return order_records(spark, sf)


def P(spark, sf):
    """Records without their values: all that offsets and positions depend on."""
    return order_records(spark, sf, value=False)


def L(spark, sf) -> TopicLog:
    """The stored log of the topic, written by the first query that reads positions."""
    return stored_log(spark, "orders", (sf, listings(spark, sf, "events", "orders", "customer", "nation")), lambda: R(spark, sf))


@register("read_from_beginning", oracle=f"{REC} SELECT {BASE_COLS} FROM records")
def q_read_from_beginning(spark, sf):
    return tp.from_beginning(R(spark, sf))


@register("read_partition_offset", oracle=f"{REC} SELECT {BASE_COLS} FROM records WHERE partition = 0 AND {OFF} >= 100")
def q_read_partition_offset(spark, sf):
    return tp.from_beginning(L(spark, sf).from_partition_offset("Orders", 0, 100))


@register("read_from_timestamp", oracle=f"{REC} SELECT {BASE_COLS} FROM records WHERE timestamp >= {REPLAY_FROM_MS}")
def q_read_from_timestamp(spark, sf):
    return tp.from_beginning(L(spark, sf).from_timestamp(REPLAY_FROM_MS))


@register("read_limit_n", oracle=f"{REC} SELECT {BASE_COLS} FROM records ORDER BY timestamp, partition, {OFF} LIMIT 10")
def q_read_limit_n(spark, sf):
    return first_order_records(spark, sf, 10)


@register("read_key_ts", oracle=f"""{REC} SELECT partition, {OFF},
  timestamp_type || ':' || CAST(timestamp AS VARCHAR) || ' | ' || COALESCE(key, 'null') || ' | ' || COALESCE(value, 'null') AS line
FROM records""")
def q_read_key_ts(spark, sf):
    return tp.console_lines(R(spark, sf), " | ")


VALUE_SCHEMA = T.StructType([
    T.StructField("ordertime", T.LongType()), T.StructField("orderid", T.LongType()),
    T.StructField("itemid", T.StringType()), T.StructField("orderunits", T.DoubleType()),
    T.StructField("address", S.ADDRESS)])


@register("decode_json", oracle=f"""{REC},
parsed AS (SELECT partition, {OFF}, key, json_transform(value,
  '{{"ordertime":"BIGINT","orderid":"BIGINT","itemid":"VARCHAR","orderunits":"DOUBLE",
    "address":{{"city":"VARCHAR","state":"VARCHAR","zipcode":"BIGINT"}}}}') AS v FROM records)
SELECT partition, {OFF}, key, v.ordertime AS ordertime, v.orderid AS orderid, v.itemid AS itemid,
       v.orderunits AS orderunits, v.address.city AS address_city, v.address.state AS address_state,
       v.address.zipcode AS address_zipcode, CAST(NULL AS VARCHAR) AS _corrupt_record
FROM parsed""")
def q_decode_json(spark, sf):
    d = tp.decode_json(R(spark, sf), VALUE_SCHEMA)
    return d.select("partition", "offset", "key", "ordertime", "orderid", "itemid", "orderunits",
                    F.col("address.city").alias("address_city"), F.col("address.state").alias("address_state"),
                    F.col("address.zipcode").alias("address_zipcode"), "_corrupt_record")


@register("decode_base64", oracle=f"""{REC} SELECT partition, {OFF}, key, value,
  CAST(json_extract(value, '$.orderunits') AS DOUBLE) AS orderunits
FROM (SELECT partition, {OFF}, key, decode(from_base64(to_base64(encode(value)))) AS value FROM records)""")
def q_decode_base64(spark, sf):
    """Values in the binary embedded format (base64 text) decoded back to
    JSON, then a field read from the decoded document."""
    r = R(spark, sf).select("partition", "offset", "key",
                            F.regexp_replace(F.base64(F.col("value")), "[\\r\\n]", "").alias("value"))
    d = tp.decode_base64(r)
    return d.withColumn("orderunits", F.get_json_object("value", "$.orderunits").cast("double"))


@register("parse_key_headers", oracle=f"""{REC},
lines AS (SELECT 'itemid:' || json_extract_string(value, '$.itemid') || ',partition:' || CAST(partition AS VARCHAR)
                 || chr(9) || key || ':' || value AS line FROM records),
split AS (SELECT split_part(line, chr(9), 1) AS h,
                 substr(line, strlen(split_part(line, chr(9), 1)) + 2) AS rest FROM lines)
SELECT split_part(rest, ':', 1) AS key,
       substr(rest, strlen(split_part(rest, ':', 1)) + 2) AS value,
       split_part(split_part(h, ',', 1), ':', 2) AS header_itemid,
       split_part(split_part(h, ',', 2), ':', 2) AS header_partition
FROM split""")
def q_parse_key_headers(spark, sf):
    """Producer input lines with headers (``h:v,h:v<TAB>key:value``) parsed
    back into key, value and header map."""
    r = R(spark, sf)
    lines = r.select(F.concat(F.lit("itemid:"), F.get_json_object("value", "$.itemid"),
                              F.lit(",partition:"), F.col("partition").cast("string"),
                              F.lit("\t"), F.col("key"), F.lit(":"), F.col("value")).alias("line"))
    p = tp.parse_producer_lines(lines)
    return p.select("key", "value",
                    tp.header("headers", "itemid").alias("header_itemid"),
                    tp.header("headers", "partition").alias("header_partition"))


@register("offsets_latest", oracle=f"{REC} SELECT topic, partition, MAX({OFF}) + 1 AS log_end_offset FROM records GROUP BY topic, partition")
def q_offsets_latest(spark, sf):
    return tp.end_offsets(P(spark, sf))


@register("offsets_earliest", oracle=f"{REC} SELECT topic, partition, MIN({OFF}) AS log_start_offset FROM records GROUP BY topic, partition")
def q_offsets_earliest(spark, sf):
    return tp.start_offsets(P(spark, sf))


@register("topic_message_count", oracle=f"""{REC} SELECT topic, CAST(SUM(e) AS BIGINT) AS messages
FROM (SELECT topic, partition, MAX({OFF}) + 1 AS e FROM records GROUP BY topic, partition) GROUP BY topic""")
def q_topic_message_count(spark, sf):
    return tp.message_count(P(spark, sf))


def _committed_sql() -> str:
    parts = [f"""SELECT '{g}' AS "group", topic, partition,
      CAST(SUM(CASE WHEN timestamp < {t} THEN 1 ELSE 0 END) AS BIGINT) AS current_offset
    FROM records GROUP BY topic, partition""" for g, t in GROUPS]
    return " UNION ALL ".join(parts)


LAG_SQL = f"""{REC},
committed AS ({_committed_sql()}),
ends AS (SELECT topic, partition, MAX({OFF}) + 1 AS log_end_offset FROM records GROUP BY topic, partition),
lag AS (SELECT c."group", c.topic, c.partition, c.current_offset, e.log_end_offset,
               e.log_end_offset - c.current_offset AS lag
        FROM committed c JOIN ends e ON c.topic = e.topic AND c.partition = e.partition)"""


def _positions(spark, sf):
    return tp.positions(P(spark, sf), GROUPS, RESET_TO_MS)


@register("consumer_lag", oracle=f'{LAG_SQL} SELECT * FROM lag')
def q_consumer_lag(spark, sf):
    return tp.consumer_lag(_positions(spark, sf))


@register("lag_by_topic", oracle=f'{LAG_SQL} SELECT "group", topic, CAST(SUM(lag) AS BIGINT) AS lag FROM lag GROUP BY "group", topic')
def q_lag_by_topic(spark, sf):
    return tp.lag_by_topic(tp.consumer_lag(_positions(spark, sf)))


LAG_STEP_MS = 600_000
_STEP = "CAST(ceil({0} / {1}) AS BIGINT) * {1}"


def _lag_over_time_sql(final: str) -> str:
    groups = ", ".join(f"('{g}', {k}, {delay})" for g, k, delay in COMMITS)
    seen, made = _STEP.format("timestamp", LAG_STEP_MS), _STEP.format("committed_at", LAG_STEP_MS)
    return f"""{REC},
taken AS (SELECT g."group", r.topic, r.partition, r.timestamp + g.delay AS committed_at, r."offset" + 1 AS n, g.every
          FROM records r, (VALUES {groups}) g("group", every, delay) WHERE (r."offset" + 1) % g.every = 0),
history AS (SELECT "group", topic, partition, committed_at, 2 * n AS commit_id, n AS position FROM taken
            UNION ALL SELECT "group", topic, partition, committed_at, 2 * n + 1, n - every FROM taken WHERE n % ({REWIND_EVERY} * every) = 0),
commits AS (SELECT "group", topic, partition, committed_at, arg_max(position, commit_id) AS position FROM history GROUP BY ALL),
ends AS (SELECT topic, partition, timestamp, MAX("offset") + 1 AS log_end FROM records GROUP BY ALL),
until AS (SELECT topic, MAX(t) AS hi FROM (SELECT topic, {seen} AS t FROM records UNION ALL SELECT topic, {made} FROM history) GROUP BY topic),
firsts AS (SELECT "group", topic, partition, MIN({made}) AS lo FROM history GROUP BY ALL),
steps AS (SELECT f."group", f.topic, f.partition, unnest(range(f.lo, u.hi + 1, {LAG_STEP_MS})) AS t
          FROM firsts f JOIN until u ON f.topic = u.topic),
lag AS (SELECT s."group", s.topic, s.partition, s.t // 1000 AS t, c.position AS current_offset, e.log_end AS log_end_offset,
               e.log_end - c.position AS lag
        FROM steps s
        ASOF JOIN commits c ON s."group" = c."group" AND s.topic = c.topic AND s.partition = c.partition AND s.t >= c.committed_at
        ASOF JOIN ends e ON s.topic = e.topic AND s.partition = e.partition AND s.t >= e.timestamp)
{final}"""


def _lag_over_time(spark, sf):
    records = L(spark, sf).records.select("topic", "partition", "offset", "timestamp")
    return tp.lag_over_time(records, commit_history(records), LAG_STEP_MS).withColumn("t", F.floor(F.col("t") / 1000).cast("bigint"))


@register("consumer_lag_over_time", oracle=_lag_over_time_sql("SELECT * FROM lag"))
def q_consumer_lag_over_time(spark, sf):
    """Lag of every group and partition at every step, from the history of commits."""
    return _lag_over_time(spark, sf)


@register("lag_by_topic_over_time", oracle=_lag_over_time_sql(
    'SELECT "group", topic, t, CAST(SUM(lag) AS BIGINT) AS lag FROM lag GROUP BY "group", topic, t'))
def q_lag_by_topic_over_time(spark, sf):
    return _lag_over_time(spark, sf).groupBy("group", "topic", "t").agg(F.sum("lag").alias("lag"))


@register("offset_reset", oracle=f"""{LAG_SQL},
b AS (SELECT topic, partition, MIN({OFF}) AS lo, MAX({OFF}) + 1 AS hi,
             MIN(CASE WHEN timestamp >= {RESET_TO_MS} THEN {OFF} END) AS first_at
      FROM records GROUP BY topic, partition)
SELECT c."group", c.topic, c.partition, s.strategy, c.current_offset,
  CAST(CASE s.strategy WHEN 'to-earliest' THEN b.lo
                       WHEN 'to-offset' THEN least(greatest(1000, b.lo), b.hi)
                       ELSE COALESCE(b.first_at, b.hi) END AS BIGINT) AS new_offset
FROM committed c JOIN b ON c.topic = b.topic AND c.partition = b.partition,
     (VALUES ('to-earliest'), ('to-offset'), ('to-datetime')) s(strategy)""")
def q_offset_reset(spark, sf):
    """Dry run of the three reset procedures for every group and partition."""
    return tp.reset_plan(_positions(spark, sf), [("to-earliest", None), ("to-offset", 1000), ("to-datetime", None)])


@register("offset_reset_execute", oracle=f"""{LAG_SQL},
b AS (SELECT topic, partition, MAX({OFF}) + 1 AS hi,
             MIN(CASE WHEN timestamp >= {RESET_TO_MS} THEN {OFF} END) AS first_at
      FROM records GROUP BY topic, partition)
SELECT c."group", r.topic, r.partition, r."offset", r.timestamp, r.key, r.value
FROM committed c JOIN b ON c.topic = b.topic AND c.partition = b.partition
JOIN records r ON r.topic = b.topic AND r.partition = b.partition AND r."offset" >= COALESCE(b.first_at, b.hi)
WHERE c."group" = '{GROUPS[0][0]}'""")
def q_offset_reset_execute(spark, sf):
    """The executed reset to a datetime: what one group reads from its new positions."""
    plan = tp.reset_plan(_positions(spark, sf), [("to-datetime", None)]).where(F.col("group") == GROUPS[0][0])
    return tp.from_positions(tp.from_beginning(R(spark, sf)), plan).select(
        "group", "topic", "partition", "offset", "timestamp", "key", "value")


@register("storage_sizing", oracle=f"""{REC},
daily AS (SELECT topic, timestamp // 86400000 AS day, SUM(COALESCE(strlen(key), 0) + COALESCE(strlen(value), 0)) AS bytes
          FROM records GROUP BY topic, timestamp // 86400000),
per AS (SELECT topic, COUNT(*) AS days, AVG(bytes) AS daily_bytes FROM daily GROUP BY topic)
SELECT topic, days, ROUND(daily_bytes, 6) AS daily_bytes,
       ROUND(daily_bytes * {RETENTION_DAYS} * {REPLICATION} * 1.2, 6) AS required_bytes,
       ROUND(daily_bytes * {RETENTION_DAYS} * {REPLICATION} * 1.2 / {BROKERS}, 6) AS per_broker_bytes
FROM per""")
def q_storage_sizing(spark, sf):
    s = tp.storage_required(R(spark, sf), RETENTION_DAYS, REPLICATION, BROKERS)
    return s.select("topic", "days", *[round6(c).alias(c) for c in
                                       ("daily_bytes", "required_bytes", "per_broker_bytes")])


@register("mirror_topics", oracle=f"{REC} SELECT 'source.' || topic AS topic, partition, {OFF}, timestamp, key, value FROM records WHERE regexp_full_match(topic, '.*')")
def q_mirror_topics(spark, sf):
    return tp.mirror(tp.from_beginning(R(spark, sf)), ".*", "source.")
