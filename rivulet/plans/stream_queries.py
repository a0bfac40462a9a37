"""Streaming queries, each checked against its batch equivalent.

Every callable stages its input as the files of a topic stand-in (once per
input, in the shared checkpoint folder), runs the streaming query to the end
of the available data (``availableNow``) in several micro-batches, and returns
a batch read of what the sink holds -- the state a pull query would see.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..operators import orders as op
from ..operators import timeseries as ts
from ..sources.orders import order_stream
from ..sources.samples import SampleSource
from ..sources.tables import listings
from ..sources.topic import PARTITIONS, order_records
from ..streaming import alert_state, panes, sources as src, storage, tables
from ..streaming.sinks import KeyedTable, OrdersSink, orders_table, read_dead_letters
from . import alert_queries as aq
from . import metric_queries as mq
from . import order_queries as oq
from .registry import register, round6, rounded
from ..plans.topic_queries import REC

CHUNKS = 4


ORDER_TABLES = ("events", "orders", "customer", "nation")


def _staged_orders(spark, sf, chunks=CHUNKS):
    return src.stage_topic(spark, "orders", (sf, listings(spark, sf, *ORDER_TABLES)), lambda: order_stream(spark, sf),
                           order_col="ordertime", chunks=chunks)


def _order_file_stream(spark, sf):
    path, files = _staged_orders(spark, sf)
    return src.file_stream(spark, path, S.ORDER, max_files_per_trigger=files)


def _appended(spark, stream, schema):
    """An append-mode derived stream, run to the end of its input, as a batch read."""
    out, ck = storage.fresh_path(spark, "tables"), storage.fresh_path(spark, "streams")
    tables.run_append(stream, out, ck).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def _maintained(spark, agg, schema, keys, bucket_by=None) -> KeyedTable:
    """A keyed table maintained by a streaming aggregate to the end of its input."""
    table = KeyedTable(spark, storage.fresh_path(spark, "tables"), schema, keys, buckets=8, bucket_by=bucket_by, fold_every=8)
    tables.run_keyed(agg, table, storage.fresh_path(spark, "streams")).awaitTermination()
    return table


@register("push_query", oracle=oq.FILTER_GT_SQL)
def q_push_query(spark, sf):
    """``SELECT ... WHERE orderunits > 5 EMIT CHANGES`` as an append stream."""
    return _appended(spark, op.large_orders(_order_file_stream(spark, sf), oq.MIN_UNITS),
                     "orderid string, itemid string, orderunits double, city string, state string")


@register("stream_flat", oracle=oq.FLAT_SQL)
def q_stream_flat(spark, sf):
    """The flattened stream as the continuous statement it is (append mode)."""
    return _appended(spark, op.flat_orders(_order_file_stream(spark, sf)),
                     "orderid string, ordertime bigint, order_datetime string, itemid string, orderunits double, "
                     "city string, state string, zipcode bigint")


def _state_table(spark, sf) -> KeyedTable:
    return _maintained(spark, tables.state_items(_order_file_stream(spark, sf)), tables.STATE_ITEMS, ["state", "itemid"], ["state"])


def _item_table(spark, sf) -> KeyedTable:
    return _maintained(spark, tables.orders_by_item_table(_order_file_stream(spark, sf)), tables.ITEMS, ["itemid"])


@register("stateful_agg", oracle=oq.ORDERS_BY_STATE_SQL)
def q_stateful_agg(spark, sf):
    """The per-state table maintained incrementally (update mode, state store)."""
    return rounded(tables.by_state(_state_table(spark, sf).read()), "total_units")


@register("stream_orders_by_item", oracle=oq.ORDERS_BY_ITEM_SQL)
def q_stream_orders_by_item(spark, sf):
    """The per-item table as the continuous statement it is."""
    return rounded(_item_table(spark, sf).read(), "total_units")


@register("pull_query", oracle=oq.PULL_STATE_SQL)
def q_pull_query(spark, sf):
    """One state's row of the maintained table: a lookup by the first key column, which reads its bucket alone."""
    return rounded(tables.by_state(_state_table(spark, sf).lookup(oq.STATE)), "total_units")


@register("pull_query_item", oracle=oq.PULL_ITEM_SQL)
def q_pull_query_item(spark, sf):
    """A point lookup: only the key's bucket of the maintained table is read."""
    return rounded(_item_table(spark, sf).lookup(oq.ITEM), "total_units")


@register("stream_tumbling_1m", oracle=oq.TUMBLING_SQL)
def q_stream_tumbling(spark, sf):
    """Tumbling-window table on event time with the default lateness."""
    s = src.with_event_time(_order_file_stream(spark, sf))
    return rounded(_maintained(spark, tables.tumbling_by_item(s), tables.TUMBLING, ["itemid", "window_start"]).read(), "total_units")


@register("stream_hopping_5m_1m", oracle=oq.HOPPING_SQL)
def q_stream_hopping(spark, sf):
    s = src.with_event_time(_order_file_stream(spark, sf))
    return rounded(_maintained(spark, tables.hopping_by_state(s), tables.HOPPING, ["state", "window_start"]).read(), "avg_units")


@register("src_topic_stream", oracle=f"""WITH {oq.ORDER_STREAM_SQL}
SELECT orderid, ordertime, itemid, orderunits, to_json(address) AS address FROM order_stream""")
def q_src_topic_stream(spark, sf):
    """The order stream read from its topic, which delivers every record twice (an hour apart).

    A record is known by (topic, partition, offset); the positions seen are kept for the lateness only.
    """
    def build():
        once = order_records(spark, sf).select("topic", "partition", "offset", "timestamp", "value")
        again = once.withColumn("arrival", F.col("timestamp") + F.lit(3_600_000))
        return once.withColumn("arrival", F.col("timestamp")).unionByName(again)
    path, files = src.stage_topic(spark, "orders-twice", (sf, listings(spark, sf, *ORDER_TABLES)), build, order_col="arrival",
                                  chunks=CHUNKS)
    records = src.file_stream(spark, path, "topic string, partition int, offset long, timestamp long, value string", files)
    orders = src.distinct_records(records, tables.DEFAULT_LATENESS).select(F.from_json("value", S.ORDER).alias("o")).select("o.*")
    out = _appended(spark, orders, S.ORDER)
    return out.withColumn("address", F.to_json("address"))


@register("stream_state_sketches", oracle=oq.ORDERS_BY_STATE_SQL)
def q_stream_state_sketches(spark, sf):
    """The per-state table from one sketch of its items per state and micro-batch, merged when read.

    (Up to a few hundred distinct items a sketch counts exactly; beyond, its relative error is about
    1.04 / sqrt(2^12) = 1.6 %.)
    """
    table = KeyedTable(spark, storage.fresh_path(spark, "tables"), tables.STATE_SKETCHES, ["state"], buckets=8)
    tables.run_batches(_order_file_stream(spark, sf), lambda b, i: table.upsert(tables.state_sketches(b), i),
                       storage.fresh_path(spark, "streams")).awaitTermination()
    return rounded(tables.merged_sketches(table.changes()), "total_units")


LATE_SQL = f"""{REC},
o AS (SELECT partition, timestamp AS ordertime, json_extract_string(value, '$.itemid') AS itemid,
             CAST(json_extract(value, '$.orderunits') AS DOUBLE) AS orderunits,
             timestamp - timestamp % 60000 AS window_start FROM records),
newest AS (SELECT partition, MAX(ordertime) AS m FROM o GROUP BY partition),
mark AS (SELECT a.partition, MAX(b.m) - 86400000 AS watermark
         FROM newest a LEFT JOIN newest b ON b.partition <= a.partition - 2 GROUP BY a.partition)
SELECT itemid, window_start, window_start + 60000 AS window_end, COUNT(*) AS order_count,
       ROUND(SUM(orderunits), 6) AS total_units
FROM o JOIN mark ON o.partition = mark.partition
WHERE mark.watermark IS NULL OR window_start + 60000 > mark.watermark
GROUP BY itemid, window_start"""


def late_table(spark, sf, rows_per_file=src.ROWS_PER_FILE):
    """The tumbling table fed one topic partition per micro-batch, in partition order.

    Which rows are kept: the watermark of a micro-batch is the newest event time of the
    batches before it minus 24 hours, and rows are compared with the watermark that the
    batch before had (the state of a window is given up one batch later than it is
    passed).  So a row of the n-th partition is late, and dropped, when its window ends at
    or before the newest event time of partitions 0 .. n-2 minus 24 hours.
    """
    path, files = src.stage_topic(spark, "orders-by-partition", (sf, listings(spark, sf, *ORDER_TABLES)),
                           lambda: order_records(spark, sf).select(
                               F.col("key").alias("orderid"), F.col("timestamp").alias("ordertime"),
                               F.get_json_object("value", "$.itemid").alias("itemid"),
                               F.get_json_object("value", "$.orderunits").cast("double").alias("orderunits"),
                               F.lit(None).cast(S.ADDRESS).alias("address"), "partition"),
                           order_col="partition", chunks=PARTITIONS, rows_per_file=rows_per_file)
    s = src.with_event_time(src.file_stream(spark, path, S.ORDER, max_files_per_trigger=files))
    table = KeyedTable(spark, storage.fresh_path(spark, "tables"), tables.TUMBLING, ["itemid", "window_start"], buckets=8)
    q = tables.run_keyed(tables.tumbling_by_item(s), table, storage.fresh_path(spark, "streams"))
    q.awaitTermination()
    fed = sum(p["numInputRows"] > 0 for p in q.recentProgress)
    if fed != PARTITIONS:
        raise RuntimeError(f"{PARTITIONS} partitions came in {fed} micro-batches")
    return table.read()


@register("late_data", oracle=LATE_SQL)
def q_late_data(spark, sf):
    return rounded(late_table(spark, sf), "total_units")


# ---------------------------------------------------------------- upsert sink

def _deliveries(records):
    """Every record twice (at-least-once delivery), and once more in a binary topic."""
    binary = F.regexp_replace(F.base64("value"), "[\\r\\n]", "")
    once = F.struct("topic", "value")
    copies = F.array(once, once, F.struct(F.lit("Orders-binary").alias("topic"), binary.alias("value")))
    return (records.select("partition", "offset", "timestamp", "key", F.explode(copies).alias("d"))
            .select("d.topic", "partition", "offset", "timestamp", "key", "d.value"))


def _sink_input(spark, sf):
    def build():
        return order_records(spark, sf).select("topic", "partition", "offset", "timestamp", "key", "value")
    return src.stage_topic(spark, "sink-input", (sf, listings(spark, sf, *ORDER_TABLES)), build, order_col="timestamp", chunks=3,
                           deliver=_deliveries)


def _run_sink(spark, sf, through=lambda table: table):
    path, files = _sink_input(spark, sf)
    schema = "topic string, partition int, offset long, timestamp long, key string, value string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path + "/data")
    table, dlq, ck = (storage.fresh_path(spark, "tables"), storage.fresh_path(spark, "dlq"),
                      storage.fresh_path(spark, "streams"))
    kept = orders_table(spark, table, fold_every=8)
    sink = OrdersSink(spark, table, dlq, retry_timeout_s=60.0, retry_max_delay_s=5.0, table=through(kept))
    with tables.state_partitions(spark):
        q = stream.writeStream.option("checkpointLocation", ck).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    return kept, dlq


SINK_SQL = f"""{REC}
SELECT CAST(key AS BIGINT) AS orderid, timestamp AS ordertime,
       json_extract_string(value, '$.itemid') AS itemid,
       CAST(json_extract(value, '$.orderunits') AS DOUBLE) AS orderunits,
       json_extract_string(value, '$.address.city') AS address_city,
       json_extract_string(value, '$.address.state') AS address_state,
       CAST(json_extract(value, '$.address.zipcode') AS BIGINT) AS address_zipcode
FROM records"""


@register("sink_upsert_pk", oracle=SINK_SQL)
def q_sink_upsert_pk(spark, sf):
    """Records decoded, validated, flattened and upserted by ``orderid``;
    duplicated deliveries collapse to one row per key."""
    table, _ = _run_sink(spark, sf)
    return table.read().select(
        "orderid", "ordertime", "itemid", "orderunits", "address_city", "address_state", "address_zipcode")


class _FailsOnce:
    """A table whose first write of every micro-batch gets lost half-way: files are left, then an I/O error is raised."""

    def __init__(self, table):
        self.table, self.tried = table, set()

    def upsert(self, batch, batch_id):
        if batch_id not in self.tried:
            self.tried.add(batch_id)
            self.table.upsert(batch.limit(1), batch_id)
            raise OSError("connection lost while writing")
        self.table.upsert(batch, batch_id)


@register("sink_retry", oracle=SINK_SQL)
def q_sink_retry(spark, sf):
    """The sink on a connection that drops in every micro-batch, under its retry bounds (60 s in total, at most 5 s
    between tries).  Every write of a micro-batch overwrites that batch's files, so what a lost try left is replaced."""
    table, _ = _run_sink(spark, sf, _FailsOnce)
    return table.read().select(
        "orderid", "ordertime", "itemid", "orderunits", "address_city", "address_state", "address_zipcode")


@register("sink_dlq", oracle=f"""{REC}
SELECT key, to_base64(encode(value)) AS value, 'Orders-binary' AS topic, partition, "offset",
       'jdbc-sink-orders' AS connector, 'VALUE_CONVERTER' AS stage,
       'value is not valid JSON' AS exception_message
FROM records""")
def q_sink_dlq(spark, sf):
    """Records the sink could not convert, with their context."""
    _, dlq = _run_sink(spark, sf)
    d = read_dead_letters(spark, dlq)
    return d.select("key", "value", "context.topic", "context.partition", "context.offset",
                    "context.connector", "context.stage", "context.exception_message")


# ---------------------------------------------------------------- streaming alert hold

ALERT_COLS = "alert, t, lkey, state, active_since, value"
RULE_NAMES = [r.alert for r in aq.RULES]
ACTIVE = "alert string, lkey string, t long, value double, for_ms long"


def _closed(rows, column, after_ms: int, **marks):
    """``rows`` and one closing row ``after_ms`` past the newest: it moves the watermark past all of them.

    (A live topic needs none: its next records do that.)  ``marks`` are columns of the closing row.
    """
    last = rows.agg(F.max(column).alias("_last")).where("_last is not null")
    cells = [(F.col("_last") + F.lit(after_ms)).alias(f.name) if f.name == column
             else F.lit(marks.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.unionByName(last.select(*cells))


def alert_life(spark, sf, names, p: aq.Params, rows_per_file=src.ROWS_PER_FILE):
    """Pending, firing and resolved states of rules, by a stateful stream over their active elements."""
    def build():
        rows = aq.active_elements(SampleSource(spark, sf), names, p).select("alert", "lkey", "t", "value", "for_ms")
        return _closed(rows, "t", 2 * p.step_ms, alert="", lkey="", value=0.0, for_ms=0)
    path, files = src.stage_topic(spark, "alert-steps", (sf, listings(spark, sf, "events"), *names, p), build, order_col="t",
                                  chunks=CHUNKS, rows_per_file=rows_per_file)
    active = src.file_stream(spark, path, ACTIVE, max_files_per_trigger=files)
    out, ck = storage.fresh_path(spark, "tables"), storage.fresh_path(spark, "streams")
    q = tables.run_append(alert_state.hold_stream(active, p.step_ms), out, ck)
    q.awaitTermination()
    if alert_state.dropped_rows(q):
        raise RuntimeError(f"{alert_state.dropped_rows(q)} active steps came too late")
    r = spark.read.schema(alert_state.OUTPUT_SCHEMA).parquet(out).where("alert <> ''")
    return r.select("alert", (F.col("t") / 1000).cast("bigint").alias("t"), "lkey", "state",
                    (F.col("active_since") / 1000).cast("bigint").alias("active_since"),
                    round6("value").alias("value"))


_HOLDS = f"SELECT {ALERT_COLS} FROM ({aq.evaluate_sql(RULE_NAMES, aq.DENSE)}) e"


@register("alert_for_stream", oracle=_HOLDS)
def q_alert_for_stream(spark, sf):
    """The rule set's ``for`` holds computed by a stateful stream over the
    active elements, delivered in time order."""
    return alert_life(spark, sf, RULE_NAMES, aq.DENSE).where(F.col("state") != F.lit(alert_state.RESOLVED))


@register("alert_lifecycle_stream", oracle=f"""WITH held AS ({_HOLDS})
SELECT * FROM held UNION ALL
SELECT alert, MAX(t) + {aq.DENSE.step_ms // 1000} AS t, lkey, 'resolved' AS state, active_since, NULL AS value
FROM held GROUP BY alert, lkey, active_since HAVING bool_or(state = 'firing')""")
def q_alert_lifecycle_stream(spark, sf):
    """The holds with their ends: a firing alert whose next step is missing is resolved there."""
    return alert_life(spark, sf, RULE_NAMES, aq.DENSE)


# ---------------------------------------------------------------- streaming vectors

SAMPLE = "metric string, series string, lkey string, ts long, sample_id long, value double"
HEARTBEAT = "-"            # no label set is written so


def _sample_stream(spark, sf, selectors, range_ms: int, step_ms: int):
    """Samples of selectors (metric, matchers) as a stream in time order, with a closing row."""
    source = SampleSource(spark, sf)

    def build():
        rows = None
        for metric, matchers in selectors:
            s = ts.select_series(source, metric, matchers).select(*[c.split()[0] for c in SAMPLE.split(", ")])
            rows = s if rows is None else rows.unionByName(s)
        return _closed(rows, "ts", range_ms + 2 * step_ms + 600_000, series=HEARTBEAT, lkey=HEARTBEAT, metric=HEARTBEAT)
    path, files = src.stage_topic(spark, "samples", (sf, listings(spark, sf, "events"), selectors, range_ms, step_ms),
                                  build, order_col="ts", chunks=CHUNKS)
    return src.file_stream(spark, path, SAMPLE, max_files_per_trigger=files)


def _vector(spark, stream):
    """What an append-mode vector stream has put out once its topic is read to the end."""
    out, ck = storage.fresh_path(spark, "tables"), storage.fresh_path(spark, "streams")
    q = tables.run_append(stream.select("t", "lkey", "value"), out, ck)
    q.awaitTermination()
    if alert_state.dropped_rows(q):
        raise RuntimeError(f"{alert_state.dropped_rows(q)} samples came too late")
    return mq.out(spark.read.schema("t long, lkey string, value double").parquet(out).where(F.col("lkey") != F.lit(HEARTBEAT)))


def _vector_query(spark, sf, metric, kind, range_ms, step_ms):
    s = _sample_stream(spark, sf, [(metric, ())], range_ms, step_ms)
    return _vector(spark, panes.vector_stream(s, kind, range_ms, step_ms))


@register("rate_5m_stream", oracle=mq.RATE_5M_SQL)
def q_rate_5m_stream(spark, sf):
    """``rate(counter[5m])`` every minute, continuously: panes of a minute, merged per series."""
    return _vector_query(spark, sf, mq.MSGS, "rate", mq.RANGE, mq.STEP)


@register("rate_dense_stream", oracle=mq.RATE_DENSE_SQL)
def q_rate_dense_stream(spark, sf):
    return _vector_query(spark, sf, mq.CPU, "rate", mq.DRANGE, mq.DSTEP)


@register("delta_5m_stream", oracle=mq.DELTA_5M_SQL)
def q_delta_5m_stream(spark, sf):
    """``delta(gauge[5m])`` every minute, continuously."""
    return _vector_query(spark, sf, mq.LAG, "delta", mq.RANGE, mq.STEP)


@register("delta_dense_stream", oracle=mq.DELTA_DENSE_SQL)
def q_delta_dense_stream(spark, sf):
    return _vector_query(spark, sf, mq.LAG, "delta", mq.DRANGE, mq.DSTEP)


@register("ratio_vector_stream", oracle=mq.RATIO_SQL)
def q_ratio_vector_stream(spark, sf):
    """Used over maximal heap, continuously: a stream-stream join of two instant vectors by step and label set."""
    selectors = [(m, (("area", "=", "heap"),)) for m in ("jvm_memory_bytes_used", "jvm_memory_bytes_max")]
    samples = _sample_stream(spark, sf, selectors, mq.LOOKBACK, mq.STEP)

    def side(metric):
        # the closing row goes on as a series of its own on both sides, so both watermarks move
        rows = samples.where(F.col("metric").isin(metric, HEARTBEAT))
        return panes.vector_stream(rows, "instant", mq.LOOKBACK, mq.STEP)
    return _vector(spark, panes.divided(side("jvm_memory_bytes_used"), side("jvm_memory_bytes_max"), ts.ieee_divide))


@register("stream_hopping_panes", oracle=oq.HOPPING_SQL)
def q_stream_hopping_panes(spark, sf):
    """The hopping table from one pane per (state, minute): appended once each window is closed."""
    day = 86_400_000
    path, files = src.stage_topic(
        spark, "orders-closed", (sf, listings(spark, sf, *ORDER_TABLES)),
        lambda: _closed(order_stream(spark, sf).withColumn("closing", F.lit(False)), "ordertime", day + 600_000, closing=True),
        order_col="ordertime", chunks=CHUNKS)
    orders = src.file_stream(spark, path, T.StructType([*S.ORDER.fields, T.StructField("closing", T.BooleanType())]), files)
    state = F.when(F.col("closing"), F.lit(HEARTBEAT)).otherwise(F.col("address.state"))
    named = src.with_event_time(orders).select("event_time", "orderunits", F.struct(state.alias("state")).alias("address"))
    out = _appended(spark, panes.hopping_by_state(named, 300_000, 60_000, tables.DEFAULT_LATENESS),
                    "state string, window_start bigint, window_end bigint, order_count bigint, avg_units double")
    return rounded(out.where(~F.col("state").eqNullSafe(HEARTBEAT)), "avg_units")
