"""Continuously maintained tables and push queries.

* A derived stream (projection / filter) runs in append mode into a file sink.
* A keyed table is a streaming aggregate in update mode whose changed rows are
  appended to a :class:`~rivulet.streaming.sinks.KeyedTable` each
  micro-batch; a pull query is a lookup in that table.
* Windowed tables aggregate on ``F.window`` over event time with a watermark
  (default 24 hours of lateness, configurable); rows later than the
  watermark are dropped by the state operator.

State lives in the RocksDB state store provider (set when a stream starts) under
the query's checkpoint location in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import orders as op
from ..session import BASE_CONF
from .sinks import KeyedTable

DEFAULT_LATENESS = "24 hours"


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_partitions(spark, n: int | None = None):
    """Start a stateful stream with ``n`` state partitions (default: the
    cluster's default parallelism, one wave of tasks), restoring the session's
    settings afterwards.  The count is fixed in the stream's
    checkpoint at its first start, so it is chosen for the state, not for the
    batch jobs sharing the session.

    State goes to RocksDB whatever session the stream is started from: Spark's default
    provider keeps all state on the heap and refuses operators with several states
    (``transformWithState``).  Another provider that the session names is left."""
    shuffle = "spark.sql.shuffle.partitions"
    old = {k: spark.conf.get(k, None) for k in (shuffle, STATE_STORE)}
    spark.conf.set(shuffle, str(n or spark.sparkContext.defaultParallelism))
    if old[STATE_STORE] is None or old[STATE_STORE].endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, BASE_CONF[STATE_STORE])
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_append(df: DataFrame, out_path: str, checkpoint: str, query_name: str | None = None,
               available_now: bool = True) -> StreamingQuery:
    """Push query into an append-only parquet sink (exactly-once through the
    sink's commit log)."""
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    with state_partitions(df.sparkSession):
        return w.start()


def run_keyed(df: DataFrame, table: KeyedTable, checkpoint: str, query_name: str | None = None,
              available_now: bool = True) -> StreamingQuery:
    """Maintain a keyed table from a streaming aggregate (update mode): the changed rows of
    every micro-batch become that batch's change files, the newest batch winning."""
    w = (df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda b, i: table.upsert(b, i)))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")
    with state_partitions(df.sparkSession):
        return w.start()


def run_batches(df: DataFrame, body, checkpoint: str) -> StreamingQuery:
    """``body(batch, batch id)`` for every micro-batch of a stateless stream, to the end of its input."""
    return (df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(body)
            .trigger(availableNow=True).start())


STATE_SKETCHES = "state string, order_count bigint, total_units double, items binary"
SKETCH_BITS = 12


def state_sketches(batch: DataFrame) -> DataFrame:
    """Counts, unit totals and a sketch of the distinct items per state of one micro-batch."""
    return batch.groupBy(F.col("address.state").alias("state")).agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("orderunits").alias("total_units"),
        F.hll_sketch_agg("itemid", F.lit(SKETCH_BITS)).alias("items"))


def merged_sketches(rows: DataFrame) -> DataFrame:
    """The per-state table from the rows of all micro-batches: sketches merge without their items."""
    return rows.groupBy("state").agg(
        F.sum("order_count").alias("order_count"), F.sum("total_units").alias("total_units"),
        F.hll_sketch_estimate(F.hll_union_agg("items")).alias("unique_items"))


STATE_ITEMS = "state string, itemid string, order_count bigint, total_units double"
ITEMS = "itemid string, order_count bigint, total_units double"


def state_items(stream: DataFrame) -> DataFrame:
    """Counts and unit totals per (state, item): the state kept for the per-state table.

    One small row per pair that occurs, so the state of a hot ``state`` is spread over as
    many rows as it has items, instead of one growing set in one row.
    """
    return (stream.groupBy(F.col("address.state").alias("state"), "itemid")
            .agg(F.count(F.lit(1)).alias("order_count"), F.sum("orderunits").alias("total_units")))


def by_state(pairs: DataFrame) -> DataFrame:
    """The per-state table from the maintained (state, item) rows."""
    return pairs.groupBy("state").agg(F.sum("order_count").alias("order_count"), F.sum("total_units").alias("total_units"),
                                      F.count("itemid").alias("unique_items"))


def orders_by_item_table(stream: DataFrame) -> DataFrame:
    return op.orders_by_item(stream)


def windowed(stream: DataFrame, keys: Sequence[str], size: str, slide: str | None = None,
             lateness: str = DEFAULT_LATENESS, aggs: Sequence = ()) -> DataFrame:
    """Windowed table on event time: ``window_start``/``window_end`` in ms."""
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    g = stream.withWatermark("event_time", lateness).groupBy(w.alias("w"), *keys)
    r = g.agg(*aggs)
    rest = [c for c in r.columns if c not in ("w", *keys)]
    return r.select(*keys, F.unix_millis("w.start").alias("window_start"),
                    F.unix_millis("w.end").alias("window_end"), *rest)


TUMBLING = "itemid string, window_start bigint, window_end bigint, order_count bigint, total_units double"
HOPPING = "state string, window_start bigint, window_end bigint, order_count bigint, avg_units double"


def tumbling_by_item(stream: DataFrame, lateness: str = DEFAULT_LATENESS) -> DataFrame:
    return windowed(stream, ["itemid"], "1 minute", lateness=lateness,
                    aggs=[F.count(F.lit(1)).alias("order_count"), F.sum("orderunits").alias("total_units")])


def hopping_by_state(stream: DataFrame, lateness: str = DEFAULT_LATENESS) -> DataFrame:
    s = stream.withColumn("state", F.col("address.state"))
    return windowed(s, ["state"], "5 minutes", "1 minute", lateness=lateness,
                    aggs=[F.count(F.lit(1)).alias("order_count"), F.avg("orderunits").alias("avg_units")])
