"""Topic records (the log a console consumer reads) derived from the orders.

Every order becomes one record of topic ``Orders``:

* ``key``       = ``orderid`` (string key converter)
* ``value``     = the order as JSON (``ordertime, orderid, itemid, orderunits,
  address``), the record value a JSON consumer sees
* ``partition`` = a hash of the key modulo the partition count (first 32 bits
  of its MD5, a partitioner both engines in the tests can compute)
* ``timestamp`` = ``ordertime`` (CreateTime, epoch ms)
* ``offset``    = position of the record in its partition, ordered by
  ``(timestamp, orderid)``, dense from 0

Offsets are a running count per partition.  A partition holds a large share
of a topic, so the count is computed with the bucketed running-sum
primitive: per (partition, hour) row numbers plus the totals of earlier hours,
never a single-task window over a whole partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequence import running_sum
from .orders import COLUMNS, addresses, order_stream

TOPIC = "Orders"
PARTITIONS = 6
# Bucket width of the offset running count (a minute of one partition per task).
SEQ_BUCKET_MS = 60_000


def key_partition(key: Column, partitions: int = PARTITIONS) -> Column:
    """Partition of a record key: first 32 bits of MD5(key) mod ``partitions``."""
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(partitions)).cast("int")


def order_value(orders: DataFrame) -> Column:
    return F.to_json(F.struct(
        "ordertime", F.col("orderid").cast("bigint").alias("orderid"), "itemid", "orderunits", "address"))


def order_records(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS,
                  topic: str = TOPIC, bucket_ms: int = SEQ_BUCKET_MS, value: bool = True) -> DataFrame:
    """``topic, partition, offset, timestamp, timestamp_type, key, value, headers``.

    With ``value=False`` the last two columns are left out, and with them the address
    joins that only the value needs: positions are a matter of ``events`` alone.
    """
    o = order_stream(spark, sf_dir, COLUMNS if value else ("orderid", "ordertime"))
    rec = o.select(
        F.lit(topic).alias("topic"),
        key_partition(F.col("orderid"), partitions).alias("partition"),
        F.col("ordertime").alias("timestamp"),
        F.col("orderid").alias("key"),
        F.col("orderid").cast("bigint").alias("_seq"),
        F.lit(1).alias("_one"),
        *([order_value(o).alias("value"), F.create_map(F.lit("itemid"), F.col("itemid")).alias("headers")] if value else []))
    rec = running_sum(rec, ["topic", "partition"], "timestamp", "_seq", "_one", "_pos", bucket_ms)
    return rec.select("topic", "partition", (F.col("_pos") - 1).alias("offset"), "timestamp",
                      F.lit("CreateTime").alias("timestamp_type"), "key", *(["value", "headers"] if value else []))


def first_order_records(spark: SparkSession, sf_dir: str, n: int, partitions: int = PARTITIONS, topic: str = TOPIC) -> DataFrame:
    """The first ``n`` records by (timestamp, partition, offset), without numbering the others.

    Offsets follow (timestamp, orderid) within a partition, so whatever precedes a record in its
    partition precedes it here as well: the chosen rows can be numbered among themselves.  ``events`` is read for a
    top-k of ``n`` rows per task; the address tables are joined to the chosen rows alone.
    """
    o = order_stream(spark, sf_dir, ("orderid", "ordertime", "itemid", "orderunits"))
    seq = F.col("orderid").cast("bigint")
    chosen = (o.select("*", key_partition(F.col("orderid"), partitions).alias("partition"), seq.alias("_seq"))
              .orderBy("ordertime", "partition", "_seq").limit(n))
    chosen = chosen.withColumn("offset", F.row_number().over(
        Window.partitionBy("partition").orderBy("ordertime", "_seq")).cast("bigint") - 1)
    address = addresses(spark, sf_dir, orders=chosen.select("_seq"))
    rec = chosen.join(F.broadcast(address), chosen["_seq"] == address.o_orderkey, "left")      # n rows
    return rec.select(F.lit(topic).alias("topic"), "partition", "offset", F.col("ordertime").alias("timestamp"),
                      F.col("orderid").alias("key"), order_value(rec).alias("value"))


# Commit behaviour of the consumer groups: (group, records between commits, time from a record to its commit).
COMMITS = (("jdbc-sink-orders", 5, 3_600_000), ("orders-analytics", 20, 93_600_000))
REWIND_EVERY = 10


def commit_history(records: DataFrame, groups=COMMITS, rewind_every: int = REWIND_EVERY) -> DataFrame:
    """``group, topic, partition, committed_at, commit_id, position`` of groups that follow the topic.

    A group commits behind every n-th record of a partition, a fixed time after it.  Every ``rewind_every``-th
    commit is taken back at the same instant by one commit interval (a failed batch that is read again).
    """
    n, g = F.col("offset") + 1, F.col("g")
    every = records.select("topic", "partition", "timestamp", n.alias("n"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("group"), F.lit(k).cast("bigint").alias("every"), F.lit(delay).cast("bigint").alias("delay"))
        for name, k, delay in groups])).alias("g")).where(F.col("n") % g["every"] == 0)
    made = F.struct((F.col("n") * 2).alias("commit_id"), F.col("n").alias("position"))
    undone = F.struct((F.col("n") * 2 + 1).alias("commit_id"), (F.col("n") - g["every"]).alias("position"))
    both = F.when(F.col("n") % (g["every"] * rewind_every) == 0, F.array(made, undone)).otherwise(F.array(made))
    return (every.select(g["group"].alias("group"), "topic", "partition", (F.col("timestamp") + g["delay"]).alias("committed_at"),
                         F.explode(both).alias("c"))
            .select("group", "topic", "partition", "committed_at", "c.commit_id", "c.position"))


def records_sql(orders_cte_sql: str, partitions: int = PARTITIONS, topic: str = TOPIC) -> str:
    """DuckDB form of :func:`order_records` over an ``order_stream`` CTE."""
    return f"""WITH {orders_cte_sql},
rec AS (
  SELECT '{topic}' AS topic,
         CAST(CAST(('0x' || substr(md5(orderid), 1, 8)) AS BIGINT) % {partitions} AS INTEGER) AS partition,
         ordertime AS timestamp, orderid AS key,
         to_json({{'ordertime': ordertime, 'orderid': CAST(orderid AS BIGINT), 'itemid': itemid,
                   'orderunits': orderunits, 'address': address}}) AS value,
         CAST(orderid AS BIGINT) AS seq
  FROM order_stream),
records AS (
  SELECT topic, partition,
         ROW_NUMBER() OVER (PARTITION BY topic, partition ORDER BY timestamp, seq) - 1 AS "offset",
         timestamp, 'CreateTime' AS timestamp_type, key, value
  FROM rec)"""
