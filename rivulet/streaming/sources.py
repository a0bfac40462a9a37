"""Stream sources: topics as file streams, the message-bus source, and the
order generator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import instant_from_millis
from . import storage


ROWS_PER_FILE = 250_000     # a file is read by one task, up to the next shuffle
STAGE_FORMAT = "6"          # part of the staging key: bump when the layout or the rows staged change


def stage_topic(spark: SparkSession, name: str, key: tuple, build: Callable[[], DataFrame],
                order_col: str | None = None, chunks: int = 1,
                rows_per_file: int = ROWS_PER_FILE,
                deliver: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, int]:
    """Write a batch DataFrame once as the files of a topic stand-in.

    Returns ``(path, files_per_chunk)``.  With ``order_col`` the rows are cut into
    ``chunks`` consecutive ranges of that column, written one range after the other.  Each
    range is dealt by a hash of the whole row into at most ``F`` files, so a range with one
    value (a hot topic partition) is still written by ``F`` tasks.  ``F`` follows the largest
    range.  A range with fewer files (few rows, or none) is filled up with empty ones, so
    every range has exactly ``F`` and a file stream reading ``F`` files per trigger delivers
    exactly one range per micro-batch, whatever the sizes; the files are counted after every range.

    With ``deliver`` the topic holds the rows that it makes of the built ones (copies, say): only the built ones are
    kept while the ranges are written.

    The folder is keyed by ``key``, which must name the state of the inputs (see
    ``tables.listings``); a complete folder is reused.
    """
    path = storage.keyed_path(spark, "topics", STAGE_FORMAT, name, *map(str, key), str(chunks), str(rows_per_file))
    marker = path + "/_COMPLETE"
    if storage.exists(spark, marker):
        files = spark.read.parquet(marker).first()["files"]
        return path, files
    storage.delete(spark, path)
    deliver = deliver or (lambda rows: rows)
    if order_col is None or chunks <= 1:
        deliver(build()).write.parquet(path + "/data")
        files = 0
    else:
        # computed once (bounds, sizes and every range read the same rows);
        # spills to disk when it does not fit, and is recomputed if lost
        built = build().persist(StorageLevel.MEMORY_AND_DISK)
        df = deliver(built)
        try:
            b = df.select(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
            lo, width = b["lo"] or 0, -(-((b["hi"] or 0) + 1 - (b["lo"] or 0)) // chunks)
            cid = F.floor((F.col(order_col) - F.lit(lo)) / F.lit(width)).cast("int")
            sizes = [r["n"] for r in df.groupBy(cid.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()]   # <= chunks rows
            files = max(1, -(-max(sizes, default=0) // rows_per_file))
            empty = spark.createDataFrame([], df.schema).coalesce(1)
            # the bits of the hash above those that repartition() itself would use
            spread = F.pmod(F.shiftright(F.xxhash64(*[F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), 17),
                            F.lit(1 << 20))
            for i in range(chunks):      # a bounded number of sequential writes, in order
                part = df.where((F.col(order_col) >= lo + i * width) & (F.col(order_col) < lo + (i + 1) * width))
                # a task writes one file; a session that deals rows to more partitions still gets F tasks
                part.repartition(files, spread).coalesce(files).write.mode("append").parquet(path + "/data")
                for _ in range((i + 1) * files - storage.count_files(spark, path + "/data", ".parquet")):
                    empty.write.mode("append").parquet(path + "/data")
                found = storage.count_files(spark, path + "/data", ".parquet")
                if found != (i + 1) * files:
                    raise RuntimeError(f"ranges 0 .. {i} of {name} have {found} files instead of {(i + 1) * files}")
        finally:
            built.unpersist()
    spark.createDataFrame([(files,)], "files int").write.mode("overwrite").parquet(marker)
    return path, files


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path + "/data")


def with_event_time(orders: DataFrame) -> DataFrame:
    """Add the ``event_time`` instant used by windows and watermarks."""
    return orders.withColumn("event_time", instant_from_millis("ordertime"))


def distinct_records(records: DataFrame, lateness: str) -> DataFrame:
    """Records of an at-least-once delivery, each position once.

    A position is kept for ``lateness`` after its event time; a copy that comes later than that is late itself.
    """
    timed = records.withColumn("event_time", instant_from_millis("timestamp")).withWatermark("event_time", lateness)
    return timed.dropDuplicatesWithinWatermark(["topic", "partition", "offset"])


def bus_stream(spark: SparkSession, bootstrap: str, topics: str | None = None,
               pattern: str | None = None, starting: str = "earliest",
               starting_timestamp: int | None = None) -> DataFrame:
    """Records from the message bus (``key, value, topic, partition, offset,
    timestamp, headers``).  Needs the Kafka connector on the classpath.

    ``starting`` takes ``earliest``/``latest`` or a per-partition offsets
    JSON; ``starting_timestamp`` replays from a point in time.
    """
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
    r = r.option("subscribePattern", pattern) if pattern else r.option("subscribe", topics)
    if starting_timestamp is not None:
        r = r.option("startingTimestamp", str(starting_timestamp))
    else:
        r = r.option("startingOffsets", starting)
    return r.option("includeHeaders", "true").load().select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "topic", "partition", "offset", "timestamp", "headers")


def decode_avro(col, schema_json: str):
    """``from_avro`` on a value column (needs the Avro connector jar)."""
    from pyspark.sql.avro.functions import from_avro
    return from_avro(col, schema_json)


def decode_protobuf(col, message_name: str, desc_file: str):
    """``from_protobuf`` on a value column (needs the Protobuf connector jar)."""
    from pyspark.sql.protobuf.functions import from_protobuf
    return from_protobuf(col, message_name, desc_file)


# ---------------------------------------------------------------- generator

def _gen_columns(n):
    """Order fields derived from a sequence number by hashing (stable)."""
    h = F.xxhash64(n)
    return [
        n.cast("string").alias("orderid"),
        F.concat(F.lit("Item_"), F.pmod(h, F.lit(10)).cast("string")).alias("itemid"),
        (F.pmod(F.xxhash64(n, F.lit(1)), F.lit(1000)) / F.lit(100.0)).alias("orderunits"),
        F.struct(F.concat(F.lit("City_"), F.pmod(F.xxhash64(n, F.lit(2)), F.lit(100)).cast("string")).alias("city"),
                 F.concat(F.lit("State_"), F.pmod(F.xxhash64(n, F.lit(3)), F.lit(50)).cast("string")).alias("state"),
                 F.pmod(F.xxhash64(n, F.lit(4)), F.lit(100000)).alias("zipcode")).alias("address")]


def generated_orders(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Endless order generator on the rate source (one row per tick)."""
    r = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return r.select(F.unix_millis("timestamp").alias("ordertime"), *_gen_columns(F.col("value"))) \
        .select("orderid", "ordertime", "itemid", "orderunits", "address")


def generated_orders_batch(spark: SparkSession, n: int, start_ms: int = 1704067200000,
                           max_interval_ms: int = 1000) -> DataFrame:
    """``n`` generated orders with at most ``max_interval_ms`` between them."""
    r = spark.range(n)
    # t(id) = start + id * M/2 + jitter(id), jitter in [0, M/2): consecutive
    # orders are between 1 ms and M apart, computed per row (no window)
    half = max(max_interval_ms // 2, 1)
    jitter = F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(half))
    ot = F.lit(start_ms) + F.col("id") * F.lit(half) + jitter
    return r.select(ot.alias("ordertime"), *_gen_columns(F.col("id"))) \
        .select("orderid", "ordertime", "itemid", "orderunits", "address")
