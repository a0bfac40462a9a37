"""Sinks: keyed upsert tables, dead letters and bounded retries.

A keyed table is a folder of parquet change files, one ``_batch=<id>`` partition per
micro-batch, split by a hash bucket of the key:

* an upsert keeps the latest row per key of its batch (a hash aggregate with
  map-side combine) and overwrites only its own batch's partition, so a replayed or retried
  batch replaces what it wrote before, and no committed file is ever rewritten;
* a read takes the latest row per key over all batches, "latest" being decided by
  ordering columns carried in the rows (event time, then log offset) and the batch
  last, so out-of-order deliveries converge to the same table;
* a lookup of one key reads only that key's bucket of each batch.

Nothing is collected to the driver.  With ``fold_every`` every so many batches are folded into their
latest rows, which bounds the files a read lists; ``compact`` writes the current rows into a new table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.flatten import flatten
from ..session import checkpoint_root
from . import storage

BATCH, BUCKET = "_batch", "_bucket"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple (nulls lowest).

    ``max_by`` keeps one row per key and task before the shuffle, so a key with many
    changes costs one row per task.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    made = df.groupBy(*keys).agg(F.max_by(whole, rank).alias("_row"))
    # key columns come from the grouping, so that a filter on them reaches the scan
    return made.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


class KeyedTable:
    """Change files of a table keyed by ``keys`` with columns ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str],
                 order: Sequence[str] = (), buckets: int = 16, bucket_by: Sequence[str] | None = None, fold_every: int = 0):
        checkpoint_root(spark)
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, list(keys), list(order), buckets
        self.bucket_by, self.fold_every = list(bucket_by or keys), fold_every
        if self.bucket_by != self.keys[:len(self.bucket_by)]:
            raise ValueError("bucket_by must be the first key columns")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        storage.make_folder(spark, path)

    def _bucket(self, *keys) -> F.Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        new = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        if self.order:
            new = latest_per_key(new, self.keys, self.order)
        (new.withColumn(BUCKET, self._bucket(*self.bucket_by)).sortWithinPartitions(BUCKET, *self.keys)
         .write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{BATCH}={int(batch_id)}"))
        if self.fold_every and (batch_id + 1) % self.fold_every == 0:
            self.fold(batch_id)

    def fold(self, batch_id: int) -> None:
        """Write the latest rows of all batches up to ``batch_id`` as one fold, which reads use from then on.

        The fold lies beside the batches and counts once its job has committed.  A replayed batch folds again and
        gets the same rows.  Batches of the fold before the last one are removed: a reader that began
        before this fold still finds its files.
        """
        older = self._folds()
        rows = self._latest(self.changes().where(F.col(BATCH) <= F.lit(batch_id)), [BATCH, BUCKET])
        rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}-folds/{int(batch_id)}")
        for done in [f for f in older if f < batch_id][:-1]:
            storage.delete(self.spark, f"{self.path}-folds/{done}")
        kept = max([f for f in older if f < batch_id], default=-1)
        for b in storage.numbers(self.spark, self.path, f"{BATCH}="):
            if b <= kept:
                storage.delete(self.spark, f"{self.path}/{BATCH}={b}")

    def _folds(self) -> list[int]:
        found = storage.numbers(self.spark, f"{self.path}-folds", "")
        return [f for f in found if storage.exists(self.spark, f"{self.path}-folds/{f}/_SUCCESS")]

    def changes(self) -> DataFrame:
        """The newest fold and all rows of the batches after it, with their ``_batch`` and ``_bucket``."""
        extra = [T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType())]
        read = self.spark.read.schema(T.StructType(self.schema.fields + extra))
        rows, folds = read.option("basePath", self.path).parquet(self.path), self._folds()
        if folds:
            rows = rows.where(F.col(BATCH) > F.lit(folds[-1])).unionByName(read.parquet(f"{self.path}-folds/{folds[-1]}"))
        return rows

    def _latest(self, rows: DataFrame, more: Sequence[str] = ()) -> DataFrame:
        return latest_per_key(rows, self.keys, [*self.order, BATCH]).select(*self.schema.names, *more)

    def read(self) -> DataFrame:
        return self._latest(self.changes())

    def lookup(self, *key) -> DataFrame:
        """The current rows of a key, or of the keys that begin with the given columns.

        With at least the ``bucket_by`` columns only their bucket's files are listed and read.
        """
        rows, literals = self.changes(), [F.lit(v).cast(self.schema[k].dataType) for k, v in zip(self.keys, key)]
        if len(literals) >= len(self.bucket_by):
            bucket = self.spark.range(1).select(self._bucket(*literals[:len(self.bucket_by)])).first()[0]
            rows = rows.where(F.col(BUCKET) == F.lit(bucket))
        for k, v in zip(self.keys, literals):
            rows = rows.where(F.col(k).eqNullSafe(v))
        return self._latest(rows)

    def compact(self, path: str) -> KeyedTable:
        """The current rows as one batch of a new table."""
        out = KeyedTable(self.spark, path, self.schema, self.keys, self.order, self.buckets)
        out.upsert(self.read(), 0)
        return out


def _lasting(exc: Exception) -> bool:
    """Errors that a retry can't mend: analysis and programming errors."""
    return isinstance(exc, (AnalysisException, TypeError, ValueError, KeyError, AttributeError))


def with_retries(action: Callable[[], None], timeout_s: float = 60.0, max_delay_s: float = 5.0,
                 first_delay_s: float = 0.1, sleep=time.sleep, clock=time.monotonic) -> int:
    """Run ``action`` until it succeeds, backing off exponentially (capped at
    ``max_delay_s``) for at most ``timeout_s`` in total; re-raise after that.
    Returns the number of attempts.  Only I/O and job failures are retried (the action
    must be idempotent); analysis errors are raised at once."""
    start, delay, attempts = clock(), first_delay_s, 0
    while True:
        attempts += 1
        try:
            action()
            return attempts
        except (OSError, PySparkException, Py4JError) as exc:
            if _lasting(exc) or clock() - start + delay > timeout_s:
                raise
            sleep(delay)
            delay = min(delay * 2, max_delay_s)


# ---------------------------------------------------------------- connector pipeline

SINK_VALUE = T.StructType([
    T.StructField("ordertime", T.LongType()), T.StructField("orderid", T.StringType()),
    T.StructField("itemid", T.StringType()), T.StructField("orderunits", T.DoubleType()),
    T.StructField("address", T.StructType([
        T.StructField("city", T.StringType()), T.StructField("state", T.StringType()),
        T.StructField("zipcode", T.LongType())]))])


JSON_START = r"\A[\x00-\x20\x{FEFF}]*[{\[]"


def validate_orders(records: DataFrame) -> DataFrame:
    """Decode record values and attach an ``error`` (NULL when valid).

    Errors: value not JSON for the schema, primary key missing or not an
    integer, a NOT NULL column missing, a text column longer than 255.
    """
    s = T.StructType(SINK_VALUE.fields + [T.StructField("_corrupt_record", T.StringType())])
    v = F.from_json(F.col("value"), s, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # what does not begin like an object or an array never decodes: the parser would only throw, at more than the cost of a good row
    d = records.withColumn("v", F.when(F.col("value").rlike(JSON_START), v))
    pk = F.col("v.orderid").try_cast("bigint")
    err = (F.when(F.col("value").isNull(), F.lit("null value"))
           .when(F.col("v").isNull() | F.col("v._corrupt_record").isNotNull(), F.lit("value is not valid JSON"))
           .when(F.col("v.orderid").isNull(), F.lit("primary key orderid is missing"))
           .when(pk.isNull(), F.lit("orderid is not a BIGINT"))
           .when(F.col("v.ordertime").isNull() | F.col("v.itemid").isNull() | F.col("v.orderunits").isNull(),
                 F.lit("NOT NULL column is null"))
           .when((F.length("v.itemid") > 255) | (F.length("v.address.city") > 255)
                 | (F.length("v.address.state") > 255), F.lit("value too long for VARCHAR(255)")))
    return d.withColumn("error", err).withColumn("_pk", pk)


def checked_orders(records: DataFrame) -> DataFrame:
    """:func:`validate_orders` as a sink keeps it: what was decoded of the valid records, the value of the others."""
    bad = F.col("error").isNotNull()
    return validate_orders(records).select("topic", "partition", "offset", "key", F.when(bad, F.col("value")).alias("value"),
                                           F.when(~bad, F.col("v").dropFields("_corrupt_record")).alias("v"), "error", "_pk")


def sink_rows(valid: DataFrame) -> DataFrame:
    """Valid records flattened into the sink layout (``address_city`` ...),
    with the log position kept for ordering."""
    v = valid.select(F.col("_pk").alias("orderid"), "v.ordertime", "v.itemid", "v.orderunits", "v.address",
                     F.col("partition").alias("_partition"), F.col("offset").alias("_offset"))
    return flatten(v, "_")


def dead_letters(invalid: DataFrame, batch_id: int, connector: str) -> DataFrame:
    """Failed records with the context the dead-letter topic carries."""
    return invalid.select(
        "key", "value",
        F.struct(F.col("topic").alias("topic"), F.col("partition").alias("partition"),
                 F.col("offset").alias("offset"), F.lit(connector).alias("connector"),
                 F.lit("VALUE_CONVERTER").alias("stage"), F.col("error").alias("exception_message"))
        .alias("context"),
        F.lit(batch_id).cast("bigint").alias("batch_id"))


ORDERS_TABLE = ("orderid bigint, ordertime bigint, itemid string, orderunits double, address_city string, "
                "address_state string, address_zipcode bigint, _partition int, _offset bigint")


def orders_table(spark: SparkSession, path: str, buckets: int = 16, fold_every: int = 0) -> KeyedTable:
    """The sink table: primary key ``orderid``, latest by (order time, log position)."""
    return KeyedTable(spark, path, ORDERS_TABLE, ["orderid"], ["ordertime", "_partition", "_offset"], buckets, fold_every=fold_every)


class OrdersSink:
    """The upsert sink with dead-letter routing, as a ``foreachBatch`` body.

    ``table`` may be any object with ``upsert(df, batch_id)`` (a :class:`KeyedTable` by
    default); writes go through :func:`with_retries`.
    """

    def __init__(self, spark: SparkSession, table_path: str, dlq_path: str,
                 connector: str = "jdbc-sink-orders", retry_timeout_s: float = 60.0,
                 retry_max_delay_s: float = 5.0, table=None):
        self.table = table or orders_table(spark, table_path)
        self.dlq_path, self.connector = dlq_path, connector
        self.retry_timeout_s, self.retry_max_delay_s = retry_timeout_s, retry_max_delay_s

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        checked = checked_orders(batch).persist()
        try:
            good = sink_rows(checked.where(F.col("error").isNull()))
            bad = dead_letters(checked.where(F.col("error").isNotNull()), batch_id, self.connector)
            with_retries(lambda: self.table.upsert(good, batch_id), self.retry_timeout_s, self.retry_max_delay_s)
            with_retries(lambda: bad.drop("batch_id").write.mode("overwrite").parquet(f"{self.dlq_path}/batch_id={batch_id}"),
                         self.retry_timeout_s, self.retry_max_delay_s)
        finally:
            checked.unpersist()


DEAD_LETTER = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("context", T.StructType([
        T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()), T.StructField("connector", T.StringType()),
        T.StructField("stage", T.StringType()), T.StructField("exception_message", T.StringType())])),
    T.StructField("batch_id", T.LongType())])


def read_dead_letters(spark: SparkSession, dlq_path: str) -> DataFrame:
    storage.make_folder(spark, dlq_path)
    return spark.read.schema(DEAD_LETTER).option("basePath", dlq_path).parquet(dlq_path)
