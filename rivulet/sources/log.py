"""A topic's records stored once, so that reads by position or time open only the files that hold them.

Layout: parquet folders ``topic / partition / segment``.  A segment is a run of ``rows_per_segment`` offsets; offsets are
dense, so segments are equally large whatever the skew of partitions or times, and each is written by one task,
sorted by offset.  Beside it an index holds one row per segment with its range of offsets and times.

* A position is a filter on the folder columns (partition and first segment) and on the offset.
* A time selects segments through the index; the join with it prunes folders at run time.
* The first records of all partitions lie in their first segments.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import storage

ROWS_PER_SEGMENT = 1_000_000
FOLDERS = ["topic", "partition", "segment"]
FORMAT = "1"                # part of the folder's key: bump when the layout changes


@dataclass(frozen=True)
class TopicLog:
    """Readers of a stored log; each returns whole records (with their ``segment``)."""

    records: DataFrame
    index: DataFrame
    rows_per_segment: int

    def _segment(self, offset: int) -> Column:
        return F.lit(offset // self.rows_per_segment).cast("bigint")

    def from_partition_offset(self, topic: str, partition: int, offset: int) -> DataFrame:
        """One partition from an offset on."""
        return self.records.where((F.col("topic") == topic) & (F.col("partition") == partition)
                                  & (F.col("segment") >= self._segment(offset)) & (F.col("offset") >= offset))

    def from_timestamp(self, ts_ms: int) -> DataFrame:
        """Records at or after a time, from the segments whose latest record is."""
        later = self.index.where(F.col("last_timestamp") >= ts_ms).select(*FOLDERS)
        return self.records.join(later, FOLDERS, "left_semi").where(F.col("timestamp") >= ts_ms)

    def first(self, n: int) -> DataFrame:
        """The first ``n`` records by (timestamp, partition, offset), of a log whose times follow its offsets."""
        head = self.records.where((F.col("segment") <= self._segment(n)) & (F.col("offset") < n))
        return head.orderBy("timestamp", "partition", "offset").limit(n)


def write_log(records: DataFrame, path: str, rows_per_segment: int = ROWS_PER_SEGMENT) -> TopicLog:
    """Store the records of one or more topics under ``path``."""
    spark = records.sparkSession
    cut = _cut(records, rows_per_segment)
    (cut.repartition(*FOLDERS).sortWithinPartitions(*FOLDERS, "offset")
     .write.mode("overwrite").option("compression", "zstd").partitionBy(*FOLDERS).parquet(path + "/records"))
    stored = spark.read.schema(cut.schema).parquet(path + "/records")
    (stored.groupBy(*FOLDERS).agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
                                  F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
     .write.mode("overwrite").parquet(path + "/index"))
    return read_log(records, path, rows_per_segment)


def read_log(like: DataFrame, path: str, rows_per_segment: int = ROWS_PER_SEGMENT) -> TopicLog:
    """A written log; ``like`` names the columns of its records and is not computed."""
    spark = like.sparkSession
    return TopicLog(spark.read.schema(_cut(like, rows_per_segment).schema).parquet(path + "/records"),
                    spark.read.parquet(path + "/index"), rows_per_segment)


def _cut(records: DataFrame, rows_per_segment: int) -> DataFrame:
    return records.withColumn("segment", F.expr(f"`offset` div {int(rows_per_segment)}"))


def stored_log(spark: SparkSession, name: str, key: tuple, build: Callable[[], DataFrame],
               rows_per_segment: int = ROWS_PER_SEGMENT) -> TopicLog:
    """The log of ``build()``, written once per state of the inputs that ``key`` names.

    Each attempt writes a folder of its own, which the marker names once it is whole: an interrupted or a second
    writer disturbs no reader.
    """
    path = storage.keyed_path(spark, "logs", FORMAT, name, *map(str, key), str(rows_per_segment))
    marker = path + "/_COMPLETE"
    records = build()
    if storage.exists(spark, marker + "/_SUCCESS"):
        return read_log(records, path + "/" + spark.read.parquet(marker).first()["attempt"], rows_per_segment)
    attempt = uuid.uuid4().hex
    log = write_log(records, path + "/" + attempt, rows_per_segment)
    spark.createDataFrame([(attempt,)], "attempt string").write.mode("overwrite").parquet(marker)
    return log
