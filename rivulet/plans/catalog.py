"""Named streams and tables: list, describe, drop, explain.

Streams and tables are registered as temporary views (streaming or batch);
tables maintained by a running query also record the query, its checkpoint
and its data path so that ``drop`` can stop the query and optionally delete
the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..streaming import storage


@dataclass
class _Entry:
    kind: str                      # STREAM | TABLE
    query: StreamingQuery | None = None
    checkpoint: str | None = None
    data_path: str | None = None


@dataclass
class Catalog:
    spark: SparkSession
    entries: dict = field(default_factory=dict)

    def create_stream(self, name: str, df: DataFrame, replace: bool = False) -> None:
        """``CREATE STREAM [IF NOT EXISTS]``: register a (streaming) DataFrame."""
        if name in self.entries and not replace:
            return                                   # idempotent declaration
        df.createOrReplaceTempView(name)
        self.entries[name] = _Entry("STREAM")

    def create_table(self, name: str, read: DataFrame, query: StreamingQuery | None = None,
                     checkpoint: str | None = None, data_path: str | None = None) -> None:
        read.createOrReplaceTempView(name)
        self.entries[name] = _Entry("TABLE", query, checkpoint, data_path)

    def list(self) -> DataFrame:
        """``SHOW STREAMS`` / ``SHOW TABLES`` with running-query status."""
        rows = []
        for n, e in sorted(self.entries.items()):
            running = bool(e.query is not None and e.query.isActive)
            rows.append((n, e.kind, running, e.query.name if e.query is not None else None))
        return self.spark.createDataFrame(rows, "name string, kind string, query_running boolean, query string")

    def describe(self, name: str) -> DataFrame:
        """``DESCRIBE``: field names and types of a stream or table."""
        sch = self.spark.table(name).schema
        rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in sch.fields]
        return self.spark.createDataFrame(rows, "field string, type string, nullable boolean")

    def drop(self, name: str, delete_data: bool = False) -> None:
        """``DROP STREAM|TABLE [DELETE TOPIC]``: stop the query, drop the view,
        remove its checkpoint, and with ``delete_data`` its data."""
        e = self.entries.pop(name)
        if e.query is not None and e.query.isActive:
            e.query.stop()
        self.spark.catalog.dropTempView(name)
        if e.checkpoint:
            storage.delete(self.spark, e.checkpoint)
        if delete_data and e.data_path:
            storage.delete(self.spark, e.data_path)


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """``EXPLAIN``: the plan text (``simple``, ``extended``, ``formatted``, ``cost``)."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
