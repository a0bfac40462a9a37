"""Helpers shared by the training-data operators.

* ``scratch``: cut lineage by writing a table into the shared folder named by
  ``spark.checkpoint.dir`` and rereading it.
* ``text_udf``: run a Python function over Arrow batches of a text column.  The
  function gets a list of texts and returns one tuple of values per text.
* ``crc_mod``: the train / held-out split of the language operators.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import checkpoint_path
from ..sources.tables import table_path

#: Rows per Arrow batch of whole texts: bounds the memory of a Python worker.
TEXT_BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A pruned read of one of the given tables."""
    return spark.read.parquet(table_path(sf_dir, name)).select(*columns)


def scratch(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return it reread."""
    spark = df.sparkSession
    path = checkpoint_path(spark, "llm", kind, uuid.uuid4().hex)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows (hence bytes) of every Arrow batch that carries texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers of this session find the package where the driver found it.

    Needed where the driver got it from ``sys.path`` alone; a cluster that ships the package
    (``--py-files``) is not affected.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


def text_udf(make: Callable[[], Callable[..., list[tuple]]], schema: T.StructType):
    """A column function over whole texts.

    ``make()`` runs once per task and returns ``fn(*columns)``, which maps equally
    long Python lists to one tuple (in the order of ``schema``) per row.
    The function is marked non-deterministic only so that Catalyst never
    evaluates it twice (once for a filter, once for the projection).
    """
    let_workers_import(SparkSession.active())
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    @F.arrow_udf(schema)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        fn = make()
        for columns in batches:
            columns = (columns,) if isinstance(columns, pa.Array) else columns
            rows = fn(*[c.to_pylist() for c in columns])
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.StructArray.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(cols, fields)], fields=fields)

    return run.asNondeterministic()


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (a null id counts as empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


class RecentCache(dict):
    """A bounded memo in two generations; a full young generation becomes the old one.

    Values are recomputed after they fall out, so a bound never changes a result.
    """

    def __init__(self, compute: Callable, limit: int = 400_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
