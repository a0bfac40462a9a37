"""Readers for the parquet tables, always with an explicit column list.

Selecting the columns at the read lets Catalyst prune the parquet scan
(``ReadSchema`` shows only these fields) before anything else happens.

The relation (schema from the footer, file listing) is reused while the
table's file listing (names, lengths, times) is unchanged, so queries composed of many
reads of one table do not re-read its footer each time; a rewritten table, or a file
added to its folder, changes the listing and is picked up.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession

_RELATIONS: dict[tuple, tuple[str, DataFrame]] = {}


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def listing(spark: SparkSession, path: str) -> str:
    """A digest of the table's files: any added, removed or rewritten file changes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(p, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()


def listings(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """One digest for several tables: the key of anything derived from them."""
    return ",".join(listing(spark, table_path(sf_dir, n)) for n in names)


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    path = table_path(sf_dir, name)
    key, now = (spark.sparkContext.applicationId, path), listing(spark, path)
    kept = _RELATIONS.get(key)
    if kept is None or kept[0] != now:
        kept = _RELATIONS[key] = (now, spark.read.parquet(path))
    df = kept[1]
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores, where the scan has fewer partitions than there are cores.

    For rows that are about to be expanded into many: a small file is one scan partition, and everything up to the next shuffle
    would run in one task.  A table of many files is scanned by enough tasks and isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
