"""Paths in the shared checkpoint folder and file-system helpers.

Everything a job persists (staged topics, keyed tables, dead letters, stream
checkpoints) lives under ``spark.checkpoint.dir`` -- the shared folder the
cluster names -- and is accessed through Hadoop's FileSystem API, so the same
code works on local disk, HDFS or an object store.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession

from ..session import checkpoint_path


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True) if fs.exists(p) else False


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def count_files(spark: SparkSession, path: str, suffix: str) -> int:
    """Files below ``path`` whose name ends with ``suffix``."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return 0
    found, files = 0, fs.listFiles(p, True)
    while files.hasNext():
        found += files.next().getPath().getName().endswith(suffix)
    return found


def numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Sorted numbers of the entries of a folder that are named ``prefix`` and a number."""
    fs, p = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new, unique location under the checkpoint root."""
    return checkpoint_path(spark, kind, uuid.uuid4().hex)


def keyed_path(spark: SparkSession, kind: str, *key: str) -> str:
    """A stable location for content fully determined by ``key``."""
    h = hashlib.sha1("|".join(key).encode()).hexdigest()[:16]
    return checkpoint_path(spark, kind, h)
