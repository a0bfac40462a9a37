import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
EN = "the quick brown fox jumps over the lazy dog and then the cat sat on the mat with another fox "
DE = "der schnelle braune Fuchs springt über den faulen Hund und dann saß die Katze auf der Matte "

#: Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns
#: that clash with names the operators use.
ODD = [
    (0, None, "en", "a", 1, "x"), (1, "", "en", "a", 2, None), (2, " \t\n ", None, None, 3, "x"),
    (3, EN * 5, "en", "a", 4, "x"), (4, EN * 5, "en", "a", 4, "x"), (4, EN * 5, "en", "a", 4, "x"),
    (5, DE * 5, "de", "b", 5, "y"), (6, DE * 5 + "zwei", "de", None, 5, "y"), (7, LONG, "en", "a", 6, "z"),
    (8, "12 34 !!! ***", None, "b", 7, "z"), (9, "Ünḯ 中文 emoji 🙂 \x1c tab\x85", "xx", "b", 8, "z"),
    (10, EN * 3 + "mail ann.b@mail.example.com or +1 (499) 555-6503", "en", "c", 9, None),
    (None, EN, "en", "c", 9, None), (11, "To To To " * 40, "en", "c", 9, None), (12, DE * 6, None, "c", 9, None),
]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType())])


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward documents; the extra column ``row`` clashes with an internal name."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    """An empty table of documents."""
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from pyspark.sql import SparkSession
    from rivulet.session import BASE_CONF
    b = (SparkSession.builder.master("local[*]").appName("rivulet-llm-tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rivulet-llm-ckpt-"))
    yield s
