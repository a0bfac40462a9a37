"""Corpus pipeline over ``documents``: each stage calls one operator of ``rivulet.llm``.

Stages take and return all columns of ``documents`` (the last one returns packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import fertility, packing, ppm, simhash, surrogates
from rivulet.llm.common import read, scratch

#: Least confidence of a language prediction.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a confident language (operator 4)."""
    found = ppm.identify(docs, ppm.split_training(), out="_langid")
    return found.filter((F.col("_langid.lang_pred") != ppm.UNKNOWN)
                        & (F.col("_langid.score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents outside the fertility bands or failing the base rules (operator 3)."""
    return fertility.judge(docs).filter("kept").select("doc.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of SimHash near-duplicates (operator 6)."""
    return simhash.one_of_each(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates (operator 1); ``n_chars`` follows the new text."""
    done = surrogates.replace(docs, count="_replaced")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_replaced") > 0, F.char_length("text").cast("long"))
                               .otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all kept documents into training sequences (operator 8)."""
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("pii_surrogates", pii_surrogates),
    ("mixture_packing", mixture_packing),
]

#: The stages learn, tokenize and draw keyed surrogates: SQL can't express them (tests use brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table; each result is written and reread."""
    docs = read(spark, sf_dir, "documents", "*")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch(docs, f"pipeline-{name}")
    return docs
