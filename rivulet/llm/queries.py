"""Thin registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (brown, centroids, extract, fertility, lattice, oracles, packing, ppm, replies, simhash, spelling, surrogates,
               wordbpe, wordpiece)
from .common import crc_mod, read

QueryFn = Callable[[SparkSession, str], DataFrame]


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(read(spark, sf_dir, "documents", "doc_id", "text"), count="n_replaced")


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return fertility.judge(docs, carry=["doc_id"]).select(
        "doc.doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words",
        "f.base_failed", "kept", "f.n_pieces", "f.chars_per_token", "f.byte_share", "f.entropy")


def op4_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    scored = ppm.identify(docs, ppm.split_training())
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"),
                         "langid.lang_pred", "langid.score", "langid.bits_per_byte")


def op5_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op6_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op7_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = brown.score(read(spark, sf_dir, "documents", "doc_id", "text"), brown.split_training())
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score", "perplexity")


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return packing.pack(docs, keep_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window")


def op9_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_gbt_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "url", "main.text", "main.n_chars")


#: A conversation whose texts look like control strings, beside those of the table.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = rows.union(spark.createDataFrame(PROBE, rows.schema))
    found = replies.read_back(replies.conversations(*replies.turn_chain(rows)))
    return found.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_simplex_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_pii_surrogates, op2_bpe_automaton, op3_tokeniser_fertility, op4_ppm_language,
    op5_lattice_neardup, op6_simhash_popcount, op7_brown_classes,
    op8_mixture_packing, op9_longest_match_counts, op10_gbt_extraction,
    op11_reply_trees, op12_spelling_variants, op13_simplex_centroids,
)}

#: SQL by query name, where SQL can express the method.
ORACLES: dict[str, str] = {
    "op11_reply_trees": oracles.REPLIES, "op12_spelling_variants": oracles.SPELLING, "op13_simplex_centroids": oracles.CENTROIDS,
}
