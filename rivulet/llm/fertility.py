"""Quality rules on tokeniser fertility.

A public vocabulary with byte fallback tokenizes every whole text.  Three figures are
taken per document: characters per token, share of byte-fallback tokens, and entropy
of its token distribution in bits.  Text that the vocabulary can't split into known
pieces, or that repeats the same few pieces, leaves the range that its language shows
in the corpus.

The ranges (bands) are learned per language, or per script where a document names no
language, from all documents that pass the base rules, equal texts counting once:
quartiles by mergeable sketches, then the outer fences ``quartile -/+ FENCE x
interquartile range``, never narrower than a fixed tolerance around the quartile.
Entropy grows with the length of a text and short texts vary more, so bands are also
per size class (powers of two of the token count).  A document outside a band is
rejected.  A size class with fewer than ``LEAST`` documents is merged with its neighbours
until its own documents can't move a quartile (entropy then has one tolerance more per
merged class); a language with fewer uses the bands of its documents' script, and a script
with fewer those of the whole corpus, so that every document has a band.

Base rules: fewer than 50 words, or over half of the words in repeated 3-word windows.

Defined results: null and empty texts have no word and fail the base rules; the bands
skip null figures; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RecentCache, scratch, small_batches, text_udf

VOCABULARY = "piece_bpe_32k.model"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
FENCE = 3.0
LEAST = 30
#: Least distance of a fence from its quartile: part of it (ratio) or absolute.
TOLERANCE_CHARS = 0.05
TOLERANCE_BYTES = 0.02
TOLERANCE_ENTROPY = 0.3

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Scripts told apart where a document names no language.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")
FIGURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("n_pieces", T.LongType()), T.StructField("chars_per_token", T.DoubleType()),
    T.StructField("byte_share", T.DoubleType()), T.StructField("entropy", T.DoubleType()),
    T.StructField("band_group", T.StringType()), T.StructField("script_group", T.StringType())])
_RANGE = "bg string, sg string, bs long, source string, lo long, hi long"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a ``width``-word window found at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words))
    with np.errstate(over="ignore"):
        mix = sum(h[k:n + k] * np.int64(m) for k, m in zip(range(width), (1, 1000003, 998244353)))
    if len(np.unique(mix)) == n:                 # equal windows have equal hashes: none repeats
        return 0
    windows = list(zip(*[words[k:] for k in range(width)]))
    count: dict[tuple, int] = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = np.fromiter((count[w] > 1 for w in windows), bool, n)
    cover = np.zeros(len(words), bool)
    for k in range(width):
        cover[k:n + k] |= hit
    return int(cover.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    return n


@lru_cache(maxsize=1)
def _script_table() -> np.ndarray:
    """Code point -> 1 + its place in ``SCRIPTS``, or 0."""
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000])
    every = "".join(map(chr, points))
    table = np.zeros(0x110000, np.uint8)
    for k, s in enumerate(SCRIPTS, 1):
        for m in regex.finditer(rf"\p{{Script={s}}}+", every):
            table[points[m.start():m.end()]] = k
    return table


def script(text: str) -> str:
    """The script with the most letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(_script_table()[points], minlength=len(SCRIPTS) + 1)[1:]
    return SCRIPTS[int(counts.argmax())] if counts.any() else "none"


class Fertility:
    """Figures of one text under one vocabulary; words are tokenized once and remembered."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.cache = RecentCache(self._word, 250_000)

    def _word(self, word: bytes) -> bytes:
        return np.array(self.model.encode(word.decode("utf-8", "replace")), "<u4").tobytes()

    def figures(self, text: str | None, lang: str | None) -> tuple:
        data = (text or "").encode("utf-8", "replace")
        words = data.split()                                 # exactly the ASCII white space
        n = len(words)
        chars = len(text or "") - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        repeat = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<u4")
        total = len(ids)
        per = share = entropy = None
        if total:
            counts = np.unique(ids, return_counts=True)[1] / total
            per, share = chars / total, float(self.is_byte[ids].mean())
            entropy = float(-(counts * np.log2(counts)).sum()) + 0.0
        written = "script:" + script(text) if total else None
        group = None if not total else "lang:" + lang if lang is not None else written
        return (n, chars, len(SYMBOLS.findall(text or "")), duplicate_lines(text or ""), repeat, failed,
                total, per, share, entropy, group, written)


@lru_cache(maxsize=4)
def load(path: str) -> Fertility:
    return Fertility(path)


def measure(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None) -> Column:
    """Column of the struct ``FIGURES`` of a document."""
    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def make():
        model = load(path)
        return lambda texts, langs: [model.figures(t, la) for t, la in zip(texts, langs)]
    return text_udf(make, FIGURES)(text, lang)


def _size_class(pieces: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(pieces), F.lit(1))))


#: Bins of a measured unit (a character per token, the whole byte share, a bit) whose counts give the quartiles.
BINS = 1024
MEASURED = ("n_pieces", "chars_per_token", "byte_share", "entropy")


def _once(figures: DataFrame, *groups: str) -> DataFrame:
    """Figures of distinct texts per group that a document is in."""
    return (figures.withColumn("source", F.explode(F.array(*groups)))
            .groupBy("source", "text_key").agg(*[F.min(c).alias(c) for c in MEASURED])
            .withColumn("size_class", _size_class("n_pieces")))


def _range(sizes: dict[int, int], at: int) -> tuple[int, int]:
    """Size classes to learn the band of class ``at`` from."""
    if sizes.get(at, 0) >= LEAST:
        return at, at
    for d in range(1, 64):
        if sum(n for k, n in sizes.items() if abs(k - at) <= d) >= 4 * LEAST:
            return at - d, at + d
    return 0, 63


def bands(figures: DataFrame) -> DataFrame:
    """Bands per (band_group, script_group, size_class) found in figures with a ``text_key`` column."""
    spark = figures.sparkSession
    good = figures.filter(~F.col("base_failed") & F.col("band_group").isNotNull())
    once = scratch(_once(good, "band_group"), "fertility-once")

    def sizes_of(texts):                                     # a handful of rows per group
        sizes: dict[str, dict[int, int]] = {}
        for r in texts.groupBy("source", "size_class").count().collect():
            sizes.setdefault(r[0], {})[r[1]] = r[2]
        return sizes
    own = sizes_of(once)
    if any(sum(n.values()) < LEAST for n in own.values()):
        wider = scratch(_once(good, "script_group", F.lit("corpus")), "fertility-wider")
        wide = sizes_of(wider)
        # a group without a language has the same name and texts, or fewer, as its script
        once = once.withColumn("level", F.lit(0)).unionByName(wider.withColumn("level", F.lit(1)))
    else:
        wide, once = {}, once.withColumn("level", F.lit(0))
    keys = good.select("band_group", "script_group", _size_class("n_pieces").alias("k")).distinct().collect()
    ranges = []
    for group, written, k in keys:
        level, source, sizes = 0, group, own[group]
        for name in (written, "corpus"):
            if sum(sizes.values()) < LEAST:
                level, source, sizes = 1, name, wide[name]
        ranges.append((group, written, k, source, *_range(sizes, k), level))
    # written, so that the joins see their real size
    ranges = scratch(spark.createDataFrame(ranges, _RANGE + ", at_level int").coalesce(1), "fertility-ranges")
    wanted = scratch(ranges.select(F.col("source").alias("s"), "lo", "hi", "at_level").distinct().coalesce(1), "fertility-wanted")
    within = once.join(F.broadcast(wanted), (F.col("source") == F.col("s")) & (F.col("level") == F.col("at_level"))
                       & F.col("size_class").between(F.col("lo"), F.col("hi")))
    # a histogram of fixed bins, summed inside the tasks: the same quartiles whatever the partitions
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.round(F.col(c) * BINS).cast("long").alias("bin"))
                               for i, c in enumerate(MEASURED[1:])])).alias("x")
    histogram = (within.select("source", "at_level", "lo", "hi", bins).select("source", "at_level", "lo", "hi", "x.*")
                 .groupBy("source", "at_level", "lo", "hi", "m", "bin").agg(F.count(F.lit(1)).alias("n")))
    q = histogram.groupBy("source", "at_level", "lo", "hi").agg(*[
        F.transform(F.percentile(F.when(F.col("m") == i, F.col("bin")), [0.25, 0.75], F.col("n")), lambda v: v / BINS).alias(c)
        for i, c in enumerate(MEASURED[1:])])

    def low(c, tolerance):
        return F.col(c)[0] - F.greatest((F.col(c)[1] - F.col(c)[0]) * FENCE, tolerance)

    def high(c, tolerance):
        return F.col(c)[1] + F.greatest((F.col(c)[1] - F.col(c)[0]) * FENCE, tolerance)
    per = F.col("chars_per_token")[0] * TOLERANCE_CHARS
    apart = F.least(F.col("hi") - F.col("lo"), F.lit(10)) * F.lit(TOLERANCE_ENTROPY / 2)      # classes on one side
    return ranges.join(q, ["source", "at_level", "lo", "hi"]).select(
        "bg", "sg", "bs", low("chars_per_token", per).alias("chars_low"), high("chars_per_token", per).alias("chars_high"),
        high("byte_share", F.lit(TOLERANCE_BYTES)).alias("byte_high"),
        (low("entropy", F.lit(TOLERANCE_ENTROPY)) - apart).alias("entropy_low"),
        (high("entropy", F.lit(TOLERANCE_ENTROPY)) + apart).alias("entropy_high"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str | None = None,
          carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (as struct ``doc``), the struct ``f`` of FIGURES, and ``kept``.

    The figures are written once; the bands come from the written rows of all documents.
    """
    carry = docs.columns if carry is None else carry
    rows = scratch(docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"),
                               F.xxhash64(text).alias("text_key"),
                               measure(docs, text, lang, vocabulary).alias("f")), "fertility")
    # a handful of rows per language; written, so that the join sees their real size
    band = scratch(bands(rows.select("text_key", "f.*")), "fertility-bands")
    joined = rows.join(band, (rows.f.band_group == F.col("bg")) & (rows.f.script_group == F.col("sg"))
                       & (_size_class("f.n_pieces") == F.col("bs")), "left")
    inside = (F.col("f.chars_per_token").between(F.col("chars_low"), F.col("chars_high")) & (F.col("f.byte_share") <= F.col("byte_high"))
              & F.col("f.entropy").between(F.col("entropy_low"), F.col("entropy_high")))
    return joined.select("doc", "f", (~F.col("f.base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
