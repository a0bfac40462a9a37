"""Language identification by prediction by partial matching.

One byte context tree per language, contexts of up to three bytes.  Spark counts the
byte 4-grams of the training sample per language; all shorter contexts follow from
these by summation.  A symbol's probability in a context with ``n`` occurrences of
``d`` distinct symbols is ``c / (n + d)`` if it was seen there; else the escape
``d / (n + d)`` times its probability in the context one byte shorter, renormalised
over the symbols not seen here (exclusion), down to a uniform order -1.  So every
context holds a proper distribution and a text's cost is an exact code length in bits
under statistics that stay frozen while scoring.

The trees are variable-order: contexts of one, two and three bytes get a node only if they are among
the most frequent ones of all orders that fit ``TABLE_BYTES``; other positions are coded from the longest
context that has one.  So the bound holds for any number of languages and symbols, and frequent contexts of three
bytes keep their nodes when there are many languages.  Bytes never seen in training share one symbol class and
pay 8 more bits each.  The tables are broadcast; beside the nodes they hold an index of at most 0.8 MB and four
bytes per symbol for each node of order 2.

The fitting sample is bounded: about ``SAMPLE_BYTES`` of text per language, in pieces of
``PIECE_BYTES`` chosen by a hash of document and place among all labelled training documents
(a language with less text is used whole; of any other at least one piece is taken).  Every
document is scored whole.

Defined results: null text, or a text without a letter, is ``und`` with score 0; a
null label is no training row; with no training rows all is ``und``.  Among equal code
lengths the alphabetically first language wins.  Further columns pass through.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, scratch, small_batches, text_udf

ORDER = 3
SAMPLE_BYTES = 2_000_000
PIECE_BYTES = 4096
TABLE_BYTES = 48_000_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")

VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("bits_per_byte", T.DoubleType())])
_GRAMS = T.StructType([T.StructField("grams", T.ArrayType(T.StructType([
    T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])))])


def _bytes(text: str) -> np.ndarray:
    """Lower-cased (A-Z) UTF-8 bytes behind three spaces, the context of the first byte."""
    return np.frombuffer(b"   " + text.encode("utf-8", "replace").lower(), np.uint8)


def _grams(texts, picks=None) -> list[tuple]:
    """4-gram counts of whole texts, or of the picked pieces (each with the context before it)."""
    out = []
    for k, t in enumerate(texts):
        b = _bytes(t).astype(np.uint32)
        g = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        if picks is not None:
            g = np.concatenate([g[i * PIECE_BYTES:(i + 1) * PIECE_BYTES] for i in picks[k]])
        out.append(([{"gram": int(k), "n": int(n)} for k, n in zip(*np.unique(g, return_counts=True))],))
    return out


def train_counts(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang",
                 doc_id: str = "doc_id", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, gram, n): 4-gram counts of the bounded training sample."""
    def chance(piece):
        """In [0, 1), by document and piece."""
        return F.pmod(F.xxhash64("id", piece), F.lit(1 << 30)) / float(1 << 30)
    rows = (docs.filter(train & F.col(text).isNotNull() & F.col(lang).isNotNull())
            .select(F.col(lang).alias("lang"), F.col(text).alias("text"),
                    F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(text)).alias("id")))
    # one row per language; written, so that the join sees its real size and needn't move the texts
    share = scratch(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(chance(F.lit(0))).alias("first"))
                    .select(F.col("lang").alias("l"), "first",
                            (F.lit(float(sample_bytes)) / F.greatest("bytes", F.lit(1))).alias("share")), "ppm-shares")
    last = F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / F.lit(PIECE_BYTES)).cast("int")
    picks = F.filter(F.sequence(F.lit(0), last), lambda i: (chance(i) < F.col("share")) | ((i == 0) & (chance(F.lit(0)) == F.col("first"))))
    picked = rows.join(share, rows.lang == share.l).withColumn("picks", picks).filter(F.size("picks") > 0)
    return (picked.select("lang", F.explode(text_udf(lambda: _grams, _GRAMS)("text", "picks")["grams"]).alias("g"))
            .groupBy("lang", F.col("g.gram").alias("gram")).agg(F.sum("g.n").alias("n")))


class ContextTrees:
    """Code-length tables of all languages, built from 4-gram counts."""

    def __init__(self, counts: list[tuple[str, int, int]], table_bytes: int = TABLE_BYTES):
        self.langs = sorted({c[0] for c in counts})
        size = len(self.langs)
        if not size:
            return
        which = np.searchsorted(self.langs, [c[0] for c in counts])
        gram = np.array([c[1] for c in counts], np.int64)
        n = np.array([c[2] for c in counts], np.float64)
        used = np.unique(np.concatenate([gram >> s & 255 for s in (24, 16, 8, 0)]))
        self.symbol = np.full(256, len(used), np.int64)      # byte -> symbol; the last is "never seen"
        self.symbol[used] = np.arange(len(used))
        a = self.a = len(used) + 1
        s = [self.symbol[gram >> k & 255] for k in (24, 16, 8, 0)]

        def level(context: np.ndarray, parent: np.ndarray, below: np.ndarray) -> np.ndarray:
            """Distributions [context, symbol, language] escaping to ``below[parent]``."""
            m = len(parent)
            c = np.zeros((m, a, size))
            keep = context >= 0
            np.add.at(c, (context[keep], s[3][keep], which[keep]), n[keep])
            total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            lower = below[parent]
            unseen = np.where(c > 0, 0.0, lower)
            left = unseen.sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(left > 0, distinct / (total + distinct), 0.0)
                p = np.where(c > 0, c / np.where(left > 0, total + distinct, total), escape * unseen / left)
            return np.where(total > 0, p, lower)

        # Contexts of one to three bytes compete for the room by how often they occur.  A context occurs no
        # more often than the shorter one it ends with, which comes first among ties, so the chosen form trees.
        two = s[1] * a + s[2]
        contexts = [s[2], two, s[0] * (a * a) + two]
        seen, often = zip(*(np.unique(c, return_inverse=True) for c in contexts))
        weight = [np.bincount(at, n, len(c)) for c, at in zip(seen, often)]
        order = np.repeat([1, 2, 3], [len(c) for c in seen])
        room = max(0, table_bytes // (a * size * 4) - 1)
        taken = np.zeros(len(order), bool)
        taken[np.lexsort((np.concatenate(seen), order, -np.concatenate(weight)))[:room]] = True
        one, two_, three = (c[taken[order == k]] for k, c in zip((1, 2, 3), seen))

        def place(values: np.ndarray, among: np.ndarray) -> np.ndarray:
            """Position of every value in the sorted ``among``; -1 if it is not there."""
            if not len(among):
                return np.full(len(values), -1, np.int64)
            at = np.minimum(np.searchsorted(among, values), len(among) - 1)
            return np.where(among[at] == values, at, -1)

        p0 = level(np.zeros(len(gram), np.int64), np.zeros(1, np.int64), np.full((1, a, size), 1.0 / a))
        p1 = level(place(contexts[0], one), np.zeros(len(one), np.int64), p0)
        p2 = level(place(contexts[1], two_), place(two_ % a, one), p1)
        p3 = level(place(contexts[2], three), place(three % (a * a), two_), p2)
        # one table: the empty context, then nodes of order 1, 2 and 3; `node3` leads from (order-2 node, byte before it)
        self.cost = -np.log2(np.concatenate([p0, p1, p2, p3])).astype(np.float32)
        self.cost[:, a - 1] += 8.0
        self.first2 = 1 + len(one)
        self.node1 = np.zeros(a, np.int64)
        self.node1[one] = np.arange(len(one)) + 1
        self.node2 = np.full(a * a, -1, np.int64)
        self.node2[two_] = np.arange(len(two_))
        self.node3 = np.full((len(two_) + 1, a), -1, np.int32)
        self.node3[self.node2[three % (a * a)], three // (a * a)] = np.arange(len(three)) + self.first2 + len(two_)

    def bits(self, text: str) -> np.ndarray:
        """Code length of the whole text under each language."""
        out = np.zeros(len(self.langs))
        data = _bytes(text)
        for i in range(ORDER, len(data), 1 << 18):           # whole text, in pieces of bounded memory
            x = self.symbol[data[i - ORDER:i + (1 << 18)]]
            n2 = self.node2[x[1:-2] * self.a + x[2:-1]]
            node = self.node3[n2, x[:-3]]
            node = np.where((n2 >= 0) & (node >= 0), node, np.where(n2 >= 0, n2 + self.first2, self.node1[x[2:-1]]))
            out += self.cost[node, x[3:]].sum(0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        bits = self.bits(text)
        best = int(bits.argmin())
        score = 1.0 / float(np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum())
        return self.langs[best], score, float(bits[best]) / max(1, len(text.encode("utf-8", "replace")))


def identify(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang",
             doc_id: str = "doc_id", sample_bytes: int = SAMPLE_BYTES, out: str = "langid") -> DataFrame:
    """Adds ``out`` = struct(lang_pred, score, bits_per_byte) to every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = [tuple(r) for r in train_counts(docs, train, text, lang, doc_id, sample_bytes).collect()]
    trees = spark.sparkContext.broadcast(ContextTrees(counts))   # bounded by TABLE_BYTES

    def make():
        model = trees.value
        return lambda texts: [model.predict(t) for t in texts]
    return docs.withColumn(out, text_udf(make, VERDICT)(text))


def split_training(doc_id: str = "doc_id") -> Column:
    """Rows that may be learned from: remainder of the id's crc32 by 3 is not 1."""
    return crc_mod(doc_id, 3) != 1
