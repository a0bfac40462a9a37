"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of documents.  A window of ``WINDOW`` tokens grants each
queue its target share (its quantum); a queue sends documents as long as its balance
is positive, and what a document took beyond the balance is carried as a deficit into
the next windows.  Served that way, a document whose queue has sent ``P`` tokens
before it goes out in window ``floor(P / quantum)``: the deficit after any number of
windows, also over partition borders, is the difference of two running sums.  So the
rounds are computed with prefix sums instead of being replayed:

1. token counts by source and hash segment (segments sized to a bounded number of
   rows, so that a source with a third of all documents is spread over many tasks);
2. running sums over the segments of a source, then over the documents in a segment;
3. the window of every document; running sums over (window, source) give each
   document's place in the whole order of windows;
4. the order is cut into sequences every ``SEQUENCE`` tokens; a document that crosses
   a cut is divided into pieces.

Only the last sequence is shorter than ``SEQUENCE``.  By default a source's target is
its share of all tokens, so that every window holds the corpus mixture and all queues
end together; with other targets a queue that ends early leaves its share to the
rest, since a window without it is simply shorter.

Defined results: a null text is empty and has only its end token; a null source is a
queue of its own; repeated rows (equal doc_id) are separate documents; one document
longer than a window is served whole, its deficit being paid back over the next
windows; an empty table packs into no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, small_batches, text_udf
from .wordbpe import VOCABULARY, load

SEQUENCE = 4096
WINDOW = 16 * SEQUENCE
END_ID = 2
SEGMENT_ROWS = 5_000

_IDS = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n", T.LongType())])
_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                                    T.StructField("ids_crc32", T.LongType()),
                                    T.StructField("sequence_id", T.LongType()),
                                    T.StructField("offset", T.LongType()),
                                    T.StructField("ids", T.BinaryType())]))
_CUT = T.StructType([T.StructField("pieces", _PIECES)])


def _narrow(ids: bytes, wide: bool) -> bytes:
    """Stored form of 32-bit ids: 16 bits where the vocabulary allows it."""
    return ids if wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _widen(stored: bytes, n: int) -> bytes:
    return stored if len(stored) == 4 * n else np.frombuffer(stored, "<u2").astype("<u4").tobytes()


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
              vocabulary: str | None = None) -> DataFrame:
    """(row, doc_id, source, n, ids): every document's ids with the end id, written once."""
    small_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    last = END_ID.to_bytes(4, "little")

    def make():
        bpe = load(path, by_library=True)

        def run(texts):
            out = []
            for t in texts:
                ids = bpe.encode(t) + last
                out.append((_narrow(ids, bpe.wide), len(ids) // 4))
            return out
        return run
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       text_udf(make, _IDS)(text).alias("t"))
    # the written row number tells repeated rows apart; it is stable because it is read back
    return scratch(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source",
                               F.col("t.n").alias("n"), F.col("t.ids").alias("ids")), "packing-ids")


def _running(df: DataFrame, total: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """Sum of ``total`` over the rows before this one (0 for the first)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(total).over(w), F.lit(0)))


def _running_all(df: DataFrame, keys: list[str], total: str, out: str, block: int) -> DataFrame:
    """Sum of ``total`` over all rows with smaller ``keys``: blocks of the first key, then inside them.

    Blocks hold ``block`` values of the first key, and block totals are summed the same
    way until one block is left, so no task sees more than a bounded number of rows.
    """
    name = f"block_of_{keys[0]}"
    blocked = df.withColumn(name, F.floor(F.col(keys[0]) / block))
    sums = blocked.groupBy(name).agg(F.sum(total).alias("block_total"))
    inner = _running(blocked, total, [name], keys, out)
    if not sums.agg(F.max(name)).first()[0]:                 # one block, or no row
        return inner.drop(name)
    carried = f"before_{name}"                               # a name of its own at every level
    before = _running_all(sums, [name], "block_total", carried, 1000).select(F.col(name).alias("block_key"), carried)
    return (inner.join(before, inner[name] == before["block_key"])
            .withColumn(out, F.col(out) + F.col(carried)).drop(name, "block_key", carried))


def _shares(sources: DataFrame, targets: Mapping[str, float] | None) -> Column:
    if targets is None:
        return F.col("tokens")                               # windows keep the corpus mixture
    weight = F.lit(0.0)
    for name, value in targets.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    return weight


def schedule(tokens: DataFrame, window: int = WINDOW, targets: Mapping[str, float] | None = None,
             segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(row, place): first token of each document in the order of all windows.

    ``targets`` weighs the sources; sources without a weight follow after the last window.
    """
    light = tokens.select("row", "source", "n")
    sources = light.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))
    weighed = sources.withColumn("weight", _shares(sources, targets).cast("double"))
    whole = weighed.agg(F.sum("weight")).first()[0] or 0.0   # one number
    plan = weighed.select(F.col("source").alias("s"), "weight",
                          F.ceil(F.col("rows") / segment_rows).alias("segments"))
    light = light.join(plan, light.source.eqNullSafe(plan.s)).select("row", "source", "n", "weight", "segments")
    light = light.withColumn("segment", F.pmod(F.xxhash64("row"), F.col("segments")))
    totals = light.groupBy("source", "segment").agg(F.sum("n").alias("n"))
    totals = _running(totals, "n", ["source"], ["segment"], "before").select(
        F.col("source").alias("ts"), F.col("segment").alias("tseg"), "before")
    inside = _running(light, "n", ["source", "segment"], ["row"], "inside")
    queued = inside.join(totals, inside.source.eqNullSafe(totals.ts) & (inside.segment == totals.tseg))
    sent = (F.col("before") + F.col("inside")).cast("double")
    rounds = F.when(F.col("weight") > 0, F.floor(sent * F.lit(whole) / F.col("weight") / F.lit(window)))
    queued = scratch(queued.select("row", "source", "n", (F.col("before") + F.col("inside")).alias("sent"),
                                   rounds.alias("w")), "packing-queues")
    last = queued.agg(F.max("w")).first()[0]
    after = 0 if last is None else last + 1
    queued = queued.withColumn("w", F.coalesce("w", F.lit(after)
                                               + F.floor(F.col("sent") / F.lit(window))))
    # place of a document: windows before, sources before in its window, documents before in its source
    served = queued.groupBy("w", "source").agg(F.sum("n").alias("n"), F.min("sent").alias("opened"))
    served = _running_all(scratch(served, "packing-windows"), ["w", "source"], "n", "base", 16).select(
        F.col("w").alias("sw"), F.col("source").alias("ss"), "base", "opened")
    placed = queued.join(served, (queued.w == served.sw) & queued.source.eqNullSafe(served.ss))
    return placed.select("row", (F.col("base") + F.col("sent") - F.col("opened")).alias("place"),
                         F.col("w").alias("window"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         sequence: int = SEQUENCE, window: int = WINDOW, targets: Mapping[str, float] | None = None,
         vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, source, window, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with ``keep_ids``, the piece's ids (little-endian 32-bit)."""
    tokens = tokenized(docs, doc_id, text, source, vocabulary)
    places = schedule(tokens, window, targets).withColumnRenamed("row", "r")

    def make():
        def run(stored, lengths, starts):
            out = []
            for ids, n, place in zip(stored, lengths, starts):
                ids, at, pieces = _widen(ids, n), 0, []
                while at < n:
                    seq, offset = divmod(place + at, sequence)
                    take = min(n - at, sequence - offset)
                    part = ids[4 * at:4 * (at + take)]
                    pieces.append({"start": at, "length": take, "ids_crc32": zlib.crc32(part),
                                   "sequence_id": seq, "offset": offset, "ids": part if keep_ids else None})
                    at += take
                out.append((pieces,))
            return out
        return run
    cut = tokens.join(places, tokens.row == places.r).select(
        "doc_id", "source", "window", F.col("n").alias("doc_tokens"), text_udf(make, _CUT)("ids", "n", "place").alias("c"))
    cols = ["start", "length", "ids_crc32", "sequence_id", "offset"] + (["ids"] if keep_ids else [])
    return (cut.select("doc_id", "source", "window", "doc_tokens", F.explode("c.pieces").alias("p"))
            .select("doc_id", "source", "window", "doc_tokens", *[f"p.{c}" for c in cols]))
