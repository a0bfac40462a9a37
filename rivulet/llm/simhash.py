"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of 32 two-bit segments.  The
Manhattan distance of two embeddings is a lower bound of the bit distance of the
fingerprints, so a range join in the embedded space loses no pair:

* the 32 coordinates are cut into ``GROUPS`` = 2 halves; within a total distance of
  2 at least one half lies within distance 1 (in general floor(d / groups));
* each half is a grid cell of width 1; a fingerprint looks into its own cell and into
  those at distance 1 in which one count is higher.  Every close pair meets in a
  cell that way, from the smaller side;
* the join condition keeps pairs whose whole Manhattan distance is within the bound,
  then the exact bit distance is verified.

Equal fingerprints are one node, so exact copies never form pairs.  Links between
different fingerprints are joined into components (``components``), whose smallest
doc_id labels all its documents.

Defined results: null or empty texts, or texts without a word, have fingerprint zero
and are linked like any other; fewer words than the shingle length make one shingle;
bits set in exactly half of the shingles are 0; repeated rows get equal fingerprints;
an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components
from .common import scratch, small_batches, text_udf

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SEGMENT_BITS = 2
GROUPS = 2

_FP = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()   # bytes: ASCII case and white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    total = len(words) - shingle + 1
    for i in range(0, total, 1 << 16):                       # votes of a long text in blocks
        part = words[i:i + (1 << 16) + shingle - 1]
        runs = zip(*[part[k:] for k in range(shingle)])
        n = len(part) - shingle + 1
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in runs), np.dtype("<u8"), n)
        ones += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> Column:
    """Column of the signed 64-bit fingerprint of ``text``."""
    def make():
        def run(texts):
            return [(f - (1 << 64) if f >> 63 else f,) for f in (fingerprint(t, shingle) for t in texts)]
        return run
    return text_udf(make, _FP)(text)["fp"]


def _counts(fp: Column) -> Column:
    """Two-bit fields holding the bit counts (0-2) of the two-bit segments of ``fp``.

    A half adder per segment: no carry, so nothing overflows a signed long.
    """
    low = F.lit(0x5555555555555555).cast("long")
    one, other = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return F.shiftleft(one.bitwiseAND(other), 1).bitwiseOR(one.bitwiseXOR(other))


def _manhattan(a: Column, b: Column) -> Column:
    """Sum of |a_i - b_i| over two-bit counts.

    Each count in unary (0: 00, 1: 01, 2: 11) makes the difference a bit count.
    """
    def unary(c):
        return c.bitwiseOR(F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(0x5555555555555555).cast("long")))
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(nodes: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints ``fp`` within ``max_bits``."""
    fields = 64 // SEGMENT_BITS
    per = -(-fields // groups)
    reach = max_bits // groups
    if reach > 1:
        raise ValueError("cells are probed up to distance 1: use more groups for more bits")
    cells = nodes.select("fp", _counts(F.col("fp")).alias("counts"))
    homes, probes = [], []
    for g in range(groups):
        at = range(g * per, min(fields, (g + 1) * per))
        part = F.col("counts").bitwiseAND(F.lit(_signed(sum(3 << (2 * i) for i in at))).cast("long"))
        homes.append(F.struct(F.lit(g).alias("g"), part.alias("cell")))
        probes.append(F.struct(F.lit(g).alias("g"), part.alias("cell")))
        if reach:
            for i in at:                                     # one count higher, where it isn't full
                zero, one, two = (F.lit(_signed(v << (2 * i))).cast("long") for v in (0b01, 0b11, 0b10))
                higher = part.bitwiseXOR(F.when(part.bitwiseAND(zero) != 0, one).otherwise(zero))
                probes.append(F.when(part.bitwiseAND(two) == 0, F.struct(
                    F.lit(g).alias("g"), higher.alias("cell"))))
    left = (cells.select(F.col("fp").alias("x"), F.col("counts").alias("xc"), F.explode(F.array(*probes)).alias("c"))
            .filter("c is not null").select("x", "xc", "c.g", "c.cell"))
    right = cells.select(F.col("fp").alias("y"), F.col("counts").alias("yc"), F.explode(F.array(*homes)).alias("c")
                         ).select("y", "yc", "c.g", "c.cell")
    near = (_manhattan(F.col("xc"), F.col("yc")) <= max_bits) & (F.col("x") != F.col("y"))
    exact = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits
    return (left.join(right, ["g", "cell"]).filter(near & exact)
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def groups(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(key, root): the smallest fingerprint reachable from each fingerprint of ``nodes`` (fp, unique)."""
    found = scratch(links(nodes, max_bits), "simhash-links")
    roots = components.roots(found)                          # only fingerprints that have links
    return (nodes.join(roots, nodes.fp == roots.node, "left")
            .select(F.col("fp").alias("key"), F.coalesce("root", "fp").alias("root")))


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
            max_bits: int = MAX_BITS) -> DataFrame:
    """Per document: doc_id, fp (signed) and component_id, the smallest doc_id of its group."""
    small_batches(docs.sparkSession)
    prints = scratch(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text, shingle).alias("fp")),
                     "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    rooted = groups(nodes.select("fp"), max_bits)
    member = nodes.join(rooted, nodes.fp == rooted.key).select("key", "first", "root")
    heads = member.groupBy("root").agg(F.min("first").alias("component_id"))
    label = member.join(heads, "root").select("key", "component_id")
    return prints.join(label, prints.fp == label.key).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """The row with the smallest doc_id of every group (of repeated rows one), all columns."""
    small_batches(docs.sparkSession)
    rows = scratch(docs.select(F.monotonically_increasing_id().alias("row"),
                               F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                               fingerprints(docs, text, shingle).alias("fp")), "simhash-rows")
    first = F.min(F.struct(F.col("doc")[doc_id].alias("id"), "row")).alias("first")
    nodes = rows.groupBy("fp").agg(first)
    rooted = groups(nodes.select("fp"), max_bits)
    keep = (nodes.join(rooted, nodes.fp == rooted.key).groupBy("root").agg(F.min("first").alias("first"))
            .select(F.col("first.row").alias("keep")))
    return rows.join(keep, rows.row == keep.keep, "left_semi").select("doc.*")


def hexadecimal(fp: Column) -> Column:
    """16 lower-case hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
