"""Connected components by alternating large-star and small-star rounds.

Each round is a minimum per node and a join, so neither a node's neighbours nor a
component is ever gathered in one task; a round's edges are written to the shared
folder, which cuts lineage.  The number of rounds is logarithmic in the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours (larger ones, or the smaller ones and itself) at the smallest."""
    if large:
        arcs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))   # node a, neighbour b
    else:
        arcs = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))                # smaller neighbours only
    least = arcs.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
    moved = arcs.join(least, arcs.a == least.n)
    if large:
        out = moved.filter("b > a").select(F.col("m").alias("a"), "b")
    else:
        out = moved.select(F.col("m").alias("a"), "b").union(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
    return out.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a < b)."""
    while True:
        mark = _fingerprint(edges)
        if not mark[0]:
            break
        edges = scratch(_star(scratch(_star(edges, True), "star"), False), "star")
        if _fingerprint(edges) == mark:
            break
    return (edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    r = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first()
    return r[0], r[1], r[2]
