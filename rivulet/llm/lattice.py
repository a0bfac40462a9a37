"""Embedding near-duplicates by lattice hashing.

Vectors of one label whose cosine reaches a threshold are linked.

* Equal vectors of a label form one class first, so copies never make pairs.
* Each of ``TABLES`` tables projects the unit vectors on two random orthonormal
  8-dimensional subspaces and decodes each projection to the nearest point of the E8
  lattice.  The pair of lattice points is the vector's home cell; its probes are the
  cells in which one of the points is replaced by one of the ``PROBES`` nearest
  neighbours (of 240) in the direction of the residue.
* Two vectors are candidates where the home of one is the home or a probe of the other.
  Only (class, cell) rows of 24 bytes are grouped for that; cells without a home or with
  one member go, and vectors travel only to the cells that are left.
* A cell's members are cut into blocks of about ``BLOCK``; each pair of blocks is
  compared by a matrix product in double precision.  A pair that meets in several
  cells counts only in its smallest common one.  Instead of all pairs, a block hands on
  the number of links per class and a spanning forest, so that dense groups stay linear.
* ``components`` joins the forests.

Everything found is verified, so no pair below the threshold is linked.  The share of
true links that the cells find is measured by the tests against brute force.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors with a null label, link with nothing and are their own
component; vectors of different length link with nothing; repeated rows are copies
that link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import components
from .common import scratch, text_udf

TABLES = 6
PROBES = 6
SCALE = 1.5
BLOCK = 512
THRESHOLD = 0.93
SEED = 20
#: Cells per vector and table: the home and the probes of both lattice points.
CELLS = 1 + 2 * PROBES
_ROWS_PER_BATCH = 2048


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if np.prod(s) > 0]
    return np.array(whole + half)


ROOTS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    f = np.rint(x)
    d = x - f
    odd = np.flatnonzero(f.sum(1) % 2 != 0)
    k = np.abs(d[odd]).argmax(1)
    f[odd, k] += np.where(d[odd, k] >= 0, 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 = D8 and D8 + (1/2, ..., 1/2), row by row."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@lru_cache(maxsize=16)
def _projections(dim: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, dim])
    wide = max(dim, 16)
    return np.stack([np.linalg.qr(rng.normal(size=(wide, 16)))[0] for _ in range(TABLES)])


@lru_cache(maxsize=1)
def _mixer() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 62, size=(TABLES, 16), dtype=np.int64) | 1


def cells(unit: np.ndarray) -> np.ndarray:
    """[vector, table, cell] 64-bit names of the cells; cell 0 is the home."""
    n, dim = unit.shape
    if dim < 16:
        unit = np.pad(unit, ((0, 0), (0, 16 - dim)))
    out = np.empty((n, TABLES, CELLS), np.int64)
    with np.errstate(over="ignore"):
        for t, q in enumerate(_projections(dim)):
            y = unit @ q * (SCALE * np.sqrt(max(dim, 16) / 8))
            mix = _mixer()[t]
            points = [nearest_e8(y[:, :8]), nearest_e8(y[:, 8:])]
            parts = [(np.rint(2 * p).astype(np.int64) * mix[8 * h:8 * h + 8]).sum(1) for h, p in enumerate(points)]
            out[:, t, 0] = parts[0] + parts[1] + t
            for h, p in enumerate(points):
                toward = (y[:, 8 * h:8 * h + 8] - p) @ ROOTS.T
                best = np.argpartition(-toward, PROBES, axis=1)[:, :PROBES]
                step = np.rint(2 * ROOTS).astype(np.int64) @ mix[8 * h:8 * h + 8]
                out[:, t, 1 + h * PROBES:1 + (h + 1) * PROBES] = out[:, t, :1] + step[best]
        out ^= out >> 31                                     # spread the low bits
    return out


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(1, keepdims=True)                     # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_KEYS = T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("homes", T.IntegerType())])


def _cell_column(column: str):
    """Struct of a vector's cells, each once (homes first), and the number of homes."""
    def once(k: np.ndarray) -> tuple:
        homes = set(k[:, 0].tolist())
        return [*homes, *(set(k[:, 1:].ravel().tolist()) - homes)], len(homes)

    def make():
        def run(vectors):
            out: list = [None] * len(vectors)
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for rows in by_dim.values():
                for first in range(0, len(rows), _ROWS_PER_BATCH):           # whatever the session's batches hold
                    at = rows[first:first + _ROWS_PER_BATCH]
                    for i, k in zip(at, cells(_unit([vectors[i] for i in at]))):
                        out[i] = once(k)
            return out
        return run
    return text_udf(make, _KEYS)(column)


def _first_common(kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    """Smallest cell in which the home of one vector meets a cell of the other."""
    top = np.iinfo(np.int64).max
    best = np.full(len(kx), top)
    for t in range(TABLES):
        for a, b in ((kx, ky), (ky, kx)):
            hit = (a[:, t, :1] == b[:, t]).any(1)
            best = np.where(hit, np.minimum(best, a[:, t, 0]), best)
    return best


def _compare(g: np.ndarray, key: np.ndarray, side: np.ndarray, mixed: np.ndarray, home: np.ndarray, cid: np.ndarray,
             size: np.ndarray, unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups (rows sorted by group): per-class counts and spanning edges."""
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    lengths = np.diff(np.r_[starts, len(g)])
    small = lengths <= 24
    left, right = [], []
    is_small = np.repeat(small, lengths)
    for k in range(1, int(lengths[small].max(initial=1))):   # pairs k rows apart, all small groups at once
        a = np.flatnonzero(is_small[:-k] & (g[:-k] == g[k:]))
        a = a[(home[a] | home[a + k]) & (~mixed[a] | (side[a] != side[a + k]))]
        for i in range(0, len(a), 50_000):
            p = a[i:i + 50_000]
            ok = p[np.einsum("ij,ij->i", unit[p], unit[p + k]) >= threshold]
            left.append(ok)
            right.append(ok + k)
    for s, n in zip(starts[~small], lengths[~small]):
        rows = np.arange(s, s + n)
        if mixed[s]:
            x, y = rows[side[rows] == 0], rows[side[rows] == 1]
            hit = unit[x] @ unit[y].T >= threshold
        else:
            x = y = rows
            hit = np.triu(unit[x] @ unit[y].T >= threshold, 1)
        hit &= home[x][:, None] | home[y][None, :]
        a, b = np.nonzero(hit)
        left.append(x[a])
        right.append(y[b])
    a = np.concatenate([*left, np.empty(0, np.int64)]).astype(np.int64)
    b = np.concatenate([*right, np.empty(0, np.int64)]).astype(np.int64)
    used, at = np.unique(np.r_[a, b], return_inverse=True)
    if not len(used):
        return np.empty((0, 2), np.int64), np.empty((0, 2), np.int64)
    named = cells(unit[used])                                # only for rows that have a partner
    ia, ib = at[:len(a)], at[len(a):]
    counted = np.concatenate([_first_common(named[ia[i:i + 20_000]], named[ib[i:i + 20_000]]) == key[a[i:i + 20_000]]
                              for i in range(0, len(a), 20_000)])
    n = np.bincount(ia[counted], size[b[counted]], len(used)) + np.bincount(ib[counted], size[a[counted]], len(used))
    who, where = np.unique(cid[used], return_inverse=True)
    links = np.stack([who, np.bincount(where, n).astype(np.int64)], 1)
    comp = np.arange(len(used))
    while True:                                              # smallest reachable row, within these groups
        m = np.minimum(comp[ia], comp[ib])
        before = comp.copy()
        np.minimum.at(comp, ia, m)
        np.minimum.at(comp, ib, m)
        comp = comp[comp]
        if (comp == before).all():
            break
    edges = np.unique(np.stack([cid[used], cid[used[comp]]], 1), axis=0)
    return links[links[:, 1] > 0], edges[edges[:, 0] != edges[:, 1]]


def _pair_rows(rows: DataFrame, threshold: float) -> DataFrame:
    """(edge, a, b) from rows sorted by group: a link count (edge false) or an edge."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(parts):
            return pa.Table.from_batches(parts).combine_chunks()

        def finish(t):
            if not t.num_rows:
                return
            label, key, lo, hi, mine = (t[c].to_numpy() for c in ("label", "key", "lo", "hi", "mine"))
            change = np.zeros(len(key), bool)
            for c in (label, key, lo, hi):
                change[1:] |= c[1:] != c[:-1]
            vectors = t["embedding"].combine_chunks()
            widths = np.diff(vectors.offsets.to_numpy())
            change[1:] |= widths[1:] != widths[:-1]          # rows of other length are another group
            g = np.cumsum(change)
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                flat = vectors.flatten().to_numpy(zero_copy_only=False) if len(at) == len(g) else np.concatenate(
                    [vectors[int(i)].values.to_numpy(zero_copy_only=False) for i in at])
                unit = _unit(flat.reshape(len(at), w))
                links, edges = _compare(g[at], key[at], (mine != lo)[at].astype(np.int8), (lo != hi)[at],
                                        t["home"].to_numpy(zero_copy_only=False)[at], t["cid"].to_numpy()[at],
                                        t["size"].to_numpy()[at], unit, threshold)
                for edge, x in ((False, links), (True, edges)):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), edge)), pa.array(np.ascontiguousarray(x[:, 0])),
                                                          pa.array(np.ascontiguousarray(x[:, 1]))], ["edge", "a", "b"])
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 4 * _ROWS_PER_BATCH:
                continue
            t = table(held)
            last = [t[c][n - 1].as_py() for c in ("label", "key", "lo", "hi")]
            same = np.logical_and.reduce([t[c].to_numpy() == v for c, v in zip(("label", "key", "lo", "hi"), last)])
            cut = int(n - same.sum())                        # the last group may go on in the next batch
            if cut:
                yield from finish(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
            n -= cut
        if held:
            yield from finish(table(held))
    return rows.mapInArrow(run, "edge boolean, a long, b long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    v = F.col("embedding")
    sound = (F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"),
                          ).withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = scratch(rows.filter("sound").groupBy("label", "embedding")
                      .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"))
                      .select(F.monotonically_increasing_id().alias("cid"), "label", "embedding", "first", "size"), "lattice-classes")
    # labels of any type become a number, so that rows of one label and cell can be compared in the tasks
    named = classes.select("cid", F.xxhash64("label").alias("label"), _cell_column("embedding").alias("c")).select(
        "cid", "label", F.col("c.homes").alias("homes"), F.posexplode("c.keys").alias("at", "key"))
    member = scratch(named.select("cid", "label", "key", (F.col("at") < F.col("homes")).alias("home")), "lattice-cells")
    full = (member.groupBy(F.col("label").alias("l"), F.col("key").alias("k"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).filter("n > 1 and any"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (member.join(full, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")))
              .select("cid", "label", "key", "home", F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("mine"), blocks.alias("blocks"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("cid", "label", "key", "home", "mine", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")))
    carried = placed.join(classes.select(F.col("cid").alias("c"), "embedding", "size"), F.col("cid") == F.col("c")).drop("c")
    # by range, so that the blocks of one dense group spread evenly: their hashes may meet in one partition
    carried = (carried.repartitionByRange("label", "key", "lo", "hi")
               .sortWithinPartitions("label", "key", "lo", "hi", F.size("embedding"), "cid"))
    found = scratch(_pair_rows(carried, threshold), "lattice-links")
    linked = found.filter("not edge").groupBy(F.col("a").alias("lc")).agg(F.sum("b").alias("links"))
    edges = found.filter("edge").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = components.roots(scratch(edges, "lattice-edges"))
    rooted = (classes.join(roots, F.col("cid") == F.col("node"), "left")
              .select("cid", "label", "embedding", "first", "size", F.coalesce("root", "cid").alias("root")))
    heads = rooted.groupBy(F.col("root").alias("hr")).agg(F.min("first").alias("component_id"))
    known = (rooted.join(heads, F.col("root") == F.col("hr")).join(linked, F.col("cid") == F.col("lc"), "left")
             .select(F.col("label").alias("kl"), F.col("embedding").alias("ke"), F.xxhash64("embedding").alias("kh"), "component_id",
                     (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")))
    out = rows.withColumn("h", F.xxhash64("embedding")).join(
        known, F.col("sound") & (F.col("h") == F.col("kh")) & (F.col("label") == F.col("kl")) & (F.col("embedding") == F.col("ke")), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
