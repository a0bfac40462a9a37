"""Centroid clustering with n-simplex projection.

Vectors become integer vectors; centroids are integer vectors.  A few of the first centroids
serve as pivots.  The pivots span a simplex, built from their pairwise distances alone (the
Cholesky factor of their Gram matrix).  A vector's distances to the pivots make it the apex over
that base: its coordinates inside the base and its altitude above it.  Between two apexes

* the Euclidean distance is a lower bound of the true distance, and
* with the altitudes on opposite sides of the base it is an upper bound.

Every vector's apex is computed once, from its distances to the pivots, and cached in a table
beside the vector.  In each round a task compares apexes, drops every centroid whose lower bound
lies above the least upper bound (with a margin for rounding), and compares the others with the
vector in exact integers.  A task returns the sums and counts of its clusters, Spark adds them, and
the driver divides them: k x dimensions numbers a round, whatever the size of the table.

Defined results: vectors that are null, of another length, or hold null or non-finite components
are left out; repeated rows count again; a null id reads as empty text in the order of the first
centroids, and equal hashes (repeated ids) are ordered by their vectors; fewer vectors than
centroids make fewer centroids; ties of distance go to the smaller number; an empty table gives an
empty result; further columns aren't read.  Components of 2^19 or more, whose squared distances
would not fit a 64-bit integer, are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let_workers_import, scratch

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SEED = 2
SCALE = 256
PIVOTS = 8
#: Bounds are compared with this margin, relative to the distances.
MARGIN = 1e-6
#: Vectors compared at a time.
BLOCK = 4096
_LIMIT = 1 << 27


def integer_vectors(col: pa.Array, dims: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their integer vectors) of a list column."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(col), dims), False)))
    flat = col.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(flat).all(1)                              # nulls have become NaN
    found = np.floor(SCALE * flat[fine])
    if found.size and np.abs(found).max() >= _LIMIT:
        raise ValueError("a component is too large for exact 64-bit distances")
    return rows[fine], found.astype(np.int64)


class Simplex:
    """The base simplex over pivots (integer rows), and apexes over it."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        """Takes up to ``most`` pivots among ``points``: each time the one farthest from the span so far."""
        sq = _squares(points, points).astype(float)
        taken, coords, rest = [0], np.zeros((len(points), 0)), sq[0].copy()
        while len(taken) < min(most, len(points)):
            far = int(rest.argmax())
            if rest[far] <= 1e-3 * max(sq.max(), 1.0):
                break
            gram = (sq[0][far] + sq[0] - sq[far]) / 2
            col = (gram - coords @ coords[far]) / np.sqrt(rest[far])
            coords = np.column_stack([coords, col])
            rest = np.maximum(rest - col ** 2, 0)
            taken.append(far)
        self.pivots = points[taken]
        self.base = coords[taken[1:]]                            # lower triangular: vertices of the base
        self.legs = sq[0][taken[1:]]                             # squared distances to the first pivot

    def apexes(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of each row of ``x``: inside the base, then the altitude."""
        d = np.sqrt(_squares(x, self.pivots).astype(float))      # all that is known of x
        g = (self.legs + d[:, :1] ** 2 - d[:, 1:] ** 2) / 2
        y = np.linalg.solve(self.base, g.T).T if len(self.base) else np.zeros((len(x), 0))
        return np.column_stack([y, np.sqrt(np.maximum(d[:, 0] ** 2 - (y ** 2).sum(1), 0))])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def candidates(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centroids (apexes ``centres``) the bounds leave to each vector."""
    flat = sum((apexes[:, None, i] - centres[None, :, i]) ** 2 for i in range(apexes.shape[1] - 1))
    low = np.sqrt(flat + (apexes[:, None, -1] - centres[None, :, -1]) ** 2)
    high = np.sqrt(flat + (apexes[:, None, -1] + centres[None, :, -1]) ** 2)
    best = high.min(1, keepdims=True)
    return low <= best + MARGIN * (1 + best + np.abs(apexes[:, -1:]) + np.abs(centres[:, -1]))


def nearest(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of ``x``."""
    number, least = np.full(len(x), -1, np.int32), np.full(len(x), np.iinfo(np.int64).max)
    for i in range(0, len(x), BLOCK):
        part, open_ = x[i:i + BLOCK], candidates(apexes[i:i + BLOCK], centres)
        for c in range(len(centroids)):
            at = np.flatnonzero(open_[:, c])
            d = ((part[at] - centroids[c]) ** 2).sum(1)
            nearer = d < least[i + at]
            number[i + at[nearer]], least[i + at[nearer]] = c, d[nearer]
    return number, least


def _lists(flat: np.ndarray) -> pa.ListArray:
    n, width = flat.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(flat.ravel()))


def _matrix(col: pa.Array, kind) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1).astype(kind)


def _over(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: np.ndarray):
    centres = simplex.apexes(centroids)
    for b in batches:
        if b.num_rows:
            x = _matrix(b.column("v"), np.int64)
            yield b, x, *nearest(x, _matrix(b.column("apex"), float), centroids, centres)


def _prepared(vectors: DataFrame, simplex: Simplex, dims: int) -> DataFrame:
    """(vec_id, v, apex): integer vectors with their cached apexes."""
    def project(batches):
        for b in batches:
            rows, x = integer_vectors(b.column(1), dims)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), _lists(x.astype(np.int32)), _lists(simplex.apexes(x))],
                    ["vec_id", "v", "apex"])
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(project, f"vec_id {kind}, v array<int>, apex array<double>")


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, dims: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of seed and id: the only rows that reach the driver."""
    def keep(batches):
        for b in batches:
            rows, x = integer_vectors(b.column(1), dims)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), _lists(x)], ["vec_id", "v"])
    kind = vectors.schema["vec_id"].dataType.simpleString()
    kept = vectors.mapInArrow(keep, f"vec_id {kind}, v array<long>")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), dims)


def _moved(table: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """One round: the centroids after every vector joined its nearest one."""
    k, dims = centroids.shape

    def sums(batches):
        total = np.zeros((k, dims + 1), np.int64)
        for _, x, number, _ in _over(batches, simplex, centroids):
            order = np.argsort(number, kind="stable")
            found, begin = np.unique(number[order], return_index=True)
            total[found, :dims] += np.add.reduceat(x[order], begin, axis=0)
            total[:, dims] += np.bincount(number, minlength=k)
        c = np.flatnonzero(total[:, dims])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(c, dims + 1)), pa.array(np.tile(np.arange(dims + 1), len(c))), pa.array(total[c].ravel())],
            ["cluster", "dim", "part"])
    added = (table.select("v", "apex").mapInArrow(sums, "cluster long, dim long, part long")
             .groupBy("cluster", "dim").agg(F.sum("part").alias("total")).collect())        # k x (dims + 1) numbers
    out, count = centroids.copy(), {r.cluster: r.total for r in added if r.dim == dims}
    for r in added:
        if r.dim < dims:
            out[r.cluster, r.dim] = r.total // count[r.cluster]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMENSIONS, seed: int = SEED,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    let_workers_import(spark)
    vectors = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding"))
    centroids = first_centroids(vectors, k, dims, seed)
    kind = vectors.schema["vec_id"].dataType
    if not len(centroids):
        empty = T.StructType([T.StructField("vec_id", kind)])
        return spark.createDataFrame([], empty).selectExpr(
            "vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    simplex = Simplex(centroids)
    table = scratch(_prepared(vectors, simplex, dims), "centroid-vectors")
    for _ in range(rounds):
        centroids = _moved(table, simplex, centroids)

    def assign(batches):
        for b, _, number, least in _over(batches, simplex, centroids):
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(number), pa.array(least)],
                                             ["vec_id", "cluster", "distance"])
    done = scratch(table.mapInArrow(assign, f"vec_id {kind.simpleString()}, cluster int, distance long"), "centroid-clusters")
    inertia = {r.cluster: r.s for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}   # <= k rows
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    facts = spark.createDataFrame([(c, s, sum(inertia.values()), digest[c]) for c, s in sorted(inertia.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(      # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
