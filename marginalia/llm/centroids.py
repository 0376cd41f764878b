"""Clustering around centroids in exact integers, by matrix products.

Vectors are put on a grid: component x becomes floor(scale * x), which doubles hold exactly for powers of two.
Squared distances come from |x|^2 - 2 x.c + |c|^2, in blocks, by one matrix product of doubles a block. The magnitude
of a row and of a centroid bounds every partial sum: up to `float_bound` all of them are integers below 2^53, so BLAS adds
them in any order without rounding. Larger rows or centroids take 64-bit integers, still larger ones Python's.
Each round is one pass: tasks add up their vectors by centroid, and treeAggregate adds up the tasks' sums, so what
reaches the driver is k sums a branch, whatever the input. Vectors are read anew each round; nothing is kept of them.

Edge cases: vectors that are null, of another length, or with a component that is null or not finite are left out. Equal
vectors, equal ids and null ids are vectors each for themselves; among equal hashes the lesser vector starts first, null ids start
last. Fewer vectors than k: as many centroids as there are vectors; none: no rows. A distance or inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 14  # vectors of a matrix product at most
MOST_LONG = (1 << 63) - 1


def float_bound(dims: int) -> int:
    """Magnitude of components up to which (|x| + |c|)^2, summed over `dims`, stays below 2^53."""
    return int(np.floor(np.sqrt(2.0**53 / max(dims, 1)) / 2)) - 1


def long_bound(dims: int) -> int:
    return int(np.floor(np.sqrt(2.0**62 / max(dims, 1)) / 2)) - 1


def on_grid(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix): which rows hold a vector of `dims` finite components, and floor(scale * x) of them in doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    flat = column.take(pa.array(at)).flatten()
    x = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims) * float(scale))  # nulls are NaN here
    whole = np.isfinite(x).all(1)
    return at[whole], x[whole]


def as_objects(x: np.ndarray) -> np.ndarray:
    """Integers in doubles as Python's integers."""
    out = np.empty(x.shape, object)
    out.flat = [int(v) for v in x.flat]
    return out


class Centroids:
    """Centroids as Python integers, grouped by the arithmetic that their magnitude allows."""

    def __init__(self, rows: list[list[int]], dims: int):
        self.rows, self.dims = rows, dims
        self.exact = np.empty((len(rows), dims), object)
        for i, row in enumerate(rows):
            self.exact[i] = row
        top = [max(map(abs, row), default=0) for row in rows]
        fits = lambda bound: np.array([t <= bound for t in top], bool)
        self.floats, self.longs = fits(float_bound(dims)), fits(long_bound(dims))
        self.f64 = self.exact[self.floats].astype(np.float64)  # used only where all centroids fit
        self.f64_norm = (self.f64**2).sum(1)
        self.i64 = self.exact[self.longs].astype(np.int64)

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.rows[i])).encode()).hexdigest()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """(cluster, squared distance) of each row of integers in doubles; ties go to the smaller number."""
        top = np.abs(x).max(1, initial=0)
        small = (top <= float_bound(self.dims)) & self.floats.all()
        if small.all():
            return self._by_product(x)
        middle = ~small & (top <= long_bound(self.dims)) & self.longs.all()
        cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), object)
        if small.any():
            cluster[small], distance[small] = self._by_product(x[small])
        rest = np.flatnonzero(middle)
        for part in (rest[i : i + 1024] for i in range(0, len(rest), 1024)):
            d = ((x[part].astype(np.int64)[:, None, :] - self.i64[None]) ** 2).sum(2)
            cluster[part], distance[part] = d.argmin(1), d.min(1)
        for i in np.flatnonzero(~small & ~middle):
            d = ((as_objects(x[i : i + 1]) - self.exact) ** 2).sum(1).tolist()
            cluster[i], distance[i] = d.index(min(d)), min(d)
        return cluster, distance

    def _by_product(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x @ self.f64.T
        d *= -2
        d += self.f64_norm
        cluster = d.argmin(1).astype(np.int32)  # the first of equals; |x|^2 is the same for all
        return cluster, (d[np.arange(len(x)), cluster] + (x**2).sum(1)).astype(np.int64)


Sums = dict[int, tuple[int, list[int], int]]  # by centroid: vectors, their componentwise sum, their squared distances


def add(a: Sums, b: Sums) -> Sums:
    for k, (n, total, inertia) in b.items():
        m, old, before = a.get(k, (0, [0] * len(total), 0))
        a[k] = (m + n, [x + y for x, y in zip(old, total, strict=True)], before + inertia)
    return a


def block_sums(x: np.ndarray, centroids: Centroids) -> Sums:
    cluster, distance = centroids.nearest(x)
    out: Sums = {}
    exact = np.abs(x).max(initial=0) * max(len(x), 1) < 2**53
    for k in np.unique(cluster).tolist():
        own = cluster == k
        total = x[own].sum(0).astype(np.int64).tolist() if exact else as_objects(x[own]).sum(0).tolist()
        out[k] = (int(own.sum()), total, sum(map(int, distance[own])))
    return out


def _kept(vectors: DataFrame, vec_col: str) -> DataFrame:
    return vectors.select(F.col(vec_col).alias("v"))


def round_sums(vectors: DataFrame, centroids: Centroids, vec_col: str, scale: float) -> Sums:
    """Every vector assigned to its nearest centroid, and the sums of each."""
    shared, dims = vectors.sparkSession.sparkContext.broadcast(centroids.rows), centroids.dims

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Centroids(shared.value, dims), {}
        for b in batches:
            x = on_grid(b.column("v"), dims, scale)[1]
            for i in range(0, len(x), BLOCK):
                total = add(total, block_sums(x[i : i + BLOCK], own))
        if total:
            ks = sorted(total)
            told = {"k": pa.array(ks, pa.int32()), "n": pa.array([total[k][0] for k in ks], pa.int64()), "inertia": pa.array([str(total[k][2]) for k in ks])}
            yield pa.record_batch(told | {"total": pa.array([list(map(str, total[k][1])) for k in ks], pa.list_(pa.string()))})

    # Integers travel as decimals, as sums may outgrow 64 bits.
    tasks = _kept(vectors, vec_col).mapInArrow(each, "k int, n long, inertia string, total array<string>").rdd
    one = lambda a, r: add(a, {r["k"]: (r["n"], list(map(int, r["total"])), int(r["inertia"]))})
    return tasks.treeAggregate({}, one, add)


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: float, seed: int, id_col: str, vec_col: str) -> Centroids:
    """The k kept vectors with the smallest SHA-256 of `seed:id`, in the hash's order."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    grid = F.transform(v, lambda x: x.cast("double"))
    rows = vectors.where((F.size(v) == dims) & finite).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("h"), grid.alias("v"))
    picked = rows.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return Centroids([[int(np.floor(x * scale)) for x in r["v"]] for r in picked], dims)


def fit(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> Centroids:
    """Centroids after `rounds` of assigning and averaging; an average is the floor of the exact quotient, an empty centroid stays."""
    centroids = first_centroids(vectors, k, dims, scale, seed, id_col, vec_col)
    for _ in range(rounds if centroids.rows else 0):
        sums = round_sums(vectors, centroids, vec_col, scale)
        moved = [[t // sums[i][0] for t in sums[i][1]] if i in sums else row for i, row in enumerate(centroids.rows)]
        if moved == centroids.rows:
            break  # further rounds would give the same
        centroids = Centroids(moved, dims)
    return centroids


def assign(vectors: DataFrame, centroids: Centroids, scale: float = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): one row for each kept vector."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids.rows:
        return vectors.sparkSession.createDataFrame([], schema)
    sums, dims, count = round_sums(vectors, centroids, vec_col, scale), centroids.dims, len(centroids.rows)
    fits = lambda x: x if x <= MOST_LONG else None
    inertia = [fits(sums[i][2]) if i in sums else None for i in range(count)]
    total = fits(sum(s[2] for s in sums.values()))
    shared = vectors.sparkSession.sparkContext.broadcast((centroids.rows, inertia, total, [centroids.digest(i) for i in range(count)]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, own, total, digests = shared.value
        near, own, digests = Centroids(rows, dims), pa.array(own, pa.int64()), pa.array(digests)
        for b in batches:
            at, x = on_grid(b.column("v"), dims, scale)
            for i in range(0, len(x), BLOCK):
                part = pa.array(at[i : i + BLOCK])
                cluster, distance = near.nearest(x[i : i + BLOCK])
                cluster = pa.array(cluster)
                distance = pa.array(distance) if distance.dtype != object else pa.array([fits(d) for d in distance], pa.int64())
                told = {"vec_id": b.column("vec_id").take(part), "cluster": cluster, "distance": distance}
                yield pa.record_batch(told | {"cluster_inertia": own.take(cluster), "inertia": pa.array([total] * len(part), pa.int64()), "centroid_sha256": digests.take(cluster)})

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).mapInArrow(each, schema)
