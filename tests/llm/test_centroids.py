"""Clustering against plain integer loops, beyond the bounds of doubles and of 64 bits too."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import centroids

DIMS = 4
SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, k int"


def slow(vectors, k, rounds, dims, scale, seed):
    """{vec_id: (cluster, distance)}, centroids and inertia, by loops over Python's integers; ids must differ."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    cs = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(cs)]
    return [(i, *reversed(near(v))) for i, v in kept], cs


def vectors(seed, n, size):
    r = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(r.gauss(0, size) if i % 3 else r.choice([-1, 0, 1]) * size) for _ in range(DIMS)]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [1.0] * (DIMS + 1)), (n + 3, [1.0, None, 1.0, 1.0]), (n + 4, [math.nan, 1.0, 1.0, 1.0]), (n + 5, [math.inf, 1.0, 1.0, 1.0])]
    return rows + [(n + 6, rows[0][1]), (n + 7, rows[0][1]), (None, rows[1][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [1, 1e5, 1e8, 1e12, 1e30])
def test_every_size_of_component(spark, size):
    rows = vectors(1, 40, size)
    if size == 1e12:  # rows of all magnitudes meet
        rows = vectors(2, 30, 1) + [(100 + i, v) for i, v in vectors(3, 30, 1e30) if i is not None]
    got, want = centroids.fit(frame(spark, rows), k=5, rounds=3, dims=DIMS), slow(rows, 5, 3, DIMS, 64, 1)
    assert got.rows == want[1]
    out = centroids.assign(frame(spark, rows), got).collect()
    fits = lambda x: x if x < 1 << 63 else None
    assert sorted(map(repr, ((r.vec_id, r.cluster, r.distance) for r in out))) == sorted(map(repr, ((i, c, fits(d)) for i, c, d in want[0])))
    for r in out:
        assert r.cluster_inertia == fits(sum(d for _, c, d in want[0] if c == r.cluster))
        assert r.inertia == fits(sum(d for *_, d in want[0]))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, want[1][r.cluster])).encode()).hexdigest()


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.0] * DIMS) for i in range(6)] + [(9, [1.0] * DIMS)]
    got, want = centroids.fit(frame(spark, rows), k=4, rounds=2, dims=DIMS), slow(rows, 4, 2, DIMS, 64, 1)
    assert got.rows == want[1]
    assert sorted((r.vec_id, r.cluster, r.distance) for r in centroids.assign(frame(spark, rows), got).collect()) == sorted(want[0])


def test_few_vectors_and_none(spark):
    few = [(1, [0.5] * DIMS), (2, [-0.5] * DIMS)]
    assert len(centroids.fit(frame(spark, few), k=16, dims=DIMS).rows) == 2
    none = frame(spark, [])
    model = centroids.fit(none, dims=DIMS)
    assert model.rows == [] and centroids.assign(none, model).collect() == []
    assert "centroid_sha256" in centroids.assign(none, model).columns


def test_grid_and_bounds():
    column = pa.array([[0.5, -0.01], [1.0], None, [math.nan, 1.0], [2.0, 3.0]], pa.list_(pa.float32()))
    at, x = centroids.on_grid(column, 2, 64)
    assert at.tolist() == [0, 4] and x.tolist() == [[32, -1], [128, 192]]
    at, x = centroids.on_grid(column.slice(3), 2, 64)
    assert at.tolist() == [1] and x.tolist() == [[128, 192]]
    for dims in (1, 2, 64, 4096):
        assert dims * (2 * centroids.float_bound(dims)) ** 2 < 2**53 and dims * (2 * centroids.long_bound(dims)) ** 2 < 2**63
