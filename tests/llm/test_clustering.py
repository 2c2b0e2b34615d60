"""Clusters of vectors against k-means in plain integers."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from causeway.llm import clustering

from .conftest import FOLDER

FORM = "vec_id long, embedding array<float>"


def _brute(rows, k, rounds, dim, scale=64):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, tuple(math.floor(scale * float(np.float32(c))) for c in x)))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (at, _) in zip(kept, found) if at == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = [sum(d for at, d in found if at == c) for c in range(len(centroids))]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(repr((i, c, d, inertia[c], sum(inertia), shas[c])) for (i, _), (c, d) in zip(kept, found))


def _got(df):
    return sorted(repr(tuple(r)) for r in df.drop("compared").collect())


def test_clusters_equal_brute_force(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert _got(clustering.cluster_vectors(vectors)) == _brute(rows, 16, 3, 64)
    assert _got(clustering.cluster_vectors(vectors.repartition(5), k=5, rounds=6, pivots=2)) == _brute(rows, 5, 6, 64)


def test_odd_vectors_ties_and_clashes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [0.5, 0.5]), (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]),
        (7, [1e30, 0.0]), (8, [-0.01, 0.01]), (8, [-0.01, 0.01]), (8, [3.0, 3.0]), (9, [1.0, 2.0, 3.0]), (None, [0.5, 0.5]),
    ]
    rows += [(i, [float(i % 4), float(i % 3)]) for i in range(20, 200)]  # many vectors in the same places
    vectors = spark.createDataFrame(rows, FORM)
    for name in ("v", "cluster", "n", "drawn", "to_pivots", "distance"):
        vectors = vectors.withColumn(name, F.lit("clash"))
    usable = [r for r in rows if r[0] != 7]  # too large for 64 bits
    for k, rounds in ((16, 3), (3, 5), (400, 1)):
        assert _got(clustering.cluster_vectors(vectors, k=k, rounds=rounds, dim=2)) == _brute(usable, k, rounds, 2)
    assert clustering.cluster_vectors(vectors.limit(0), dim=2).count() == 0
    assert clustering.cluster_vectors(vectors, dim=7).columns == clustering.cluster_vectors(vectors, dim=2).columns


def test_pivots_rule_out_distant_centroids():
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-400, 400, (16, 8))
    x = (centres[rnd.integers(0, 16, 3000)] + rnd.integers(-9, 9, (3000, 8))).astype(np.int64)
    centroids, pivots = centres + rnd.integers(-3, 3, centres.shape), centres[:6]
    to_pivots = np.sqrt(np.stack([clustering.squared_distances(x, p) for p in pivots], axis=1).astype(float))
    best, far, compared = clustering.nearest(x, to_pivots, centroids, pivots)
    exact = np.stack([clustering.squared_distances(x, c) for c in centroids], axis=1)
    assert (best == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
    assert compared.mean() < 4
