"""Clusters of integer vectors by exact k-means, with distances to fixed pivots as bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.session import materialize

_LARGEST = 1 << 27  # components beyond it could take a squared distance out of 64 bits
_ROWS = 4096
RESULT = (
    "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, "
    "compared int"
)


def whole_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v``, the components as integers ``floor(scale * x)``, of usable rows."""
    v = F.col("v")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(_LARGEST) / scale))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).filter((F.size(v) == dim) & sound)
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest SHA-256 of ``seed:id``, in that order."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    got = rows.select(drawn.alias("drawn"), "v").orderBy("drawn", "v").limit(k).collect()
    return np.array([r.v for r in got], dtype=np.int64)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``x`` and ``y``, both int64, row by row."""
    return np.square(x - y).sum(axis=-1)


def with_pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` and ``to_pivots``, each vector's distances to the pivots, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                x = _matrix(some.column("v"), np.int64)
                far = np.sqrt(np.stack([squared_distances(x, p) for p in pivots], axis=1).astype(float))
                table = pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), far.shape[1])
                yield pa.record_batch(
                    [some.column("vec_id"), some.column("v"), table.cast(pa.list_(pa.float64()))],
                    ["vec_id", "v", "to_pivots"],
                )

    return materialize(rows.mapInArrow(run, "vec_id long, v array<int>, to_pivots array<double>"))


def nearest(
    x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest centroid (the smaller number in a tie), its exact
    squared distance, and how many centroids were compared exactly.

    By the triangle inequality no centroid is nearer to a vector than their distances to any
    pivot differ. The centroid with the smallest such bound is compared first; those whose
    bound is beyond the distance found cannot be nearer or as near. The slack
    covers the rounding of roots, so that no tie is lost.
    """
    centroid_far = np.sqrt(np.stack([squared_distances(centroids, p) for p in pivots], axis=1).astype(float))
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - centroid_far[None, :, p]), out=bound)
    first = bound.argmin(axis=1)
    reach = squared_distances(x, centroids[first])
    slack = 1e-9 * (1 + to_pivots.max(axis=1) + centroid_far.max())
    row, left = np.nonzero(bound <= (np.sqrt(reach.astype(float)) + slack)[:, None])
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    for at in range(0, len(row), 16 * _ROWS):
        r, c = row[at : at + 16 * _ROWS], left[at : at + 16 * _ROWS]
        exact[r, c] = squared_distances(x[r], centroids[c])
    best = exact.argmin(axis=1)
    return best, exact[np.arange(len(x)), best], np.bincount(row, minlength=len(x))


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            some = batch.slice(at, _ROWS)
            x = _matrix(some.column("v"), np.int64)
            yield some, x, *nearest(x, _matrix(some.column("to_pivots"), float), centroids, pivots)


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of the exact means, empty ones as they were.

    Each task hands on one row of sums for each centroid, added up by Spark; the driver gets
    one row for each centroid.
    """
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
        for _, x, best, _, _ in _assigned(batches, centroids, pivots):
            n += np.bincount(best, minlength=len(n))
            np.add.at(sums, best, x)
        some = np.flatnonzero(n)
        values = pa.array(sums[some].tolist(), type=pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(n[some]), values], ["cluster", "n", "sums"])

    parts = table.mapInArrow(run, "cluster int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():
        out[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    return out


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1,
    pivots: int = 16, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Every usable vector's cluster after ``rounds`` rounds of k-means in integers.

    Components become ``floor(scale * x)``. Rounds start from the ``k`` vectors whose ids have
    the smallest SHA-256 of ``seed:id``. A round assigns each vector to the nearest centroid
    and moves every centroid that has vectors to the floor of their mean; one more assignment
    follows. Sums and distances are exact integers, so results do not depend on partitions.
    The first ``pivots`` (at most ``k``) starting vectors stay the pivots: a vector's distances to them are
    stored with it once, and each round only the centroids that these cannot rule out are
    compared. Vectors never move; tasks get the centroids, ``k * dim`` numbers, with the job.

    Returns ``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia`` and
    ``inertia`` (sums of it), ``centroid_sha256`` and ``compared`` (exact distances of the last
    assignment). Left out are null vectors, vectors of another length, with a null or
    non-finite component, or with one so large that a squared distance would leave 64 bits
    (2 ** 27 after scaling). Rows without an id are drawn as an empty id; repeated rows count
    each; with fewer than ``k`` vectors there are as many centroids as vectors; an empty table
    gives no rows.
    """
    rows = whole_vectors(vectors, dim, scale, id_col, vector_col)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], RESULT)
    fixed = centroids[:pivots]
    table = with_pivot_table(rows, fixed)
    for _ in range(rounds):
        centroids = moved(table, centroids, fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _, best, far, compared in _assigned(batches, centroids, fixed):
            columns = [some.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(far), pa.array(compared.astype(np.int32))]
            yield pa.record_batch(columns, ["vec_id", "cluster", "distance", "compared"])

    done = materialize(table.mapInArrow(run, "vec_id long, cluster int, distance long, compared int"))
    sums = {r.cluster: r.s for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    own = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))])
    named = F.array(*[F.lit(h) for h in hashes])
    return done.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.get(named, F.col("cluster")).alias("centroid_sha256"), "compared",
    )
