"""Exact k-means on integer vectors with a LAESA pivot table.

Every vector's distances to a few fixed pivots are stored once, beside the vector. A
centroid's distances to the pivots are known in each round, and the greatest difference of
the two bounds the distance from below. Centroids whose bound exceeds an exact distance
already found are out; the others get exact integer distances. Pivots only save work: any
choice of them gives the same clusters.

Vectors are frozen as blocks of some thousands in the shared folder. A round reads the
blocks, sends one sum per task, centroid and component, and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.runtime import cut_lineage

BOUND = 1 << 27
"""Greatest component that keeps squared distances of 64 components within 64 bits."""
CANDIDATES = 64
"""Vectors, the smallest by hash, among which the pivots are chosen."""


def whole_vectors(batch: pa.RecordBatch, size: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """(ids, integer vectors) of the rows of (vec_id, array of doubles) with ``size`` finite components."""
    lists = batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    rows = np.flatnonzero((lengths == size) & lists.is_valid().to_numpy(zero_copy_only=False))
    begin = lists.offsets.to_numpy()[rows]
    values = lists.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    x = values[begin[:, None] + np.arange(size)].astype(float) if len(rows) else np.zeros((0, size))
    good = np.isfinite(x).all(1)
    x, rows = np.floor(scale * x[good]), rows[good]
    if x.size and np.abs(x).max() > BOUND:
        raise ValueError(f"components beyond {BOUND} / {scale}: squared distances would not fit into 64 bits")
    return batch.column(0).take(pa.array(rows)), x.astype(np.int64)


def hashed(seed: int, vec_id) -> str:
    """Order of the first centroids; a null id counts as empty."""
    return hashlib.sha256(f"{seed}:{'' if vec_id is None else vec_id}".encode()).hexdigest()


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """``count`` vectors, each the farthest from those before it; fewer if the rest are repeats."""
    chosen, near = [], np.full(len(vectors), np.inf)
    while len(chosen) < count and len(vectors):
        at = int(near.argmax()) if chosen else 0
        if near[at] == 0:
            break
        chosen.append(at)
        near = np.minimum(near, ((vectors - vectors[at]) ** 2).sum(1))
    return vectors[chosen]


def distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances, a column per point."""
    found = np.empty((len(vectors), len(points)))
    for k, point in enumerate(points):
        found[:, k] = np.sqrt(((vectors - point) ** 2).sum(1))
    return found


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, exact squared distance, exact distances computed); ties to the smaller number."""
    if not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    bound = np.zeros((len(vectors), len(centroids)))
    for k in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, k : k + 1] - to_pivots[None, :, k]), out=bound)
    bound = bound * (1 - 1e-9) - 1e-3  # more than the roots' rounding
    label = bound.argmin(1)
    best = ((vectors - centroids[label]) ** 2).sum(1)
    first, computed = label.copy(), len(vectors)
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero((bound[:, j] <= np.sqrt(best)) & (first != j))
        computed += len(rows)
        found = ((vectors[rows] - centroid) ** 2).sum(1)
        better = (found < best[rows]) | (found == best[rows]) & (j < label[rows])
        label[rows[better]], best[rows[better]] = j, found[better]
    return label, best, computed


@dataclass(frozen=True)
class Clusters:
    """``rows`` (vec_id, cluster, distance) and the final ``centroids``; ``computed`` exact distances of the last pass."""

    rows: DataFrame
    centroids: np.ndarray


def _first(vectors: DataFrame, size: int, scale: int, seed: int, most: int) -> list[tuple[str, list[int]]]:
    """The ``most`` smallest (hash, vector); a batch passes on no more than so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_vectors(batch, size, scale)
            digests = [hashed(seed, i) for i in ids.to_pylist()]
            order = sorted(range(len(digests)), key=lambda k: (digests[k], x[k].tolist()))[:most]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[k] for k in order], pa.string()), pa.array([x[k] for k in order], pa.list_(pa.int64()))], ["digest", "vector"]
            )

    found = vectors.mapInArrow(run, "digest string, vector array<long>").orderBy("digest", "vector").limit(most)
    return [(r["digest"], r["vector"]) for r in found.collect()]


def _blocks(vectors: DataFrame, size: int, scale: int, pivots: np.ndarray) -> DataFrame:
    """(ids, n, vectors, pivot distances), a row per batch, frozen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_vectors(batch, size, scale)
            if len(x):
                own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                values = [pa.array([len(x)]), pa.array([x.astype(np.int32).tobytes()]), pa.array([distances(x, pivots).tobytes()])]
                yield pa.RecordBatch.from_arrays([own, *values], ["ids", "n", "vectors", "pivots"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return cut_lineage(vectors.mapInArrow(run, f"ids array<{kind}>, n long, vectors binary, pivots binary"))


def _opened(r: dict, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["vectors"], np.int32).reshape(-1, size).astype(np.int64), np.frombuffer(r["pivots"]).reshape(r["n"], -1)


def cluster(vectors: DataFrame, k: int, rounds: int, size: int = 64, scale: int = 1024, seed: int = 3, n_pivots: int = 8) -> Clusters:
    """k-means of ``vectors`` (vec_id, embedding): ``floor(scale * x)`` of rows with exactly ``size`` finite components.

    The first centroids are the ``k`` rows with the smallest SHA-256 of ``seed:vec_id`` (a null
    id as empty; rows that tie, by their components); fewer rows make fewer centroids, none
    make an empty result. Each of ``rounds`` assigns all rows to the nearest centroid and
    replaces centroids that have rows by the floor of their exact mean; then all are assigned
    once more. Other rows have no place in the result; repeated ones each have theirs.
    Components beyond 2^27 raise, because distances would not fit into 64 bits. Columns
    other than vec_id and embedding are not read.
    """
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>"))
    head = _first(vectors, size, scale, seed, max(k, CANDIDATES))
    pool = np.array([v for _, v in head], np.int64).reshape(-1, size)
    pivots, centroids = far_apart(pool, n_pivots), pool[:k]
    blocks = _blocks(vectors, size, scale, pivots)

    def sums(centroids: np.ndarray):
        to_pivots = distances(centroids, pivots)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(centroids), size + 1), np.int64)
            for batch in batches:
                for r in batch.select(["n", "vectors", "pivots"]).to_pylist():
                    x, table = _opened(r, size)
                    label = nearest(x, table, centroids, to_pivots)[0]
                    for j in range(len(centroids)):
                        own = x[label == j]
                        total[j] += np.r_[own.sum(0), len(own)]
            at = np.flatnonzero(total[:, size])
            columns = np.repeat(at, size + 1), np.tile(np.arange(size + 1), len(at)), total[at].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["cluster", "part", "total"])

        return run

    for _ in range(rounds if len(centroids) else 0):
        parts = blocks.drop("ids").mapInArrow(sums(centroids), "cluster long, part long, total long")
        moved = [[0] * (size + 1) for _ in centroids]
        for r in parts.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect():
            moved[r["cluster"]][r["part"]] = int(r["total"])
        centroids = np.array([[s // own[size] for s in own[:size]] if own[size] else old for own, old in zip(moved, centroids.tolist())], np.int64)

    last, to_pivots = centroids, distances(centroids, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                r = batch.slice(b, 1)
                x, table = _opened(r.select(["n", "vectors", "pivots"]).to_pylist()[0], size)
                label, best, _ = nearest(x, table, last, to_pivots)
                yield pa.RecordBatch.from_arrays([r.column(0).flatten(), pa.array(label.astype(np.int32)), pa.array(best)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return Clusters(cut_lineage(blocks.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """``found.rows`` with cluster_inertia, inertia and the SHA-256 of the cluster's centroid: one small row per centroid is broadcast."""
    spark = found.rows.sparkSession
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()
    total = sum(int(r["s"]) for r in sums)
    digest = lambda j: hashlib.sha256(",".join(map(str, found.centroids[j].tolist())).encode()).hexdigest()
    rows = [(r["cluster"], int(r["s"]), total, digest(r["cluster"])) for r in sums]
    own = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
