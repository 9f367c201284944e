"""Clustering of vectors around centroids, with a table of distances to fixed pivots (LAESA).

Every vector's exact distance to a few fixed pivots is worked out once and stored beside it. In
each round the centroids' distances to the same pivots bound all others from below, as
``|d(v, p) - d(c, p)| <= d(v, c)``: the centroid with the least bound is measured first, and
then only those whose bound does not exceed the best distance so far. What is measured is
exact, in integers, so pruning never changes a result.

A round reads the stored table and sends one sum per centroid and task; the driver gets one row
per centroid and component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import batches, small_batches, written

PIVOTS = 8
# Larger components are held at this size, so that squared distances of 64 fit 64 bits.
LARGEST = 1 << 27
RESULT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def integers(components: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * components.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def squared(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of equal number, or of all rows to one."""
    apart = vectors - others
    return (apart * apart).sum(axis=-1)


def spread_out(points: np.ndarray, most: int) -> np.ndarray:
    """``most`` of the points, each as far as can be from those before it."""
    chosen = [0]
    near = squared(points, points[0])
    while len(chosen) < min(most, len(points)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(points, points[chosen[-1]]))
    return points[chosen]


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (the smaller number of
    equal ones), and how many distances had to be measured for it."""
    ours = np.sqrt(to_pivots.astype(np.float64))
    theirs = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))
    bounds = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bounds, np.abs(ours[:, p, None] - theirs[None, :, p]), out=bounds)
    # What rounding of the roots may add to a bound.
    bounds -= 1e-9 * (1 + ours.max(axis=1, initial=0) + theirs.max(initial=0))[:, None]
    number = bounds.argmin(axis=1)
    best = squared(vectors, centroids[number])
    first, measured = number.copy(), len(vectors)
    for c in range(len(centroids)):
        left = np.flatnonzero((first != c) & (bounds[:, c] <= np.sqrt(best.astype(np.float64))))
        found = squared(vectors[left], centroids[c])
        measured += len(left)
        closer = (found < best[left]) | ((found == best[left]) & (c < number[left]))
        best[left[closer]], number[left[closer]] = found[closer], c
    return number, best, measured


def _rows(batch: pa.RecordBatch, name: str, kind: str, width: int) -> np.ndarray:
    """A column of byte strings of equal length as a matrix."""
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, width).astype(np.int64)


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, scale: int = 64, size: int = 64) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` for each vector of ``vectors`` (``vec_id``, ``embedding``).

    Vectors with exactly ``size`` components, none of them null, NaN or infinite, take part; any
    other row and any without an id is left out. A component x becomes ``floor(scale * x)``, held
    within 2**27. Repeated rows count as often as they occur; of rows with one id and different
    vectors the lexically first vector comes first among the initial centroids. With fewer vectors than
    ``clusters`` there are as many centroids as vectors; without any the result is empty.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == size) & F.forall("embedding", sound)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # A list of as many rows as there are clusters.
    by_hash = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.orderBy(by_hash, "embedding").limit(clusters).collect()
    if not chosen:
        return spark.createDataFrame([], RESULT)
    centroids = integers(np.array([row.embedding for row in chosen]), scale)
    pivots = spread_out(centroids, PIVOTS)

    def store(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4_000):
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            whole = integers(flat, scale)
            apart = np.stack([squared(whole, p) for p in pivots], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([r.tobytes() for r in whole.astype("<i4")], pa.binary()),
                 pa.array([r.tobytes() for r in apart.astype("<i8")], pa.binary())], ["vec_id", "parts", "to_pivots"])

    table = written(kept.mapInArrow(store, "vec_id long, parts binary, to_pivots binary"))

    def assigned(batch: pa.RecordBatch, around: np.ndarray):
        whole = _rows(batch, "parts", "<i4", size)
        return whole, *nearest(whole, _rows(batch, "to_pivots", "<i8", len(pivots)), around, pivots)[:2]

    def sums(around: np.ndarray):
        def kernel(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, total = np.zeros(len(around), np.int64), np.zeros(around.shape, np.int64)
            for batch in batches(rows, 4_000):
                whole, number, _ = assigned(batch, around)
                held += np.bincount(number, minlength=len(around))
                for c in np.unique(number):
                    total[c] += whole[number == c].sum(axis=0)
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(held[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
                ["cluster", "held", "total"])

        return kernel

    for _ in range(rounds):
        parts = table.mapInArrow(sums(centroids), "cluster int, held long, total array<long>")
        wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        new = parts.select("cluster", "held", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at").agg(
            wide("held").alias("held"), wide("part").alias("part"))
        for row in new.collect():  # clusters * size rows
            centroids[row.cluster, row.at] = int(row.part) // int(row.held)

    def final(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 4_000):
            _, number, best = assigned(batch, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    found = written(table.mapInArrow(final, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.inertia) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    whole = sum(inertia.values())
    name = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    about = spark.createDataFrame(
        [(c, fits(x), fits(whole), name(c)) for c, x in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each cluster that has a vector.
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
