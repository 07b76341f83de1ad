"""Clusters of integer vectors by centroids, with distances from scalar lookup tables.

Components are small integers, so that a squared difference depends on few numbers: the dimension, the value and the
centroid. Each round tabulates it for every value that occurs; the distances of a vector to all centroids are then
sums of table rows, gathered by NumPy, without a multiplication for each vector.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.vector_tables import finite, matrix, scaled, within
from sessionlore.session import materialize

#: Integers lie below this in absolute value, so that distances fit a long.
BOUND = 1 << 27
#: Rows that one step of a task works on, and values of a dimension up to which a table holds its whole range.
STEP, RANGE = 4096, 1 << 12


def distances(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to all centroids, from a table for each dimension."""
    out = np.zeros((len(values), len(centroids)), np.int64)
    for d in range(values.shape[1]):
        own = values[:, d]
        low, high = int(own.min()), int(own.max())
        if high - low < RANGE:
            occurring, code = np.arange(low, high + 1), own - low
        else:  # a wide range is tabulated where it occurs
            occurring, code = np.unique(own, return_inverse=True)
        table = (occurring[:, None] - centroids[None, :, d]) ** 2
        out += table[code]
    return out


def _nearest(values: np.ndarray, centroids: np.ndarray):
    for i in range(0, len(values), STEP):
        part = values[i:i + STEP]
        found = distances(part, centroids)
        best = found.argmin(1)  # the first of equal ones
        yield part, best, found[np.arange(len(part)), best]


def _sums(centroids):
    """A row for each cluster of a task: members and sums of components."""
    k, dims = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                for part, best, _ in _nearest(matrix(batch.column("q"), dims), centroids):
                    order = np.argsort(best, kind="stable")
                    own, start = np.unique(best[order], return_index=True)
                    total[own] += np.add.reduceat(part[order], start, axis=0)
                    count += np.bincount(best, minlength=k)
        used = np.flatnonzero(count)
        if len(used):
            sums = pa.ListArray.from_arrays(np.arange(0, dims * len(used) + 1, dims, dtype=np.int32), total[used].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], names=["cluster", "n", "sums"])

    return run


def _assign(centroids):
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = [(best, far) for _, best, far in _nearest(matrix(batch.column("q"), dims), centroids)]
                best, far = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return run


def move(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of each cluster's vectors; empty clusters keep theirs.

    Tasks send a row for each cluster, and the driver gets a row for each cluster and dimension.
    """
    partial = vectors.select("q").mapInArrow(_sums(centroids), "cluster long, n long, sums array<long>")
    each = partial.select("cluster", "n", F.posexplode("sums").alias("dim", "part"))
    whole = F.col("part").cast("decimal(38,0)")
    rows = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(whole).alias("total")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def cluster(rows: DataFrame, *, count: int = 40, rounds: int = 5, dims: int = 64, factor: int = 256, seed: int = 2) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of each vector kept.

    ``rows`` needs ``vec_id`` and ``embedding``; other columns are not read. Kept are vectors of ``dims`` components,
    none null or non-finite; a component x becomes ``floor(factor * x)``. Vectors with one of these at ``BOUND`` or
    beyond are left out too: their distances fit no long. Centroids start as the kept vectors with the ``count``
    smallest hashes of ``seed:vec_id``, of equal ones the smaller vector first; with fewer vectors there are fewer.
    Rows without ``vec_id`` are clustered but start no centroid; repeated rows count each; where no kept vector has an
    id, and for an empty table, there are no rows. Ties in distance go to the smaller number.

    The integers are written once. A round is one pass without a shuffle of vectors: tasks add up their clusters. Only
    ``count`` times ``dims`` numbers reach the driver and go back to the tasks, whatever the number of rows.
    """
    good = finite(F.col("embedding")) & (F.size("embedding") == dims) & within(F.col("embedding"), factor, BOUND)
    vectors = materialize(rows.where(F.coalesce(good, F.lit(False))).select("vec_id", scaled(F.col("embedding"), factor).alias("q")))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.where("vec_id IS NOT NULL").select("q", name.alias("name")).orderBy("name", "q").limit(count).collect()
    schema = "vec_id long, cluster int, distance long"
    if not first:
        centroids, found = np.zeros((0, dims), np.int64), rows.sparkSession.createDataFrame([], schema)
    else:
        centroids = np.array([r["q"] for r in first], np.int64)
        for _ in range(rounds):
            centroids = move(vectors, centroids)
        found = materialize(vectors.mapInArrow(_assign(centroids), schema))
    sums = {r["cluster"]: int(r["far"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("far")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = rows.sparkSession.createDataFrame(
        [(k, far, sum(sums.values()), digest[k]) for k, far in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each centroid: ``count`` at most.
    return found.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
