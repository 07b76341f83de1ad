"""Whitening of embeddings with an exact covariance from bit-sliced cross-products.

Components are integers. Each dimension, less its smallest value, is cut into bit planes, and a plane of many rows is
packed into words. The sum over rows of the product of two dimensions is then the sum over pairs of planes of the
number of common bits, weighted by the powers of two of the planes: exact, however many rows there are. The
covariance is centred in integers before the eigenvectors are taken.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.vector_tables import finite, matrix, scaled, within
from sessionlore.session import materialize

#: Integers lie below this in absolute value.
BOUND = 1 << 59
#: Rows whose planes are packed at once.
STEP = 1 << 14
#: Share of the largest variance under which a component counts as constant.
_FLAT = 1e-13


def planes(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of all dimensions, one after the other, packed into words of 64 rows."""
    rows = -(-len(values) // 64) * 64
    out = np.zeros((sum(bits), rows // 64), np.uint64)
    padded = np.zeros((rows, values.shape[1]), np.int64)
    padded[:len(values)] = values
    at = 0
    for d, size in enumerate(bits):
        own = padded[:, d]
        for b in range(size):
            out[at] = np.packbits((own >> b & 1).astype(np.uint8)).view(np.uint64)
            at += 1
    return out


def common_bits(packed: np.ndarray) -> np.ndarray:
    """Rows that two planes have in common, for each pair (the upper triangle)."""
    n = len(packed)
    out = np.zeros((n, n), np.int64)
    for i in range(n):
        out[i, i:] = np.bitwise_count(packed[i] & packed[i:]).sum(1, dtype=np.int64)
    return out


def weighted(common: np.ndarray, bits: list[int]) -> list[list[int]]:
    """Cross-products of the dimensions from the common bits of their planes."""
    whole = common + np.triu(common, 1).T
    start = np.concatenate([[0], np.cumsum(bits)]).tolist()
    dims = len(bits)
    out = [[0] * dims for _ in range(dims)]
    for d in range(dims):
        for e in range(d, dims):
            part = whole[start[d]:start[d + 1], start[e]:start[e + 1]]
            out[d][e] = sum(int(x) << (a + b) for a, row in enumerate(part.tolist()) for b, x in enumerate(row))
    return out


def _scatter(low: list[int], bits: list[int]):
    """Cross-products of a task's rows, less the smallest values: a row for each pair of dimensions."""
    dims, shift = len(low), np.array(low, np.int64)

    def run(batches):
        total = None
        for batch in batches:
            values = matrix(batch.column("x"), dims) - shift
            for i in range(0, len(values), STEP):
                found = common_bits(planes(values[i:i + STEP], bits))
                total = found if total is None else total + found
        if total is not None:
            rows = [(d, e, Decimal(x)) for d, row in enumerate(weighted(total, bits)) for e, x in enumerate(row) if e >= d]
            kinds = pa.int32(), pa.int32(), pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["d", "e", "product"])

    return run


def covariance(vectors: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and n times the centred cross-products of the column ``x``, all exact integers."""
    each = vectors.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"),
        F.sum(F.col("v").cast("decimal(38,0)")).alias("total")).orderBy("d").collect()  # a row for each dimension
    n, low, total = each[0]["n"], [r["low"] for r in each], [int(r["total"]) for r in each]
    bits = [(r["high"] - r["low"]).bit_length() for r in each]
    part = vectors.select("x").mapInArrow(_scatter(low, bits), "d int, e int, product decimal(38,0)")
    products = {(r["d"], r["e"]): int(r["s"]) for r in part.groupBy("d", "e").agg(F.sum("product").alias("s")).collect()}
    rest = [s - n * a for s, a in zip(total, low)]
    centred = [[0] * dims for _ in range(dims)]
    for d in range(dims):
        for e in range(d, dims):
            centred[d][e] = centred[e][d] = n * products[d, e] - rest[d] * rest[e]
    return n, total, centred


def components(n: int, centred: list[list[int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of the covariance from the largest down, their unit vectors in columns, and the trace."""
    square = n * n
    values, vectors = np.linalg.eigh(np.array([[x / square for x in row] for row in centred]))  # each entry rounded once
    trace = sum(centred[d][d] for d in range(len(centred))) / square
    return values[::-1].copy(), vectors[:, ::-1].copy(), trace


def _project(n, total, values, vectors):
    """Deviation from the mean, and the components of each row."""
    dims = len(total)
    sums, scale = np.array(total, object), np.sqrt(values)
    usual = all(abs(s) < 1 << 62 for s in total)
    plain = np.array([int(s) if usual else 0 for s in total], np.int64)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), dims)
            most = int(max(x.max(), -x.min()))
            if usual and n * most < 1 << 62:
                apart = n * x - plain
            else:
                apart = x.astype(object) * n - sums
            far = max(int(apart.max()), -int(apart.min()))
            if dims * far * far < 1 << 62:
                apart = apart.astype(np.int64)
                deviation = (apart * apart).sum(1).tolist()
            else:
                deviation = [sum(v * v for v in row) for row in apart.astype(object).tolist()]
                deviation = [v if v < 1 << 63 else None for v in deviation]
            white = apart.astype(np.float64) / n @ vectors / scale
            ends = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, white.ravel())],
                names=["vec_id", "deviation", "whitened"])

    return run


def _moments(mean):
    """Sums of products of the centred columns of a task's rows."""
    def run(batches):
        total = None
        for batch in batches:
            white = matrix(batch.column("whitened"), len(mean)) - mean
            found = white.T @ white
            total = found if total is None else total + found
        if total is not None:
            i, j = np.triu_indices(len(mean))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "product"])

    return run


def identity_error(white: DataFrame, n: int, width: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity."""
    means = {r["i"]: r["mean"] for r in white.select(F.posexplode("whitened").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("mean")).collect()}
    mean = np.array([means[i] for i in range(width)])
    part = white.select("whitened").mapInArrow(_moments(mean), "i long, j long, product double")
    rows = part.groupBy("i", "j").agg(F.sum("product").alias("s")).collect()
    return max(abs(r["s"] / n - (r["i"] == r["j"])) for r in rows)


def whiten(rows: DataFrame, *, width: int = 32, factor: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of each remaining row.

    ``rows`` needs ``vec_id`` and ``embedding``; other columns are not read. Rows whose vector is null or holds null or
    non-finite entries are dropped; an entry c becomes ``floor(factor * c) + shift``. All remaining rows are fitted,
    repeated ones and those without id included. ``whitened`` and ``explained`` are arrays, an entry for each
    component up to ``width`` that is not constant. ``deviation`` is the sum of (n * x - S)^2, null where it is beyond
    a long.

    Vectors of another length than the most frequent (of equally frequent the longest), empty vectors, and vectors
    with an integer at ``BOUND`` or beyond are dropped too. Where all vectors are equal the arrays are empty and
    ``identity_error`` is 0. Without a remaining row, and for an empty table, there are no rows.

    Three passes over the written integers, none of which shuffles a vector: ranges and sums, cross-products, results;
    tasks send a row for each pair of dimensions, added up exactly.
    """
    spark = rows.sparkSession
    schema = "vec_id long, deviation long, whitened array<double>"
    about = "n long, explained array<double>, identity_error double"
    good = finite(F.col("embedding")) & (F.size("embedding") > 0) & within(F.col("embedding"), factor, BOUND)
    known = rows.where(F.coalesce(good, F.lit(False)))
    lengths = known.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], f"{schema}, {about}")
    dims = lengths[0]["dims"]
    x = F.transform(scaled(F.col("embedding"), factor), lambda v: v + F.lit(shift).cast("long"))
    vectors = materialize(known.where(F.size("embedding") == dims).select("vec_id", x.alias("x")))
    n, total, centred = covariance(vectors, dims)
    values, axes, trace = components(n, centred)
    used = int((values[:width] > _FLAT * max(values[0], 0.0)).sum()) if trace else 0
    white = materialize(vectors.mapInArrow(_project(n, total, values[:used], axes[:, :used]), schema))
    error = identity_error(white, n, used) if used else 0.0
    return white.select("*", F.lit(n).cast("long").alias("n"),
                        F.lit([float(v / trace) for v in values[:used]]).cast("array<double>").alias("explained"),
                        F.lit(float(error)).alias("identity_error"))
