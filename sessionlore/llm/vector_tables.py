"""Helpers for numeric vectors in Arrow batches and for small integer tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether a vector is there and no component is null, NaN or infinite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine, F.lit(False))


def scaled(vector: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long"))


def within(vector: Column, factor: int, bound: int) -> Column:
    """Whether all components, times ``factor``, lie within +-``bound``."""
    return F.forall(vector, lambda x: F.abs(x.cast("double") * F.lit(float(factor))) < F.lit(float(bound)))


def matrix(column, dims: int) -> np.ndarray:
    """A list column of ``dims`` numbers in each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
