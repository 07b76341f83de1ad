"""Helpers for whole texts in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one step of a task works on; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def map_texts(rows: DataFrame, fields: T.StructType, compute: Callable[[list], list], text: str = "text",
              limit: int = STEP_BYTES) -> DataFrame:
    """All columns of ``rows`` followed by ``fields``, which ``compute`` gives for a list of text bytes.

    ``compute`` gets ``None`` for null and returns one list or array per field. Names that ``rows`` shares
    with ``fields`` keep the value of ``fields``. One pass without a shuffle; memory is bounded by ``limit``
    or by the longest text.
    """
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in {f.name.lower() for f in fields}])
    names = rows.columns + fields.names

    def run(batches):
        for batch in steps(batches, text, limit):
            found = compute(raw(batch, text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(_arrow, found, fields)], names=names)
            found = None
        give_back()

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + fields.fields))


_holder: list = ["", None]


def holding(name: str, drop: Callable[[], None]) -> None:
    """Say that ``name`` keeps things in this worker between batches, which ``drop`` lets go; those of others go now."""
    if _holder[0] != name:
        if _holder[1]:
            _holder[1]()
        _holder[:] = [name, drop]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers live on beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def packed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Whole rows in the column ``row`` beside ``text``, so that no column of theirs can clash with new ones."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))


_KINDS = {
    "bigint": (T.LongType(), pa.int64()), "double": (T.DoubleType(), pa.float64()),
    "boolean": (T.BooleanType(), pa.bool_()), "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()), "int": (T.IntegerType(), pa.int32()),
    "array<string>": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "array<int>": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "array<double>": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
}


def _arrow(values, field: T.StructField) -> pa.Array:
    return pa.array(values, type=_KINDS[field.dataType.simpleString()][1])


def fields(text: str) -> T.StructType:
    """Fields of "name kind, ..." (without a session, unlike Spark's own parser)."""
    return T.StructType([T.StructField(name, _KINDS[kind][0]) for name, kind in map(str.split, text.split(", "))])


class PairTable:
    """Int64 keys to int64 values in flat arrays, looked up for whole arrays at once."""

    def __init__(self, capacity: int = 1 << 12):
        self.size = 0
        self._reserve(capacity)

    def _reserve(self, capacity: int) -> None:
        self.bits = max(4, int(capacity - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys are new, distinct and not negative."""
        if (self.size + len(keys)) * 3 > len(self.keys):
            old = self.keys >= 0
            kept_keys, kept_values = self.keys[old], self.values[old]
            self._reserve(4 * (self.size + len(keys)))
            self.size = 0
            self.add(kept_keys, kept_values)
        self.size += len(keys)
        slot, mask = self._home(keys), len(self.keys) - 1
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # one of several for a slot wins
            won = free & (self.keys[slot] == keys)
            self.values[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is missing."""
        slot, mask = self._home(keys), len(self.keys) - 1
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], -1)
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            at = self.keys[slot[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out
