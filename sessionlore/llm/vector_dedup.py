"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors are dealt to cells by the signs of a few random projections, in as many tables as the wanted recall
takes. In a cell the members are sorted along many further projections; a pair collides in one of them if it lies in
the window centred on either, and pairs whose count of collisions passes a threshold, set from the binomial
distribution for the wanted recall, are verified by their cosine.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.linking import components
from sessionlore.session import materialize

#: Projections counted, half the width of a window in standard deviations of a close pair, and the wanted recall of
#: the count and of the tables for a pair at the threshold.
PROJECTIONS, WINDOW, RECALL = 32, 1.35, 0.9995
#: Members that a cell has on average, and members of a cell that meet at once.
CELL, BLOCK = 128, 1024
_SEED = 20240229


@lru_cache(maxsize=8)
def _directions(dims: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng((_SEED, seed)).normal(size=(dims, count))


def plan(rows: int, cosine: float) -> tuple[int, int]:
    """Sign bits of a cell and tables."""
    bits = max(0, int(math.log2(max(1, rows) / CELL)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if same >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - same))


def least_count(cosine: float) -> tuple[float, int]:
    """Half width of the window, and the largest count that a pair at ``cosine`` reaches with the wanted recall."""
    width = WINDOW * math.sqrt(2 - 2 * cosine)
    hit = math.erf(WINDOW / math.sqrt(2))
    below = 0.0
    for count in range(PROJECTIONS + 1):
        below += math.comb(PROJECTIONS, count) * hit ** count * (1 - hit) ** (PROJECTIONS - count)
        if below > 1 - RECALL:
            return width, count
    return width, PROJECTIONS


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors ** 2).sum(1, keepdims=True))


def _keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Cell numbers of each vector in every table."""
    if not bits:
        return np.zeros((len(unit), tables), np.int64)
    signs = (unit @ _directions(unit.shape[1], bits * tables, 1) > 0).reshape(len(unit), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _vectors(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
    return [(at, flat[(ends[at] - n)[:, None] + np.arange(n)])
            for n in np.unique(lengths).tolist() for at in [np.flatnonzero(lengths == n)]]


def _cell_rows(bits, tables):
    def run(batches):
        for batch in batches:
            for at, matrix in _vectors(batch.column("embedding")):
                keys = _keys(_unit(matrix), bits, tables)
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(pa.array(np.repeat(at, tables))),
                     pa.array(np.full(n * tables, matrix.shape[1], np.int32)),
                     pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.ravel())],
                    names=["node", "dims", "table", "cell"])

    return run


def collisions(unit: np.ndarray, other: np.ndarray, width: float) -> np.ndarray:
    """For each pair of rows, the projections in which one lies in the window centred on the other."""
    line = _directions(unit.shape[1], PROJECTIONS, 2)
    a, b = unit @ line, other @ line
    found = np.zeros((len(a), len(b)), np.int8)
    row = np.arange(len(a))
    for k in range(PROJECTIONS):
        order = np.argsort(b[:, k], kind="stable")
        ranked = b[order, k]
        edge = np.zeros((len(a), len(b) + 1), np.int8)
        edge[row, np.searchsorted(ranked, a[:, k] - width, "left")] += 1
        edge[row, np.searchsorted(ranked, a[:, k] + width, "right")] -= 1
        found[:, order] += np.cumsum(edge[:, :-1], axis=1, dtype=np.int8)
    return found


def _meet(cosine, bits, tables):
    """Links within one cell between two of its blocks: for each member their weight, and its smallest partner."""
    width, least = least_count(cosine)

    def run(key, group):
        table, one, two = (group.column(c)[0].as_py() for c in ("table", "one", "two"))
        block, node = group.column("block").to_numpy(), group.column("node").to_numpy()
        weight = group.column("weight").to_numpy()
        unit = _unit(_vectors(group.column("embedding"))[0][1])
        keys = _keys(unit, bits, tables)[:, :table]
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        total, pairs = np.zeros(len(node), np.int64), []
        for i in range(0, len(left), 128):
            a = left[i:i + 128]
            rows, columns = np.nonzero(collisions(unit[a], unit[right], width) >= least)
            u, v = a[rows], right[columns]
            ahead = u < v if one == two else np.ones(len(u), bool)  # each pair once
            u, v = u[ahead], v[ahead]
            if table and len(u):  # and in the first table that brings it together
                new = (keys[u] != keys[v]).all(1)
                u, v = u[new], v[new]
            close = np.einsum("ij,ij->i", unit[u], unit[v]) >= cosine
            u, v = u[close], v[close]
            np.add.at(total, u, weight[v])
            np.add.at(total, v, weight[u])
            pairs.append((u, v))
        u, v = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        low, before = node.copy(), None
        while before is None or (low != before).any():
            before = low.copy()
            np.minimum.at(low, u, low[v])
            np.minimum.at(low, v, low[u])
        linked = np.flatnonzero(total)
        return pa.table({"node": pa.array(node[linked], pa.int64()), "links": pa.array(total[linked], pa.int64()),
                         "low": pa.array(low[linked], pa.int64())})

    return run


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_vectors(rows: DataFrame, *, cosine: float = 0.9) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each row of ``rows`` (``vec_id``, ``embedding``).

    ``n_links`` counts the other rows with a cosine of at least ``cosine``, ``component_id`` is the smallest
    ``vec_id`` reachable by links and ``kept`` tells whether it is the row's own. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, as do rows without ``vec_id`` (no component,
    kept); vectors of different lengths never link; repeated rows count as other vectors. An empty table
    gives no rows.

    Equal vectors are one class with a weight, found by a map-side combined aggregate. Cells of more than
    ``BLOCK`` members meet block by block. A pair is counted in the first table that brings it together, so
    that sums per vector leave a cell, never pairs.
    """
    known = rows.select("vec_id", "embedding")
    good = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    classes = materialize(known.where(good).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    bits, tables = plan(classes.count(), cosine)
    cells = classes.select("node", "embedding").mapInArrow(
        _cell_rows(bits, tables), "node long, dims int, table int, cell long")
    cells = materialize(cells)
    place = ["dims", "table", "cell"]
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    sized = cells.groupBy(*place).agg(blocks, F.count("*").alias("members")).where("members > 1").drop("members")
    cut = cells.join(sized, place).withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    met = cut.join(classes, "node").groupBy(*place, "one", "two").applyInArrow(
        _meet(cosine, bits, tables), "node long, links long, low long")
    met = materialize(met)
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(met.select(F.col("node").alias("u"), F.col("low").alias("v")))
    classes = (classes.join(links, "node", "left").join(grouped, "node", "left").select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id")))
    linked = known.where(good).join(classes, "embedding").select("vec_id", "n_links", "component_id")
    alone = known.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
