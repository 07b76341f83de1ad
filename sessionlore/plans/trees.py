"""Trees and forests grown level by level over binned rows.

Features are cut into bins once, and equal rows become one row with a count. A level of a group of trees is one
aggregate over (node, candidate feature, bin): from it each node takes its best split. Whatever is drawn (weights of
rows, candidate features, thresholds) is a hash of the tree, the node and the row, so it does not depend on where rows
lie or on how often a task runs. While the counted rows are small (``ROWS_IN_TASK``, measured) they go to all tasks
and each grows many whole trees; beyond that the aggregate of a level is a Spark job. Both give the same trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.session import materialize

#: Bins of a feature at most; a feature of no more distinct values has one for each.
BINS = 250
#: Counted rows times features up to which the rows are sent to every task.
ROWS_IN_TASK = 128 << 20
#: Entries (row, tree, candidate) that a group of trees may have in a task, and nodes of a level in one Spark job.
ENTRIES, NODES_IN_JOB = 4 << 20, 4096
#: Nodes of a model that is sent to every task, and bytes of rows that meet trees in a task.
NODES_SENT, BYTES_OF_ROWS = 1 << 20, 32 << 20
#: Entries (row, candidate) of nodes that are searched at once; rows from which a node's are counted by bin, not sorted,
#: and from which nodes are counted one by one.
SEARCHED, COUNTED, COUNTED_ALONE = 1 << 16, 64, 1024
#: Trees whose votes are added up in a task before they are shuffled.
TREES_SUMMED = 64
#: Counts up to which draws follow the Poisson distribution term by term.
MOST_SUMMED = 10_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from hashes."""
    return (x >> _U(11)).astype(np.float64) / float(1 << 53)


@dataclass(frozen=True)
class Settings:
    """``depth`` None: no limit. ``features``: "sqrt" or "all" candidates per node. ``leaf`` and ``split``: rows that a
    leaf has and a node needs to be split. ``draw``: rows weighted as drawn with replacement. ``drawn_thresholds``: one
    threshold per candidate, anywhere in its range. ``kind``: "forest"; "stumps", each tree fitted to rows reweighted by
    the misses so far; or "softmax", in each of ``trees`` rounds a regression tree per class on what is left, added
    with ``rate``."""

    trees: int = 100
    depth: int | None = None
    features: str = "sqrt"
    leaf: int = 1
    split: int = 2
    draw: bool = True
    drawn_thresholds: bool = False
    kind: str = "forest"
    rate: float = 0.1
    seed: int = 42

    @property
    def squares(self) -> bool:
        return self.kind == "softmax"


@dataclass(frozen=True)
class Fit:
    """One model: its settings, the part of the rows that it does not see, and which counts it takes. ``before`` are the
    trees that a boosted model has already, ``target`` the class that its next tree is for; of features it takes
    ``columns`` only."""

    settings: Settings
    leave_out: int | None = None
    counts: int = 0
    before: Grown | None = None
    target: int = 0
    columns: tuple[int, ...] | None = None


@dataclass
class Rows:
    """Counted rows: bins, statistics of the target for one row, counts (a column per sample), part, a hash of these
    that draws go by, and the number of the row."""

    bins: np.ndarray
    stats: np.ndarray
    counts: np.ndarray
    part: np.ndarray
    ids: np.ndarray
    places: np.ndarray

    @cached_property
    def label(self) -> np.ndarray | None:
        """Class of each row, where the statistics are a single 1 among zeros."""
        one = len(self.stats) and ((self.stats != 0).sum(1) == 1).all() and (self.stats.max(1) == 1).all()
        return self.stats.argmax(1) if one else None

    @cached_property
    def _columns(self) -> np.ndarray:
        return np.ascontiguousarray(self.bins.T)

    def column(self, feature: int) -> np.ndarray:
        return self._columns[feature]

    def weights(self, fit: Fit, seeds: np.ndarray) -> np.ndarray:
        """How often each tree takes each row."""
        n = self.counts[:, fit.counts].astype(np.float64)
        if fit.leave_out is not None:
            n = np.where(self.part == fit.leave_out, 0.0, n)
        if fit.settings.kind == "stumps" and fit.before is not None:
            found = self.scores(fit.before)
            n = n * np.exp(found.sum(1) - (found * self.stats).sum(1))  # the trees that say another class
        if not fit.settings.draw or fit.settings.kind != "forest":
            return np.broadcast_to(n, (len(seeds), len(n)))
        u = uniform(mix(mix(seeds + _U(1))[:, None] ^ mix(self.ids)[None, :]))
        out = np.zeros(u.shape)
        for value in np.unique(n[n > 0]).tolist():
            at = np.flatnonzero(n == value)
            if value <= MOST_SUMMED:
                out[:, at] = np.searchsorted(_poisson(value), u[:, at], side="right")
            else:  # a normal variable by then
                normal = np.vectorize(NormalDist(value, math.sqrt(value)).inv_cdf, otypes=[float])
                out[:, at] = np.maximum(np.rint(normal(np.clip(u[:, at], 1e-12, 1 - 1e-12))), 0)
        return out

    def scores(self, grown: Grown | None) -> np.ndarray:
        """Votes of a boosted model, which grows: those of its earlier trees are kept."""
        if grown is None:
            return np.zeros((len(self.bins), self.stats.shape[1]))
        trees, found = self.__dict__.get("_scored", (0, 0.0))
        found = found + votes(grown, self.bins, first=trees)
        self.__dict__["_scored"] = grown.trees, found
        return found

    def taking(self, columns: tuple[int, ...] | None) -> Rows:
        """The rows with some of the features, numbered anew."""
        return self if columns is None else replace(self, bins=np.ascontiguousarray(self.bins[:, list(columns)]))

    def facing(self, fit: Fit) -> Rows:
        """The rows with the target that the next tree of ``fit`` has: one, what is left of a class, and its curvature."""
        if fit.settings.kind != "softmax":
            return self
        share = softmax(self.scores(fit.before))[:, fit.target]
        left = np.stack([np.ones(len(share)), self.stats[:, fit.target] - share, share * (1 - share)], 1)
        out = replace(self, stats=left)
        out.__dict__["_columns"] = self._columns
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


@lru_cache(4096)
def _poisson(mean: float) -> np.ndarray:
    """Distribution function of a Poisson variable, as far as it stays below one."""
    size = int(mean + 12 * math.sqrt(mean) + 30)
    k = np.arange(size)
    logs = k * math.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, size)))])
    return np.minimum(np.cumsum(np.exp(logs)), 1.0)


def tree_seeds(settings: Settings, first: int, count: int) -> np.ndarray:
    return mix(np.arange(first, first + count, dtype=np.uint64) + mix(np.array([settings.seed], np.uint64)) * _U(3))


# ---- the aggregate of a level ------------------------------------------------------------------

def _bases(candidates: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """First key of each (node, candidate), which has a key for each bin, and the end."""
    return np.concatenate([[0], np.cumsum(sizes[candidates].ravel())])


class Local:
    """Rows in memory, as the places of each (tree, row) that a group of trees takes, in the order of their nodes; ``sizes``
    are bins by feature."""

    def __init__(self, rows: Rows, weights: np.ndarray, sizes: np.ndarray):
        tree, self.row = np.nonzero(weights)
        self.rows, self.weight, self.node, self.sizes = rows, weights[tree, self.row], tree, sizes
        self.trees = len(weights)
        self.first, self.many = 0, np.bincount(tree, minlength=self.trees)  # of the nodes of the level: number, rows
        self.whole = rows.label is not None and bool((self.weight == np.floor(self.weight)).all())

    def _sums(self, key: np.ndarray, row: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys that occur, sorted, and the weighted sums of the target's statistics."""
        stats, label = self.rows.stats, self.rows.label
        width = stats.shape[1]
        if size > 2 * len(key) + 1024:  # mostly empty: number the keys that occur
            used, key = np.unique(key, return_inverse=True)
            size = len(used)
        else:
            used = None
        if label is not None:
            sums = np.bincount(key * width + label[row], weight, size * width).reshape(size, width)
        else:
            sums = np.stack([np.bincount(key, weight * stats[row, k], size) for k in range(width)], 1)
        if used is None:
            used = np.flatnonzero(sums @ np.ones(width) if label is not None else np.bincount(key, minlength=size))
            sums = sums[used]
        return used, sums

    def by_tree(self) -> tuple[np.ndarray, np.ndarray]:
        return self._sums(self.node, self.row, self.weight, self.trees)

    def totals(self) -> np.ndarray:
        out = np.zeros((self.trees, self.rows.stats.shape[1]))
        key, sums = self.by_tree()
        out[key] = sums
        return out

    def level(self, active: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums by key, which stands for a place in ``active``, a candidate of it and a bin."""
        place = np.full(max(int(active.max()), int(self.node.max(initial=0))) + 1, -1)
        place[active] = np.arange(len(active))
        slot = place[self.node]
        at = np.flatnonzero(slot >= 0)
        return self._level(at, slot[at], candidates)

    def _level(self, at: np.ndarray, slot: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, width = self.row[at], candidates.shape[1]
        base = _bases(candidates, self.sizes)
        if base[-1] <= 2 * len(row) * width + 1024 and (candidates == candidates[0]).all():
            return self._by_feature(slot, row, self.weight[at], candidates[0], base)
        flat, features = self.rows.bins.ravel(), self.rows.bins.shape[1]
        key = base[:-1].reshape(-1, width)[slot] + flat.take(candidates[slot] + (row * features)[:, None])
        return self._sums(key.ravel(), np.repeat(row, width), np.repeat(self.weight[at], width), int(base[-1]))

    def _by_feature(self, slot, row, weight, candidates, base) -> tuple[np.ndarray, np.ndarray]:
        """Sums by key where all nodes have the same candidates, without an entry for each row and candidate at once."""
        stats, label = self.rows.stats, self.rows.label
        nodes, kinds = (len(base) - 1) // len(candidates), stats.shape[1]
        sums, there = np.zeros((int(base[-1]), kinds)), np.zeros(int(base[-1]), bool)
        weighted = None if label is not None else [weight * stats[row, k] for k in range(kinds)]
        at_label = label[row] if label is not None else None
        for j, f in enumerate(candidates.tolist()):
            size = int(self.sizes[f])
            key = slot * size + self.rows.column(f).take(row)
            to = (base[j:-1:len(candidates), None] + np.arange(size)).ravel()
            if label is not None:
                sums[to] = np.bincount(key * kinds + at_label, weight, nodes * size * kinds).reshape(-1, kinds)
                there[to] = sums[to] @ np.ones(kinds) != 0
            else:
                for k in range(kinds):
                    sums[to, k] = np.bincount(key, weighted[k], nodes * size)
                there[to] = np.bincount(key, minlength=nodes * size) > 0
        used = np.flatnonzero(there)
        return used, sums[used]

    def best(self, active, candidates, keys, totals, values, settings: Settings):
        """Best split of each node as ``choose`` gives it, some nodes at a time."""
        if not self.whole:
            return choose(*self.level(active, candidates), totals, candidates, keys, values, self.sizes, settings)
        many, start = self.many[active - self.first], (np.cumsum(self.many) - self.many)[active - self.first]
        size = totals.sum(1)
        if size.max() >= 1 << 24:
            return choose(*self.level(active, candidates), totals, candidates, keys, values, self.sizes, settings)
        feature, split, left = np.full(len(active), -1), np.zeros(len(active), np.int64), np.zeros(totals.shape)
        for keyed, kind in ((self._sorted, many < COUNTED), (self._counted, (many >= COUNTED) & (many < COUNTED_ALONE)),
                            (self._counted_alone, many >= COUNTED_ALONE)):
            nodes = np.flatnonzero(kind)
            group = (np.cumsum(many[nodes]) - many[nodes]) * candidates.shape[1] // SEARCHED
            for own in np.split(nodes, np.flatnonzero(np.diff(group)) + 1) if len(nodes) else ():
                n = many[own]
                row = np.arange(n.sum()) + np.repeat(start[own] - np.cumsum(n) + n, n)
                feature[own], split[own], left[own] = self._best(
                    keyed, row, n, candidates[own], keys[own], int(size[own].max()), values, settings, totals.shape[1])
        return feature, split, left

    def _sorted(self, row, n, words, candidates):
        """(group, bin) of few rows, where a group is a candidate of a node, and the sums up to there."""
        width, shift = candidates.shape[1], len(row).bit_length()
        key = self._bins(row, n, candidates).astype(np.int64) << shift
        key += np.repeat((np.arange(candidates.size) << (8 + shift)).reshape(-1, width), n, axis=0)
        key += np.arange(len(row))[:, None]
        key = np.sort(key, axis=None)
        of = key & ((1 << shift) - 1)
        key >>= shift
        end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        key = key[end]
        return key >> 8, key & 255, [np.cumsum(word.take(of))[end] for word in words]

    def _counted(self, row, n, words, candidates):
        """The same of many rows."""
        width, base = candidates.shape[1], _bases(candidates, self.sizes)
        key = np.repeat(base[:-1].reshape(-1, width), n, axis=0)
        key += self._bins(row, n, candidates)
        key = key.ravel()
        return self._occurring(candidates, base, [
            np.bincount(key, np.repeat(word.astype(np.float64), width), int(base[-1])) for word in words])

    def _counted_alone(self, row, n, words, candidates):
        """The same, a node and a candidate at a time."""
        sums = [[] for _ in words]
        for of, a, b in zip(candidates.tolist(), (np.cumsum(n) - n).tolist(), np.cumsum(n).tolist()):
            own = [word[a:b].astype(np.float64) for word in words]
            for f in of:
                bins = self.rows.column(f).take(row[a:b])
                for word, out in zip(own, sums):
                    out.append(np.bincount(bins, word, int(self.sizes[f])))
        return self._occurring(candidates, _bases(candidates, self.sizes), [np.concatenate(x) for x in sums])

    def _bins(self, row, n, candidates):
        return self.rows.bins.ravel().take(np.repeat(candidates, n, axis=0) + (row * self.rows.bins.shape[1])[:, None])

    @staticmethod
    def _occurring(candidates, base, sums):
        there = sums[0] != 0
        for x in sums[1:]:
            there |= x != 0
        used = np.flatnonzero(there)
        group = np.repeat(np.arange(candidates.size), np.diff(base))[used]
        return group, used - base[group], [np.cumsum(x[used].astype(np.int64)) for x in sums]

    def _best(self, keyed, at, n, candidates, keys, most: int, values, settings: Settings, kinds: int):
        """``choose`` for nodes of ``most`` counted rows at most. The sums of some classes are parts of one whole number,
        which a float holds as well where bins are counted."""
        nodes, width = candidates.shape
        row, bits = self.row[at], most.bit_length()
        whole, label, per = self.weight[at].astype(np.int64), self.rows.label[row], (63 if keyed == self._sorted else 53) // bits
        firsts = range(0, kinds, per)
        words = [whole << bits * label] if per >= kinds else [
            np.where((label >= a) & (label < a + per), whole << bits * np.clip(label - a, 0, per), 0) for a in firsts]
        group, own, totals = keyed(row, n, words, candidates)
        last = np.append(group[1:] != group[:-1], True)
        end = np.flatnonzero(last)  # each node has rows in a bin of each candidate
        feature, split, left_stats = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros((nodes, kinds))
        at = np.flatnonzero(~last)
        if settings.drawn_thresholds:
            of = candidates.ravel()
            u = uniform(mix(mix(np.repeat(keys, width) + _U(7)) ^ mix(of.astype(np.uint64) + _U(11))))
            low, high = values[of, own[np.append(0, end[:-1] + 1)]], values[of, own[end]]
            drawn = low + u * (high - low)
            cut = drawn[group[at]]
            at = at[(values[of[group[at]], own[at]] <= cut) & (values[of[group[at]], own[at + 1]] > cut)]
        if not len(at):
            return feature, split, left_stats
        group, mask = group[at], (1 << bits) - 1
        sizes, squares, lefts = [0, 0], [0, 0], []
        for a, total in zip(firsts, totals):
            before, parts = np.append(0, total[end[:-1]]), min(per, kinds - a)
            ones = sum(1 << bits * k for k in range(parts))
            lefts.append(total[at] - before[group])
            for i, side in enumerate((lefts[-1], (total[end] - before)[group] - lefts[-1])):
                sizes[i] += ((side * ones) >> bits * (parts - 1)) & mask  # this part of the product is the sum of the parts
                for k in range(parts):
                    part = (side >> bits * k) & mask
                    part *= part
                    squares[i] += part
        score = squares[0] / sizes[0] + squares[1] / sizes[1]
        if settings.leaf > 1:
            score[(sizes[0] < settings.leaf) | (sizes[1] < settings.leaf)] = -np.inf
        slot = np.repeat(np.arange(nodes), width)[group]
        edge = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        best = np.maximum.reduceat(score, edge)
        stop = np.append(edge[1:], len(slot))
        # Scores that differ by rounding only are equal: the first candidate and the smallest bin win.
        near = np.flatnonzero((score >= np.repeat(best - 1e-9 * np.abs(best), stop - edge)) & (score > -np.inf))
        first = np.append(near, len(slot))[np.searchsorted(near, edge)]
        found = first < stop
        to, first = slot[edge][found], first[found]
        feature[to] = of = candidates.ravel()[group[first]]
        if settings.drawn_thresholds:
            cut = drawn[group[first]]
        else:
            cut = _between(values[of, own[at[first]]], values[of, own[at[first] + 1]])
        split[to] = (values[of] <= cut[:, None]).sum(1) - 1
        for a, left in zip(firsts, lefts):
            parts = np.arange(min(per, kinds - a))
            left_stats[to, a:a + len(parts)] = (left[first][:, None] >> bits * parts) & mask
        return feature, split, left_stats

    def descend(self, grown: Grown) -> None:
        """Move rows to the children of nodes split last; rows in leaves are not needed any more."""
        feature = grown.feature[self.node]
        keep = np.flatnonzero(feature >= 0)
        row, node, weight = self.row[keep], self.node[keep], self.weight[keep]
        right = self.rows.bins.ravel().take(row * self.rows.bins.shape[1] + feature[keep]) > grown.split[node]
        left = grown.left[node]
        self.first = int(left.min(initial=len(grown.feature)))
        child = left - self.first
        child += right
        self.many = np.bincount(child, minlength=len(grown.feature) - self.first)
        # Rows keep their order among those that go to the same side, and come behind those of nodes before.
        sides = np.zeros((2, len(self.many)), np.int64)
        sides[0, ::2], sides[1, 1::2] = self.many[::2], self.many[1::2]
        offset = np.cumsum(self.many) - self.many
        offset[::2] -= (np.cumsum(sides[0]) - sides[0])[::2]
        offset[1::2] -= (np.cumsum(sides[1]) - sides[1])[1::2]
        so_far = np.cumsum(right)
        to = np.where(right, so_far - 1, np.arange(len(right)) - so_far) + offset[child]
        self.row, self.weight, self.node = np.empty_like(row), np.empty_like(weight), np.empty_like(node)
        self.row[to], self.weight[to], self.node[to] = row, weight, child + self.first


class Spread:
    """The same over a DataFrame of counted rows: each aggregate is a job, rows descend from the roots each time."""

    def __init__(self, data: Binned, fit: Fit, seeds: np.ndarray):
        self.data, self.fit, self.seeds, self.grown = data, fit, seeds, None
        self.values = data.values if fit.columns is None else data.values[list(fit.columns)]
        self.stat_count = 3 if fit.settings.squares else data.stat_count

    def _aggregate(self, active=None, candidates=None) -> tuple[np.ndarray, np.ndarray]:
        """Sums by key of a level, or by tree."""
        data, fit = self.data, self.fit
        shared = data.rows.sparkSession.sparkContext.broadcast((self.seeds, self.grown, fit, active, candidates))
        sizes, width = bin_sizes(self.values), len(data.values)

        def run(batches):
            seeds, grown, fit, active, candidates = shared.value
            for batch in batches:
                rows = _rows(batch, width).taking(fit.columns)
                if not len(rows.ids):
                    continue
                local = Local(rows.facing(fit), rows.weights(fit, seeds), sizes)
                for _ in range(grown.levels if grown else 0):  # all nodes of the level are as deep as the trees so far
                    local.descend(grown)
                key, sums = local.by_tree() if active is None else local.level(active, candidates)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.ListArray.from_arrays(_ends(sums), sums.ravel())], names=["key", "sums"])

        part = data.rows.mapInArrow(run, "key long, sums array<double>")
        size = self.stat_count
        found = part.groupBy("key").agg(F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(size)]).alias("sums")).orderBy("key")
        table = found.toArrow().combine_chunks()
        shared.destroy()
        sums = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)
        return table.column("key").to_numpy(), sums.reshape(-1, size)

    def totals(self) -> np.ndarray:
        out = np.zeros((len(self.seeds), self.stat_count))
        key, sums = self._aggregate()
        out[key] = sums
        return out

    def level(self, active, candidates):
        parts, bases = [], _bases(candidates, bin_sizes(self.values))
        for a in range(0, len(active), NODES_IN_JOB):
            key, sums = self._aggregate(active[a:a + NODES_IN_JOB], candidates[a:a + NODES_IN_JOB])
            parts.append((key + bases[a * candidates.shape[1]], sums))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def best(self, active, candidates, keys, totals, values, settings: Settings):
        return choose(*self.level(active, candidates), totals, candidates, keys, values, bin_sizes(values), settings)

    def descend(self, grown: Grown) -> None:
        self.grown = grown


def _ends(matrix: np.ndarray) -> np.ndarray:
    return np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1])


# ---- growing -----------------------------------------------------------------------------------

@dataclass
class Grown:
    """Nodes of a group of trees; the first ones are the roots. ``left`` is followed by the right child; ``value`` is
    what a leaf adds to the classes."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    stats: np.ndarray
    trees: int
    levels: int = 0
    value: np.ndarray | None = None


def _candidates(keys: np.ndarray, features: int, settings: Settings) -> np.ndarray:
    """All features of each node in drawn order (in their own where all are candidates)."""
    if settings.features == "all" and not settings.drawn_thresholds:
        return np.broadcast_to(np.arange(features), (len(keys), features))
    drawn = mix(keys[:, None] ^ mix(np.arange(1, features + 1, dtype=np.uint64))[None, :])
    low = _U((1 << max(features - 1, 1).bit_length()) - 1)  # the last bits name the feature, so that plain numbers are sorted
    return (np.sort((drawn & ~low) | np.arange(features, dtype=np.uint64), axis=1) & low).astype(np.int64)


def _weight(stats: np.ndarray, squares: bool) -> np.ndarray:
    return stats[:, 0] if squares else stats @ np.ones(stats.shape[1])


def _score(stats: np.ndarray, squares: bool) -> np.ndarray:
    """What a side adds to the sum that the best split makes largest: less impurity, or less squared error."""
    if squares:
        return stats[:, 1] ** 2 / np.maximum(stats[:, 0], 1e-300)
    return np.einsum("ij,ij->i", stats, stats) / np.maximum(_weight(stats, False), 1e-300)


def _between(value: np.ndarray, following: np.ndarray) -> np.ndarray:
    cut = (value + following) / 2
    return np.where(cut < following, cut, value)  # between neighbouring numbers the middle rounds to the upper one


def choose(key, sums, totals, candidates, nodes, values, sizes, settings: Settings):
    """Best split of each node: feature (-1: none), its bin and the left side's statistics."""
    n, width = candidates.shape
    feature, split, left_stats = np.full(n, -1), np.zeros(n, np.int64), np.zeros((n, totals.shape[1]))
    if not len(key):
        return feature, split, left_stats
    base = _bases(candidates, sizes)
    group = np.searchsorted(base, key, side="right") - 1
    own = key - base[group]
    slot = group // width
    entry = np.arange(len(key))
    head = np.append(True, group[1:] != group[:-1])
    start = np.maximum.accumulate(np.where(head, entry, 0))
    total = np.cumsum(sums, axis=0)
    left = total - (total[start] - sums[start])
    last = np.append(group[1:] != group[:-1], True)
    rest = np.where(last[:, None], 0.0, totals[slot] - left)
    of = candidates[slot, group % width]
    value = values[of, own]
    following = np.where(last, value, np.append(value[1:], 0.0))
    cut = _between(value, following)
    fine = ~last
    if settings.leaf > 1 or settings.squares:
        fine &= (_weight(left, settings.squares) >= settings.leaf) & (_weight(rest, settings.squares) >= settings.leaf)
    if settings.drawn_thresholds:
        stop = np.append(np.flatnonzero(head)[1:], len(key))[np.cumsum(head) - 1] - 1
        u = uniform(mix(mix(nodes[slot] + _U(7)) ^ mix(of.astype(np.uint64) + _U(11))))
        cut = value[start] + u * (value[stop] - value[start])
        fine &= (value <= cut) & (following > cut)
    score = np.where(fine, _score(left, settings.squares) + _score(rest, settings.squares), -np.inf)
    # Scores that differ by rounding only are equal: the first candidate and the smallest bin win.
    edge = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    best = np.maximum.reduceat(score, edge)
    near = score >= np.repeat(best - 1e-9 * np.abs(best), np.diff(np.append(edge, len(key))))
    first = np.minimum.reduceat(np.where(near & fine, entry, len(key)), edge)
    found = first < len(key)
    at, first = slot[edge][found], first[found]
    feature[at] = of[first]
    split[at] = (values[of[first]] <= cut[first, None]).sum(1) - 1
    left_stats[at] = left[first]
    return feature, split, left_stats


def grow(data, seeds: np.ndarray, values: np.ndarray, settings: Settings) -> Grown:
    """Trees of ``seeds`` over ``data``, which aggregates levels (``Local`` or ``Spread``)."""
    features = len(values)
    most = max(1, round(math.sqrt(features))) if settings.features == "sqrt" else features
    totals, trees = data.totals(), len(seeds)
    out = Grown(np.full(trees, -1), np.zeros(trees, np.int64), np.zeros(trees, np.int64), totals, trees)
    active, keys, depth = np.arange(trees), mix(seeds), 0
    while settings.depth is None or depth < settings.depth:
        own = out.stats[active]
        size = _weight(own, settings.squares)
        pure = np.zeros(len(own), bool) if settings.squares else own.max(1, initial=0) >= size
        open_ = (size >= max(settings.split, 2 * settings.leaf)) & ~pure
        active, keys = active[open_], keys[open_]
        if not len(active):
            break
        order = _candidates(keys, features, settings)
        feature, split, left = np.full(len(active), -1), np.zeros(len(active), np.int64), np.zeros((len(active), totals.shape[1]))
        for offered in (order[:, :most], order[:, most:]):  # the others where none of the first can be split
            todo = np.flatnonzero(feature < 0)
            if not len(todo) or not offered.shape[1]:
                break
            some = offered[todo]
            feature[todo], split[todo], left[todo] = data.best(
                active[todo], some, keys[todo], out.stats[active[todo]], values, settings)
        parted = np.flatnonzero(feature >= 0)
        if not len(parted):
            break
        active, keys, feature, split, left = active[parted], keys[parted], feature[parted], split[parted], left[parted]
        base, many = len(out.feature), 2 * len(active)
        children = base + 2 * np.arange(len(active))
        out.feature[active], out.split[active], out.left[active] = feature, split, children
        both = np.stack([left, out.stats[active] - left], 1).reshape(many, -1)
        out = Grown(np.append(out.feature, np.full(many, -1)), np.append(out.split, np.zeros(many, np.int64)),
                    np.append(out.left, np.zeros(many, np.int64)), np.concatenate([out.stats, both]), trees, out.levels + 1)
        if settings.depth is None or depth + 1 < settings.depth:
            data.descend(out)
        active = np.stack([children, children + 1], 1).ravel()
        keys = mix(np.repeat(keys, 2) * _U(2) + np.tile(np.array([1, 2], np.uint64), len(keys)))
        depth += 1
    return out


def votes(grown: Grown, bins: np.ndarray, chunk: int = 1 << 20, first: int = 0, depth: int | None = None) -> np.ndarray:
    """Sums over the trees, from ``first`` on and cut at ``depth``, of the values of the leaves that rows come to."""
    out = np.zeros((len(bins), grown.value.shape[1]))
    step = max(1, chunk // max(1, len(bins)))
    flat, width = np.ascontiguousarray(bins).ravel(), bins.shape[1]
    start = np.arange(len(bins)) * width
    for a in range(first, grown.trees, step):
        many = min(step, grown.trees - a)
        node, base = np.repeat(np.arange(a, a + many), len(bins)), np.tile(start, many)
        inside = np.arange(len(node))
        for _ in range(grown.levels if depth is None else min(depth, grown.levels)):  # rows in leaves are done
            own = node[inside]
            feature = grown.feature[own]
            inner = feature >= 0
            if not inner.all():
                inside, own, feature = inside[inner], own[inner], feature[inner]
            if not len(inside):
                break
            node[inside] = grown.left[own] + (flat[base[inside] + feature] > grown.split[own])
        out += grown.value[node].reshape(many, len(bins), -1).sum(0)
    return out


def build(data_of: Callable, fit: Fit, first: int, count: int, values: np.ndarray, classes: int) -> Grown:
    """Trees ``first`` to ``first + count`` of a forest, or all of a boosted model; ``data_of`` gives the aggregates
    for a fit and its seeds."""
    s = fit.settings
    if s.kind == "forest":
        seeds = tree_seeds(s, first, count)
        grown = grow(data_of(fit, seeds), seeds, values, s)
        grown.value = _leaf_shares(grown.stats)
        return grown
    if s.kind == "stumps":
        return _boosted_stumps(data_of, fit, values, classes)
    model = None
    for step in range(s.trees):
        new = []
        for c in range(classes):
            seeds = tree_seeds(s, step * classes + c, 1)
            grown = grow(data_of(replace(fit, before=model, target=c), seeds), seeds, values, s)
            grown.value = np.zeros((len(grown.feature), classes))
            curve = np.maximum(grown.stats[:, 2], 1e-12)
            grown.value[:, c] = s.rate * (classes - 1) / classes * grown.stats[:, 1] / curve
            new.append(grown)
        model = _joined([model, *new] if model else new)
    return model


def _leaf_shares(stats: np.ndarray) -> np.ndarray:
    return stats / np.maximum(stats.sum(1), 1e-300)[:, None]


def _boosted_stumps(data_of, fit: Fit, values: np.ndarray, classes: int) -> Grown:
    model, s = None, fit.settings
    for step in range(s.trees):
        seeds = tree_seeds(s, step, 1)
        grown = grow(data_of(replace(fit, before=model), seeds), seeds, values, s)
        leaves = grown.stats[grown.feature < 0]
        error = 1 - leaves.max(1).sum() / max(leaves.sum(), 1e-300)
        if error >= 1 - 1 / classes and model is not None:
            break
        error = min(max(error, 1e-10), 1 - 1e-10)
        say = math.log((1 - error) / error) + math.log(max(classes - 1, 1))
        grown.value = np.eye(classes)[grown.stats.argmax(1)] * (say if say > 0 else 1.0)
        model = _joined([model, grown]) if model else grown
        if error <= 1e-10:
            break
    return model


def finish(found: np.ndarray, kind: str) -> np.ndarray:
    """Probabilities of the classes from summed values."""
    return softmax(found) if kind == "softmax" else found / np.maximum(found.sum(1, keepdims=True), 1e-300)


# ---- binned rows -------------------------------------------------------------------------------

def bin_sizes(values: np.ndarray) -> np.ndarray:
    """Bins of each feature."""
    return np.maximum(np.isfinite(values).sum(1), 1)


@dataclass
class Binned:
    """Counted rows as a written table, with the values that the bins of each feature stand for (padded by infinity)."""

    rows: DataFrame
    values: np.ndarray
    stat_count: int
    coded: DataFrame

    @cached_property
    def fits_in_task(self) -> bool:
        return self.rows.count() * len(self.values) <= ROWS_IN_TASK

    def by_row(self, shares: DataFrame) -> DataFrame:
        """What is known of counted rows (``place``), for the rows that they stand for: their key columns join in."""
        same = [F.col("a.bins") == F.col("b.bins"), F.col("a.stats") == F.col("b.stats"), F.col("a.part") == F.col("b.part")]
        names = [c for c in self.coded.columns if c not in ("bins", "stats", "counts")]
        placed = self.coded.alias("a").join(self.rows.alias("b"), same).select(*[f"a.{c}" for c in names], "b.place")
        return placed.join(shares, "place").drop("place")

    @cached_property
    def shared(self):
        """The rows and the values of bins, sent to all tasks once for all jobs on them."""
        return self.rows.sparkSession.sparkContext.broadcast((self.local, self.values))

    @cached_property
    def local(self) -> Rows:
        """The rows on the driver; only asked for where their number is known to be bounded."""
        table = self.rows.orderBy("id", "place").toArrow().combine_chunks()
        batches = table.to_batches()
        return _rows(batches[0] if batches else pa.RecordBatch.from_pylist([], table.schema), len(self.values))


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _bytes(column) -> np.ndarray:
    """The bytes of all values of a binary column, where they lie."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32) if len(column) else [0]
    own = ends[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[own[0]:own[-1]] if data is not None and own[-1] > own[0] else np.zeros(0, np.uint8)


def _rows(batch, features: int) -> Rows:
    n = batch.num_rows
    bins = _bytes(batch.column("bins")).reshape(n, features)
    stats, counts = (_matrix(batch.column(c), len(batch.column(c)[0]) if n else 1) for c in ("stats", "counts"))
    return Rows(bins, stats, counts, batch.column("part").to_numpy(zero_copy_only=False),
                batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64),
                batch.column("place").to_numpy(zero_copy_only=False))


def bin_values(df: DataFrame, vector: str, width: int) -> np.ndarray:
    """Values that the bins of each feature stand for: all of them, or quantiles where there are more than ``BINS``.

    One aggregate; the driver gets ``BINS`` numbers for each feature.
    """
    points = [(i + 0.5) / BINS for i in range(BINS)]
    each = df.select(F.posexplode(vector).alias("f", "v")).groupBy("f").agg(
        F.percentile_approx("v", points, F.lit(20_000)).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    found = {r["f"]: np.unique([*r["q"], r["lo"], r["hi"]]) for r in each}
    size = max([len(v) for v in found.values()], default=1)
    out = np.full((width, size), np.inf)
    for f, v in found.items():
        out[f, :len(v)] = v
    return out


def to_bins(vectors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Bins of feature vectors: between two values the nearer one, the smaller on a tie."""
    out = np.zeros(vectors.shape, np.uint8)
    for f in range(vectors.shape[1]):
        own = values[f][np.isfinite(values[f])]
        if len(own) > 1:
            out[:, f] = np.searchsorted((own[1:] + own[:-1]) / 2, vectors[:, f], side="left")
    return out


def binned(df: DataFrame, vector: str, stats: Sequence, *, counts: Sequence = (), part=None, keys: Sequence[str] = ()) -> Binned:
    """Counted rows of ``df``: ``vector`` is an array column, ``stats`` the target's statistics of one row (for classes
    a 0/1 column each), ``counts`` how often each sample has the row (once, by default) and ``part`` its fold."""
    counts = list(counts) or [F.lit(1)]
    chosen = materialize(df.select(
        *keys, F.col(vector).alias("vector"), F.array(*[s.cast("double") for s in stats]).alias("stats"),
        F.array(*[c.cast("long") for c in counts]).alias("counts"), (F.lit(0) if part is None else part).cast("int").alias("part")))
    first = chosen.select(F.size("vector").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    width = first["n"]  # 0 where no feature was kept: every tree is a leaf then
    values = bin_values(chosen, "vector", width)
    shared = df.sparkSession.sparkContext.broadcast(values)
    rest = [c for c in chosen.columns if c != "vector"]

    def run(batches):
        for batch in batches:
            found = to_bins(_matrix(batch.column("vector"), width), shared.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row.tobytes() for row in found], pa.binary()), *(batch.column(c) for c in rest)], names=["bins", *rest])

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    coded = materialize(chosen.mapInArrow(run, ", ".join(["bins binary", *[f"`{c}` {kinds[c]}" for c in rest]])))
    sums = [F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(len(counts))]
    rows = coded.groupBy("bins", "stats", "part").agg(*sums).select(
        "bins", "stats", F.array(*[f"c{i}" for i in range(len(counts))]).alias("counts"), "part",
        F.xxhash64("bins", "stats", "part").alias("id"), F.monotonically_increasing_id().alias("place"))
    return Binned(materialize(rows), values, len(stats), coded)


# ---- many forests at once ----------------------------------------------------------------------

_TREES = "fit int, first long, trees long, levels int, feature binary, split binary, left binary, stats binary, value binary, small boolean"


def _packed(fit: int, first: int, grown: Grown, kind: str) -> pa.RecordBatch:
    """A row of a table of trees; the values of forests follow from the statistics, whole numbers that few bytes hold."""
    small = kind == "forest" and grown.stats.max(initial=0) < 1 << 16
    value = b"" if kind == "forest" else grown.value.astype(np.float64).tobytes()
    return pa.RecordBatch.from_pylist([{
        "fit": fit, "first": first, "trees": grown.trees, "levels": grown.levels,
        "feature": grown.feature.astype(np.int16).tobytes(), "split": grown.split.astype(np.int16).tobytes(),
        "left": grown.left.astype(np.int32).tobytes(), "stats": grown.stats.astype(np.uint16 if small else np.float64).tobytes(), "value": value, "small": small}], schema=_SCHEMA)


_SCHEMA = pa.schema([("fit", pa.int32()), ("first", pa.int64()), ("trees", pa.int64()), ("levels", pa.int32()),
                     *[(c, pa.binary()) for c in ("feature", "split", "left", "stats", "value")], ("small", pa.bool_())])


def _unpacked(row: dict) -> Grown:
    get = lambda name, kind: np.frombuffer(row[name], kind).astype(np.int64)
    feature = get("feature", np.int16)
    stats = np.frombuffer(row["stats"], np.uint16 if row["small"] else np.float64).astype(np.float64).reshape(len(feature), -1)
    value = np.frombuffer(row["value"], np.float64).reshape(len(feature), -1) if row["value"] else _leaf_shares(stats)
    return Grown(feature, get("split", np.int16), get("left", np.int32), stats, row["trees"], row["levels"], value)


def _chunks(fits: Sequence[Fit], rows: int, features: int, cores: int, together: int = 512, spans=None) -> list[tuple[int, int, int]]:
    """(fit, first tree, trees) of bounded work, some for each core, for all trees or those of ``spans``."""
    out, spans = [], spans or [(0, fit.settings.trees) for fit in fits]
    together = min(together, math.ceil(sum(end - begin for begin, end in spans) / (4 * cores)))
    for i, fit in enumerate(fits):
        s = fit.settings
        begin, end = spans[i]
        if s.kind != "forest":
            out.append((i, 0, s.trees))
            continue
        width = features if s.features == "all" else max(1, round(math.sqrt(features)))
        step = max(1, min(together, ENTRIES // max(1, rows * width)))
        out += [(i, a, min(step, end - a)) for a in range(begin, end, step)]
    return out


def _in_tasks(data: Binned, fits: Sequence[Fit], schema: str, emit: Callable, summed: bool = False, **more) -> DataFrame:
    """``emit(fit number, (first tree, grown) of groups, rows)`` of all forests, each group grown whole in a task.

    A call has one group, or with ``summed`` as many as leave some calls for each core, ``TREES_SUMMED`` trees at most.
    """
    spark = data.rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    chunks = _chunks(fits, len(data.local.ids), len(data.values), cores, **more)
    most = min(TREES_SUMMED, math.ceil(sum(n for *_, n in chunks) / (8 * cores))) if summed else 0
    calls = []
    for fit, first, count in chunks:
        if calls and calls[-1][0] == fit and calls[-1][2] + count <= most:
            calls[-1][2] += count
        else:
            calls.append([fit, first, count, count])
    shared, fits = data.shared, list(fits)
    # Calls differ in depth: neighbours are dealt over the tasks, of which each core has some.
    tasks = min(len(calls), 16 * cores)
    dealt = spark.sparkContext.broadcast([calls[i] for t in range(tasks) for i in range(t, len(calls), tasks)])

    def run(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                rows, values = shared.value
                number, first, trees, step = dealt.value[i]
                fit, end = fits[number], first + trees
                rows = replace(rows.taking(fit.columns))  # what it keeps is of this model
                values = values if fit.columns is None else values[list(fit.columns)]
                sizes = bin_sizes(values)
                groups = ((a, build(lambda f, seeds: Local(rows.facing(f), rows.weights(f, seeds), sizes), fit, a,
                                    min(step, end - a), values, rows.stats.shape[1]))
                          for a in range(first, end, step))
                yield from emit(number, groups, rows)

    return spark.range(len(calls), numPartitions=tasks).mapInArrow(run, schema)


def grow_forests(data: Binned, fits: Sequence[Fit], together: int = 512) -> DataFrame:
    """The trees of all forests as a written table, a row for each group of trees, ``together`` at most."""
    if data.fits_in_task:
        return materialize(_in_tasks(data, fits, _TREES, lambda fit, groups, rows: (
            _packed(fit, first, grown, fits[fit].settings.kind) for first, grown in groups), together=together))
    spark, tables = data.rows.sparkSession, []
    for i, fit in enumerate(fits):
        step = min(64, together) if fit.settings.kind == "forest" else fit.settings.trees
        for first in range(0, fit.settings.trees, step):
            values = data.values if fit.columns is None else data.values[list(fit.columns)]
            grown = build(lambda f, seeds: Spread(data, f, seeds), fit, first, min(step, fit.settings.trees - first),
                          values, data.stat_count)
            tables.append(spark.createDataFrame(pa.Table.from_batches([_packed(i, first, grown, fit.settings.kind)]), _TREES))
        tables = [materialize(_union(tables))]
    return tables[0]


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def families(fits: Sequence[Fit]) -> tuple[list[Fit], list[tuple[int, int]], list[list[int]]]:
    """Models whose trees serve several of ``fits``, the spans of trees that are needed, and the fits that take them.

    What a tree draws follows from its number, and what a node does from its own rows, so that forests that differ only in
    the number and depth of trees and in the rows that a node needs to be split have the same ones, cut there.
    """
    alike = {}
    for i, fit in enumerate(fits):
        s = fit.settings
        alike.setdefault(replace(fit, settings=replace(s, trees=0, depth=None, split=0)) if s.kind == "forest" else i, []).append(i)
    models, spans, members = [], [], []
    for group in alike.values():
        begin = 0
        for end in sorted({fits[i].settings.trees for i in group}):
            taking = [i for i in group if fits[i].settings.trees >= end]
            depths = [fits[i].settings.depth for i in taking]
            own = replace(fits[taking[0]].settings, trees=end, depth=None if None in depths else max(depths),
                          split=min(fits[i].settings.split for i in taking))
            models.append(replace(fits[taking[0]], settings=own))
            spans.append((begin, end))
            members.append(taking)
            begin = end
    return models, spans, members


def left_out_shares(data: Binned, fits: Sequence[Fit], trees: DataFrame | None = None) -> DataFrame:
    """(``fit``, ``place``, ``shares``): each model's probabilities for the rows of the part that it did not see; ``trees``
    are those of ``grow_forests`` where they are grown already."""
    kinds = [fit.settings.kind for fit in fits]

    def emit(fit, groups, rows, taking=None):
        at, taking, sums = np.flatnonzero(rows.part == fits[fit].leave_out), taking or [fit], {}
        bins, of = rows.bins[at], {}
        for _, grown in groups:
            found, added, size = {}, {}, _weight(grown.stats, False)
            for i in taking:
                s = fits[i].settings
                forest, depth = s.kind == "forest", grown.levels if s.depth is None else min(s.depth, grown.levels)
                of[i] = (s.depth, max(s.split, 2 * s.leaf)) if forest else (None, 0)
                own = (depth, of[i][1]) if forest else (grown.levels, 0)
                if own not in found:
                    cut = replace(grown, feature=np.where(size >= own[1], grown.feature, -1)) if forest else grown
                    found[own] = votes(cut, bins, depth=own[0])
                added[of[i]] = found[own]
            for key, v in added.items():
                sums[key] = sums[key] + v if key in sums else v
        for i in taking:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), i, np.int32)), pa.array(rows.places[at]), _lists(sums[of[i]])], names=["fit", "place", "votes"])

    schema, size = "fit int, place long, votes array<double>", data.stat_count
    if data.fits_in_task and trees is None:
        models, spans, members = families(fits)
        part = _in_tasks(data, models, schema, lambda model, groups, rows: emit(
            members[model][0], groups, rows, members[model]), summed=True, spans=spans)
    elif data.fits_in_task:
        shared = data.shared

        def grown(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    (r,) = batch.slice(i, 1).to_pylist()
                    yield from emit(r["fit"], [(r["first"], _unpacked(r))], shared.value[0].taking(fits[r["fit"]].columns))

        part = trees.mapInArrow(grown, schema)
    else:
        trees, width, tables = grow_forests(data, fits) if trees is None else trees, len(data.values), []
        for r in trees.toLocalIterator():
            shared = trees.sparkSession.sparkContext.broadcast(_unpacked(r.asDict()))

            def run(batches, i=r["fit"], shared=shared):
                for batch in batches:
                    yield from emit(i, [(0, shared.value)], _rows(batch, width).taking(fits[i].columns))

            tables.append(materialize(data.rows.where(F.col("part") == fits[r["fit"]].leave_out).mapInArrow(run, schema)))
            shared.destroy()
        part = _union(tables)
    summed = part.groupBy("fit", "place").agg(F.array(*[F.sum(F.get("votes", F.lit(k))) for k in range(size)]).alias("votes"))
    soft = F.col("fit").isin([i for i, k in enumerate(kinds) if k == "softmax"])
    up = F.when(soft, F.transform("votes", lambda v: F.exp(v - F.array_max("votes")))).otherwise(F.col("votes"))
    total = F.aggregate("up", F.lit(0.0), lambda a, v: a + v)
    return summed.withColumn("up", up).select("fit", "place", F.transform("up", lambda v: v / F.greatest(total, F.lit(1e-300))).alias("shares"))


# ---- estimators --------------------------------------------------------------------------------

def _joined(groups: Sequence[Grown]) -> Grown:
    """Groups of trees as one: all roots first."""
    base = sum(g.trees for g in groups)
    heads, tails = [], []
    for g in groups:
        whole = g.feature, g.split, g.left + (base - g.trees), g.stats, g.value
        heads.append([x[:g.trees] for x in whole])
        tails.append([x[g.trees:] for x in whole])
        base += len(g.feature) - g.trees
    feature, split, left, stats, value = (np.concatenate(x) for x in zip(*heads, *tails))
    return Grown(feature, split, left, stats, sum(g.trees for g in groups), max(g.levels for g in groups), value)


@dataclass
class Trees:
    """An estimator: ``fit`` gives a model with ``transform``, which adds ``probability`` and ``prediction``."""

    settings: Settings = field(default_factory=Settings)
    features: str = "features"
    label: str = "label"

    def copy(self, **changes) -> Trees:
        return replace(self, settings=replace(self.settings, **changes))

    def fit(self, df: DataFrame) -> TreesModel:
        classes = class_count(df, self.label)
        data = binned(df.withColumn("_vector", vector_to_array(self.features)), "_vector", one_hot(self.label, classes))
        return load_model(grow_forests(data, [Fit(self.settings)]), data, 0, self.settings.kind, self.features)


def class_count(df: DataFrame, label: str) -> int:
    found = df.agg(F.max(label)).first()[0]
    if found is None:
        raise ValueError("no rows to learn from")
    return int(found) + 1


def one_hot(label: str, classes: int) -> list:
    return [(F.col(label) == c).cast("double") for c in range(classes)]


def load_model(trees: DataFrame, data: Binned, fit: int, kind: str = "forest", features: str = "features") -> TreesModel:
    """The model of one fit of a table of trees."""
    return TreesModel(trees.where(F.col("fit") == fit), data.values, data.stat_count, kind, features)


def importances(trees: DataFrame, fit: int, features: int) -> np.ndarray:
    """Importances of the features of one fit of a table of trees."""
    return TreesModel(trees.where(F.col("fit") == fit), np.zeros((features, 1)), 0).featureImportances


def gains(g: Grown, features: int) -> np.ndarray:
    """Sum over the trees of what the splits of each feature take off the impurity, as shares of a tree."""
    impurity = _weight(g.stats, False) - _score(g.stats, False)
    inner = np.flatnonzero(g.feature >= 0)
    gain = impurity[inner] - impurity[g.left[inner]] - impurity[g.left[inner] + 1]
    owner = np.arange(len(g.feature))
    owner[g.left[inner]] = owner[g.left[inner] + 1] = inner
    while (above := owner[owner])[inner].max(initial=0) >= g.trees:  # twice as far up each time
        owner = above
    owner = owner[owner]
    each = np.bincount(owner[inner] * features + g.feature[inner], gain, g.trees * features).reshape(g.trees, features)
    sums = each.sum(1, keepdims=True)
    return np.divide(each, sums, out=np.zeros_like(each), where=sums > 0).sum(0)


@dataclass
class TreesModel:
    """Trees as rows of a written table; the driver holds none of them unless ``grown`` is asked for."""

    trees: DataFrame
    values: np.ndarray
    classes: int
    kind: str = "forest"
    features: str = "features"

    @cached_property
    def grown(self) -> Grown:
        """All trees, on the driver."""
        rows = self.trees.orderBy("first").toArrow().to_pylist()
        return _joined([_unpacked(r) for r in rows])

    @cached_property
    def small(self) -> bool:
        """Whether the trees may go to every task."""
        return node_count(self.trees)[0] <= NODES_SENT

    def transform(self, df: DataFrame) -> DataFrame:
        out = self._beside(df) if self.small else self._by_blocks(df)
        first = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return out.withColumns({"probability": array_to_vector("_shares"), "prediction": first}).drop("_shares")

    def _beside(self, df: DataFrame) -> DataFrame:
        shared, kind = df.sparkSession.sparkContext.broadcast((self.grown, self.values)), self.kind

        @F.pandas_udf("array<double>")
        def shares(vectors):
            grown, values = shared.value
            if not len(vectors):
                return vectors
            found = finish(votes(grown, to_bins(np.stack(vectors.to_list()), values)), kind)
            return type(vectors)([*found], index=vectors.index)

        return df.withColumn("_shares", shares(vector_to_array(self.features)))

    def _by_blocks(self, df: DataFrame) -> DataFrame:
        """Groups of trees meet blocks of rows; the votes of a row are added up over the groups."""
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
        found = vote_sums(self.trees, rows, self.features, self.values, self.classes).drop("fit")
        return rows.join(shares_of(found, ["_row"], self.kind, self.classes), "_row").drop("_row")

    @property
    def featureImportances(self) -> np.ndarray:  # noqa: N802  named as in the other models
        """Mean over the trees of what the splits of each feature take off the impurity, as shares."""
        many = len(self.values)

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    yield pa.RecordBatch.from_pylist([{"first": row["first"], "gains": gains(_unpacked(row), many).tolist()}])

        # Sorted here: a sort in Spark reads the trees twice.
        found = sorted(self.trees.mapInArrow(run, "first long, gains array<double>").collect(), key=lambda r: r["first"])
        each = np.array([r["gains"] for r in found]).reshape(-1, many).sum(0)
        total = each.sum()
        return each / total if total else each


# ---- trees and rows that both lie apart --------------------------------------------------------

def blocks_of(rows: DataFrame, vector: str, values: np.ndarray) -> DataFrame:
    """(``ids``, ``bins``): rows with ``_row`` as blocks, a block for each batch that Arrow makes."""
    shared = rows.sparkSession.sparkContext.broadcast(values)
    width = len(values)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = to_bins(_matrix(batch.column("vector"), width), shared.value)
                yield pa.RecordBatch.from_pylist([{
                    "block": int(batch.column("_row")[0].as_py()), "many": len(found),
                    "ids": batch.column("_row").to_numpy().astype(np.int64).tobytes(), "bins": found.tobytes()}])

    return rows.select("_row", vector_to_array(vector).alias("vector")).mapInArrow(
        run, "block long, many long, ids binary, bins binary")


def node_count(trees: DataFrame) -> tuple[int, int]:
    """Nodes of a table of trees, and its rows."""
    nodes, groups = trees.agg(F.sum(F.length("feature")), F.count(F.lit(1))).first()
    return (nodes or 0) // 2, groups


def meet(trees: DataFrame, blocks: DataFrame, width: int, row_bytes: int, schema: str, fields: pa.Schema,
         emit: Callable) -> DataFrame:
    """``emit((fit, grown) of groups, ids, bins)`` of all trees and all rows, which take ``row_bytes`` each. Both are dealt
    into parts of bounded size; a part of trees meets each part of rows."""
    blocks = materialize(blocks)
    size = (blocks.agg(F.sum("many")).first()[0] or 0) * row_bytes
    nodes, groups = node_count(trees)
    many, cores = max(1, math.ceil(size / BYTES_OF_ROWS)), trees.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(groups, max(math.ceil(nodes / (4 * NODES_SENT)), math.ceil(2 * cores / many))))
    of_rows = F.pmod(F.xxhash64("block"), F.lit(many)).cast("int")
    of_trees = F.pmod(F.xxhash64("fit", "first"), F.lit(parts)).cast("int")
    ts = trees.withColumn("_t", of_trees).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    rs = blocks.withColumn("_b", of_rows).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(group, own):
        if not group.num_rows or not own.num_rows:
            return fields.empty_table()
        ids = np.frombuffer(b"".join(own.column("ids").to_pylist()), np.int64)
        bins = np.frombuffer(b"".join(own.column("bins").to_pylist()), np.uint8).reshape(len(ids), width)
        trees = (group.slice(i, 1).to_pylist()[0] for i in range(group.num_rows))
        return emit(((r["fit"], _unpacked(r)) for r in trees), ids, bins)

    spread = max(1, min(many * parts, 4 * cores))
    keys = ["_b", "_t"]
    ts, rs = (d.repartition(spread, *keys) for d in (ts, rs))
    return ts.groupBy(*keys).cogroup(rs.groupBy(*keys)).applyInArrow(run, schema)


def vote_sums(trees: DataFrame, rows: DataFrame, vector: str, values: np.ndarray, classes: int) -> DataFrame:
    """(``fit``, ``_row``, ``votes``): votes of the trees of each fit for each row."""
    def voted(groups, ids, bins):
        sums = {}
        for fit, grown in groups:
            found = votes(grown, bins)
            sums[fit] = sums[fit] + found if fit in sums else found
        return pa.table({"fit": pa.array(np.repeat(np.array([*sums], np.int32), len(ids))), "_row": np.tile(ids, len(sums)),
                         "votes": _lists(np.concatenate([*sums.values()]))})

    size = max(len(values), 8 * classes)
    part = meet(trees, blocks_of(rows, vector, values), len(values), size, "fit int, _row long, votes array<double>",
                pa.schema([("fit", pa.int32()), ("_row", pa.int64()), ("votes", pa.list_(pa.float64()))]), voted)
    return part.groupBy("fit", "_row").agg(
        F.array(*[F.sum(F.get("votes", F.lit(k))) for k in range(classes)]).alias("votes"))


def shares_of(found: DataFrame, keys: Sequence[str], kind: str, classes: int) -> DataFrame:
    """(``keys``, ``_shares``) of summed votes. Whatever order they were added in, equal sums stay equal."""
    each = [F.round(F.get("votes", F.lit(k)), 9) for k in range(classes)]
    if kind == "softmax":
        top = F.greatest(*each) if classes > 1 else each[0]
        each = [F.exp(x - top) for x in each]
    total = F.greatest(sum(each[1:], each[0]), F.lit(1e-300))
    return found.select(*keys, F.array(*[x / total for x in each]).alias("_shares"))


def _lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; a batch of Arrow has fewer than 2^31 values."""
    return pa.ListArray.from_arrays(_ends(matrix), matrix.ravel())
