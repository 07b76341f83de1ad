"""Benchmark decontamination with suffix arrays over shards of the training texts.

Each shard, a bounded slice of documents, numbers its words by the vocabulary of the benchmark and sorts the
suffixes that could match at all. Every test suffix is looked up by binary search; the interval found gives
the places where it occurs word for word, and places that continue each other give the longest matches.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.texts import fields, map_texts, packed

#: Everything that is not a word character becomes a space, A-Z lower case; bytes from 0x80 on are letters.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32
               for c in range(256))
MATCHES = fields("n_words bigint, n_hit bigint, items array<string>, longest bigint, hit_starts array<int>, "
                 "hit_ends array<int>")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class TestSuffixes:
    """Vocabulary and windows of one block of the benchmark."""

    __test__ = False

    def __init__(self, items: list[tuple], width: int):
        self.width, self.vocabulary = width, {}
        found: dict[tuple, set] = {}
        number = self.vocabulary.setdefault
        bodies: dict[tuple, set] = {}
        for name, text in items:
            ids = tuple(number(w, len(self.vocabulary)) for w in words((text or "").encode()))
            bodies.setdefault(ids, set()).add(None if name is None else str(name))
        places: dict[tuple, list] = {}
        place = 0
        for ids, own in bodies.items():
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(ids[i:i + width], set()).update(own)
                places.setdefault(ids[i:i + width], []).append(place + i)
            place += len(ids) + 1
        self.windows = list(found)
        self.places = np.array([p for w in self.windows for p in places[w]], np.int64)
        self.places_end = np.cumsum([len(places[w]) for w in self.windows], dtype=np.int64)
        self.names = [sorted(n for n in found[w] if n is not None) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.shortest = int(self.lengths.min()) if found else 0
        low = np.zeros((len(found), width), ">u4")
        for i, w in enumerate(self.windows):
            low[i, :len(w)] = np.array(w) + 1
        high = low.copy()
        if found:
            high[np.arange(len(found)), self.lengths - 1] += 1
        self.low, self.high = _keys(low), _keys(high)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings in the same order."""
    return np.ascontiguousarray(rows).view(f"S{4 * rows.shape[1]}").ravel()


def find(texts: list[bytes | None], tests: TestSuffixes) -> list[list]:
    """``MATCHES`` of one shard."""
    get, parts, counts = tests.vocabulary.get, [], []
    for text in texts:
        found = words(text)
        counts.append(len(found))
        parts.append(np.fromiter(map(get, found, repeat(-1)), np.int64, len(found)))
        parts.append(np.full(1, -1))  # no match crosses documents
    n = len(texts)
    starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])[:-1]
    hits, names, longest = [0] * n, [()] * n, [0] * n
    runs = [[] for _ in range(n)], [[] for _ in range(n)]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(tests.windows):
        place = np.arange(len(ids))
        unknown = np.where(ids < 0, place, len(ids))
        known = np.minimum.accumulate(unknown[::-1])[::-1] - place  # words up to the next unknown one
        suffixes = np.flatnonzero(known >= tests.shortest)
        if len(suffixes):
            at, which = _search(ids, known, suffixes, tests)
            if len(at):
                _collect(at, which, ids, starts, tests, hits, names, longest, runs)
    return [counts, hits, names, longest, *runs]


def _search(ids, known, suffixes, tests):
    """Pairs (place, window) of all occurrences."""
    rows = np.zeros((len(suffixes), tests.width), ">u4")
    reach = known[suffixes]
    for k in range(tests.width):
        inside = reach > k
        rows[inside, k] = ids[suffixes[inside] + k] + 1
    keys = _keys(rows)
    order = np.argsort(keys, kind="stable")  # the suffix array, as deep as a window is long
    keys = keys[order]
    first, last = np.searchsorted(keys, tests.low), np.searchsorted(keys, tests.high)
    many = last - first
    which = np.repeat(np.arange(len(many)), many)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    return suffixes[order[first[which] + inner]], which


def _collect(at, which, ids, starts, tests, hits, names, longest, runs):
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + tests.lengths[which], -1)
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    begin = np.flatnonzero(covered[1:] & ~covered[:-1])
    end = np.flatnonzero(~covered[1:] & covered[:-1])
    for d, a, b in zip((np.searchsorted(starts, begin, side="right") - 1).tolist(), begin.tolist(), end.tolist()):
        hits[d] += b - a
        runs[0][d].append(a - int(starts[d]))
        runs[1][d].append(b - int(starts[d]))
    for d, size in _longest(at, which, tests, starts):
        longest[d] = max(longest[d], size)
    docs = np.searchsorted(starts, at, side="right") - 1
    seen: dict[int, set] = {}
    for d, w in np.unique(np.stack([docs, which], 1), axis=0).tolist():
        seen.setdefault(d, set()).update(tests.names[w])
    for d, s in seen.items():
        names[d] = sorted(s)


def _longest(at, which, tests, starts):
    """(document, words) of the matches that continue in text and item alike, each as long as it goes."""
    many = np.diff(tests.places_end, prepend=0)[which]
    first = (tests.places_end[which] - many)
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    here, there = np.repeat(at, many), tests.places[np.repeat(first, many) + inner]
    order = np.lexsort((here, here - there))
    here, there, size = here[order], there[order], tests.lengths[np.repeat(which, many)[order]]
    new = np.concatenate([[True], (np.diff(here) != 1) | (np.diff(there) != 1)])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(here)) - 1
    found = here[tail] + size[tail] - here[head]
    return zip((np.searchsorted(starts, here[head], side="right") - 1).tolist(), found.tolist())


def match_benchmark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id",
                    item_text: str = "text", width: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with what of each text stands word for word in ``benchmark``.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``items`` (names of the items with
    occurring windows, sorted as strings), ``longest`` (words of the longest verbatim match of at least a window, or of a
    whole shorter item; else 0) and the covered runs of words ``hit_starts``/``hit_ends``. A window is ``width`` consecutive words of an item, or a whole shorter item.

    The benchmark is the query set. It is taken in blocks of about ``block_bytes`` of text, which alone are
    collected and broadcast, one pass over the texts for each block; there is no shuffle within a pass.
    Null texts have no words; items without words match nothing; an item without a name marks words but is
    not listed; repeated items count once; empty tables give no matches.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("name"), F.col(item_text).alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out = docs
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("name", "body"), F.lit(blocks)) == k)
        tests = spark.sparkContext.broadcast(TestSuffixes([tuple(r) for r in block.collect()], width))
        if k == 0:
            out = map_texts(docs, MATCHES, lambda texts, t=tests: find(texts, t.value), text)
            continue
        earlier = F.struct(*[F.col(c) for c in MATCHES.names])
        out = map_texts(out.withColumn("__earlier", earlier), MATCHES, lambda texts, t=tests: find(texts, t.value), text)
        out = _merged(out)
    return out


def _merged(rows: DataFrame) -> DataFrame:
    """Matches of two blocks as one."""
    old = lambda c: F.col(f"__earlier.{c}")
    pairs = F.array_sort(F.concat(F.arrays_zip(old("hit_starts").alias("s"), old("hit_ends").alias("e")),
                                  F.arrays_zip(F.col("hit_starts").alias("s"), F.col("hit_ends").alias("e"))))
    none = F.lit(None).cast("array<struct<s:int,e:int>>")
    joined = F.aggregate(
        pairs, F.coalesce(none, F.array().cast("array<struct<s:int,e:int>>")),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["e"] >= x["s"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(done, F.array(x))))
    rows = rows.withColumn("__runs", joined)
    size = lambda x: (x["e"] - x["s"]).cast("long")
    return rows.withColumns({
        "n_hit": F.aggregate("__runs", F.lit(0).cast("long"), lambda a, x: a + size(x)),
        "longest": F.greatest(old("longest"), F.col("longest")),
        "items": F.array_sort(F.array_union(old("items"), F.col("items"))),
        "hit_starts": F.col("__runs.s"), "hit_ends": F.col("__runs.e")}).drop("__runs", "__earlier")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text shares no window with ``benchmark``."""
    found = match_benchmark(packed(docs, options.pop("text", "text")), benchmark, **options)
    return found.where("n_hit = 0").select("row.*")
