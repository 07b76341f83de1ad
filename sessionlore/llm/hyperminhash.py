"""Near-duplicate documents by HyperMinHash sketches, banded and then confirmed on full shingle sets.

A sketch has a register per bucket: of the smallest hash in it, the number of leading zeros and the mantissa bits
after them, 16 bits together. Bands of registers bring candidates together; the estimate of the Jaccard
similarity from all registers, corrected for accidental collisions, comes before the full sets are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.linking import components, join_split, merged
from sessionlore.llm.rolling import Words, mix, stretches
from sessionlore.llm.texts import raw, steps
from sessionlore.session import materialize

BUCKETS, MANTISSA, BAND = 128, 10, 5
BANDS = BUCKETS // BAND
STEP = 1 << 20
_EMPTY = 0xFFFF
#: Standard errors that the estimate may lie under the wanted similarity.
_MARGIN = 5.0
#: Rounds in which members meet a leading member of their bands, and then of their rare shingles, before all that is
#: left is compared.
_ROUNDS, _RARE_ROUNDS = 2, 2
#: Rare shingles of a set up to which each carries the ones before it.
_LISTED = 32


def shingle_sets(texts, size: int):
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    span = np.minimum(words.count, size)
    many = np.where(span, words.count - span + 1, 0)
    owner = np.repeat(np.arange(len(many)), many)
    begin = words.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    found = stretches(hashes, begin, begin + span[owner])
    ends = np.cumsum(many)
    return [np.unique(found[e - n:e]) for e, n in zip(ends.tolist(), many.tolist())]


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set."""
    spread = mix(shingles ^ np.uint64(0x9FB21C651E98DF25))
    low = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, (spread % np.uint64(BUCKETS)).astype(np.int64), spread // np.uint64(BUCKETS))
    filled = low != np.iinfo(np.uint64).max
    width = 64 - BUCKETS.bit_length() + 1  # bits of a value in a bucket
    value = np.where(filled, low, 1)
    size = np.frexp(value.astype(np.float64))[1].astype(np.int64)  # bits of the value
    size = np.where(value >> np.minimum(size, 63).astype(np.uint64) > 0, size + 1, size)
    size = np.where(value >> (size - 1).astype(np.uint64) == 0, size - 1, size)
    shift = np.maximum(size - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (value >> shift) & np.uint64((1 << MANTISSA) - 1)
    zeros = np.minimum(width - size, 62).astype(np.uint64)
    return np.where(filled, zeros << np.uint64(MANTISSA) | mantissa, _EMPTY).astype(np.uint16)


_PROBES = np.array([np.random.default_rng(i).permutation(BUCKETS) for i in range(BUCKETS)])


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """Hashes of the bands of sketches in rows; an empty register borrows from the next filled one in its own order."""
    sketches = sketches.copy()
    gaps = np.flatnonzero((sketches == _EMPTY).any(1))
    for part in np.array_split(gaps, len(gaps) // 500 + 1):
        filled = sketches[part] != _EMPTY
        source = _PROBES[np.arange(BUCKETS), filled[:, _PROBES].argmax(2)]
        sketches[part] = np.where(filled, sketches[part], np.take_along_axis(sketches[part], source, 1))
    bands = sketches[:, :BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(BAND):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, sizes_a, sizes_b):
    """Jaccard estimates of pairs of sketches (in rows), less the expected collisions, and registers in use."""
    used = (a != _EMPTY) | (b != _EMPTY)
    same = ((a == b) & used).sum(-1)
    used = used.sum(-1)
    ratio = 4.0 * sizes_a * sizes_b / (np.asarray(sizes_a, float) + sizes_b) ** 2
    accidental = 0.169919487159739 * BUCKETS * 2.0 ** -MANTISSA * ratio  # from the HyperMinHash paper
    return np.maximum(same - accidental, 0) / np.maximum(used, 1), used


def _sketch_rows(size):
    def run(batches):
        for batch in steps(batches, "text", STEP):
            sets = shingle_sets(raw(batch, "text"), size)
            one = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            two = [int(mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "sketch"])

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _band_rows(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("sketch"))).ravel()
            owner = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("node").take(owner)], names=["key", "node"])


def _exact_sets(texts, size):
    """Rows of word numbers, one for each distinct shingle of each text; equal words have equal numbers."""
    number: dict[bytes, int] = {}
    out = []
    for text in texts:
        words = (text or b"").lower().split()
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        width = max(1, min(size, len(ids)))
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, width) if len(ids) else ids.reshape(0, 1))
        out.append(np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * width))).ravel()))
    return out


def _confirm(size, percent):
    """Pairs of texts whose sketches, and then whose full sets of shingles, word by word, are similar enough."""

    def run(batches):
        for batch in batches:
            for part in steps([batch], "text_u", STEP):
                a, b = _matrix(part.column("sketch_u")), _matrix(part.column("sketch_v"))
                likely = _likely(a, b, part.column("n_u").to_numpy(), part.column("n_v").to_numpy(), percent)
                good = []
                for i in np.flatnonzero(likely).tolist():
                    s, t = _exact_sets([part.column(c)[i].as_buffer().to_pybytes() for c in ("text_u", "text_v")], size)
                    common = len(np.intersect1d(s, t, assume_unique=True)) if s.dtype == t.dtype else 0
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        good.append(i)
                if good:
                    yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(good)) for c in ("u", "v")], names=["u", "v"])

    return run


def _likely(a, b, n_a, n_b, percent):
    found, used = estimate(a, b, n_a, n_b)
    wanted = percent / 100
    close = found >= wanted - _MARGIN * np.sqrt(wanted * (1 - wanted) / np.maximum(used, 1))
    return close & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def _shingle_rows(size):
    """The shingle hashes of each text, a row each."""

    def run(batches):
        for batch in batches:
            for part in steps([batch], "text", STEP):
                sets = shingle_sets(raw(part, "text"), size)
                owner = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(owner) for c in ("node", "component", "peers", "n_shingles")),
                     pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))],
                    names=["node", "component", "peers", "n_shingles", "shingle"])

    return run


def _prefixes(open_: DataFrame, content: DataFrame, size: int, percent: int) -> DataFrame:
    """The rarest shingles of members, as far as two similar sets must have one of them in common.

    Sets are read in one order: shingles that only one component has, then the others by their number of sets. Two
    sets of which at least ``k`` shingles are common share one among the first n - k + 1 of each; ``place`` is a
    shingle's place and ``before``, of short lists, the ones ahead of it. A set with too few shingles that another
    component has drops out whole.
    """
    state = open_.select("node", "component", "peers").distinct()
    rows = content.join(state, "node").select("node", "component", "peers", "n_shingles", "text").mapInArrow(
        _shingle_rows(size), "node long, component long, peers long, n_shingles long, shingle long")
    crossing = rows.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    crossing = crossing.where("lo < hi").select("shingle", "sets")
    lists = join_split(rows, crossing, "shingle").groupBy("node", "component", "peers", "n_shingles").agg(
        F.sort_array(F.collect_list(F.struct("sets", "shingle"))).alias("own"))  # at most the shingles of one text
    least = F.ceil(F.col("n_shingles") * percent / 100.0 - 1e-9).cast("int")
    first = F.col("n_shingles") - F.size("own")
    lists = lists.where(F.size("own") >= least).withColumns(
        {"first": first, "own": F.slice("own", 1, F.size("own") - least + 1)})
    rows = lists.select("node", "component", "peers", "n_shingles", "first", F.col("own.shingle").alias("own"),
                        F.posexplode("own").alias("at", "entry"))
    before = F.when(F.size("own") <= _LISTED, F.slice("own", F.lit(1), F.col("at"))).alias("before")
    return rows.select("node", "component", "peers", "n_shingles", (F.col("first") + F.col("at")).alias("place"),
                       F.col("entry.shingle").alias("shingle"), before)


def _meeting(percent: int, a: str, b: str):
    """Whether two rows of ``_prefixes`` can belong to similar sets of different components.

    The first shingle that two similar sets share has enough shingles after it in both. Other shared ones need not
    make a row: they are told by a shared one before them.
    """
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    common = F.ceil((x + y) * percent / (100.0 + percent) - 1e-9)
    return ((F.col(f"{a}.component") != F.col(f"{b}.component")) & (100 * F.least(x, y) >= percent * F.greatest(x, y))
            & (F.col(f"{a}.place") <= x - common) & (F.col(f"{b}.place") <= y - common)
            & ~F.coalesce(F.arrays_overlap(f"{a}.before", f"{b}.before"), F.lit(False)))


def _left_apart(prefixes: DataFrame, percent: int, leads: int | None) -> DataFrame:
    """Pairs of members of different components that share a rare shingle.

    With ``leads``, a number, members meet only a leading member of each of these shingles, drawn by it.
    """
    own = prefixes.alias("a")
    if leads is None:
        pairs = own.join(prefixes.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (
            F.struct("a.n_shingles", "a.node") < F.struct("b.n_shingles", "b.node")) & _meeting(percent, "a", "b"))
        return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()
    lead = prefixes.groupBy("shingle").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.max_by(F.struct("node", "component", "n_shingles", "place", "before"), _rank(leads)).alias("lead"))
    lead = lead.where("lo < hi").select("shingle", "lead.*")
    met = prefixes.withColumn("k", F.bitwise_not("shingle")).alias("a").join(
        lead.withColumn("k", F.bitwise_not("shingle")).alias("b"), F.expr("a.k = b.k") & _meeting(percent, "a", "b"))
    return met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _rank(turn: int):
    """Leading members come from the largest component, in another order in each turn."""
    return F.struct("peers", F.xxhash64("node", F.lit(turn)))


def near_duplicates(docs: DataFrame, *, size: int = 3, percent: int = 85) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for each row of ``docs`` (``doc_id``, ``text``).

    A document's set holds the distinct shingles of ``size`` words, lower-cased in A-Z; with fewer words the
    whole sequence is its one shingle. Documents are linked where 100 * intersection >= ``percent`` * union.
    ``component_id`` is the smallest ``doc_id`` reachable, ``kept`` whether it is the row's own.

    Null and wordless texts have an empty set and are linked with nothing. Rows without ``doc_id`` are linked
    with nothing, have no component and are kept. Rows that share a ``doc_id`` are documents of their own, linked by
    their own texts. An empty table gives no rows.

    Equal sets are one class, found by a map-side combined aggregate; only its first document goes on. In a
    band's group each member meets a leading member, over two rounds, and connected members need no
    more comparisons. Members left apart must share one of their rarest shingles to be similar (an exact prefix
    filter): they meet leading members of these, then all that are still apart and share one. Candidates
    go by the estimate from their sketches, and every link is confirmed on the full sets, word by word.
    """
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``text_hash`` and ``component``, a number of the group that no other group has."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = materialize(hashed.mapInArrow(
        _sketch_rows(size), "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, sketch binary"))
    classes = (found.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "s1", "s2")
               .agg(F.min(F.struct("doc_id", "text_hash")).alias("head"), F.first("sketch").alias("sketch")))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    bands = classes.select("node", "sketch").mapInArrow(_band_rows, "key long, node long")
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = materialize(join_split(bands, shared, "key"))
    asked = members.select("node").distinct()
    wanted = classes.join(asked, "node").select("node", "n_shingles", "sketch", "head.doc_id", "head.text_hash")
    content = wanted.join(hashed, ["doc_id", "text_hash"]).groupBy("node").agg(  # repeated rows count once
        *[F.first(c).alias(c) for c in ("n_shingles", "sketch", "text")])
    content = materialize(content)

    def confirmed(pairs):
        side = lambda s: content.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"),
                                        F.col("sketch").alias(f"sketch_{s}"), F.col("text").alias(f"text_{s}"))
        return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_confirm(size, percent), "u long, v long")

    links, labels = None, members.select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("peers")).distinct()
    for turn in range(_ROUNDS + _RARE_ROUNDS + 1):
        placed = members.join(labels, "node")
        state = placed.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.max_by(F.struct("node", "component"), _rank(turn)).alias("lead")).where("lo < hi")
        open_ = join_split(placed, state, "key")
        if turn < _ROUNDS:
            met = open_.where("component <> lead.component").groupBy(F.col("node").alias("v"), F.col("lead.node").alias("u")).count()
            pairs = met.groupBy("v").agg(F.max_by("u", F.struct("count", "u")).alias("u"))
        else:
            prefixes = materialize(_prefixes(open_, content, size, percent))
            if prefixes.isEmpty():
                break
            pairs = _left_apart(prefixes, percent, turn if turn < _ROUNDS + _RARE_ROUNDS else None)
        new = materialize(confirmed(pairs))
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        if turn < _ROUNDS + _RARE_ROUNDS:
            labels = merged(labels, new)
    if links is None:
        classes = classes.withColumn("component", F.col("node"))
    else:
        classes = classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = materialize(classes.select("n_shingles", "s1", "s2", "head", "component"))
    low = classes.groupBy("component").agg(F.min("head.doc_id").alias("component_id"))
    classes = join_split(classes.drop("head"), low, "component")
    out = found.select("doc_id", "text_hash", "n_shingles", "s1", "s2")
    columns = ["doc_id", "text_hash", "n_shingles", "component", "component_id"]
    whole = out.where("doc_id IS NOT NULL AND n_shingles > 0").join(classes, ["n_shingles", "s1", "s2"]).select(*columns)
    rest = out.where("doc_id IS NULL OR n_shingles = 0").withColumns(
        {"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")}).select(*columns)
    return whole.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, *, size: int = 3, percent: int = 85) -> DataFrame:
    """The row of ``docs`` with the smallest ``doc_id`` of each group of near-duplicates, unchanged.

    Rows without ``doc_id`` stay. Of rows with the smallest ``doc_id`` of their group the one with the least hash
    stays, and of rows equal in ``doc_id`` and text a single one.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = _grouped(docs, size, percent).where("kept AND doc_id IS NOT NULL")
    first = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    ids = first.select("head.*").unionByName(found.where("component IS NULL").select("doc_id", "text_hash").distinct())
    rows = docs.select("doc_id", F.struct(*columns).alias("row"), F.xxhash64("text").alias("text_hash"))
    kept = rows.join(ids, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))
