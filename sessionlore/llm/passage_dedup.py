"""Removal of word passages that repeat across documents, by Rabin-Karp hashes of every window of words.

Windows are counted by hash in Spark. Few windows can repeat at all, so the shuffle is spared the rest: the
smallest hash among the shorter word groups inside a window is its anchor, equal windows have equal anchors,
and a window whose anchor lies in one document only is the only one of its kind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.linking import join_split
from sessionlore.llm.rolling import Words, mix, sliding_min, starts, stretches, windows
from sessionlore.llm.texts import fields, raw, steps

STEP = 1 << 20
REMOVED = fields("n_words bigint, n_removed bigint, starts array<int>, ends array<int>, kept string")
#: Bits of a place that tell apart rows of one doc_id with different texts.
_TEXT_BITS = 24


def _marks(words: Words) -> np.ndarray:
    """A small number for each text, from its words in order."""
    own = words.hashes(1) * (np.arange(len(words.begin), dtype=np.uint64) - np.repeat(
        words.first[:-1].astype(np.uint64), words.count) + np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
    return (mix(sums[words.first[1:]] - sums[words.first[:-1]]) >> np.uint64(64 - _TEXT_BITS)).astype(np.int64)


def _anchors(words: Words, size: int, group: int):
    """Windows of ``size`` words: their starts, the texts they lie in, and their anchors."""
    at, owner = starts(words.first, size)
    hashes = words.hashes()
    found = sliding_min(windows(hashes, group), size - group + 1)[at] if len(at) else np.zeros(0, np.uint64)
    return at, owner, found.view(np.int64), hashes


def _anchor_rows(size, group):
    def run(batches):
        for batch in steps(batches, "text", STEP):
            _, owner, found, _ = _anchors(Words(raw(batch, "text")), size, group)
            if len(found):
                new = np.append(True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1]))
                owner, found = owner[new], found[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), batch.column("doc_id").take(pa.array(owner))], names=["anchor", "doc_id"])

    return run


def _run_rows(size, group):
    """Runs of consecutive windows with one anchor, where that anchor is asked for."""

    def run(batches):
        for batch in steps(batches, "text", STEP):
            words = Words(raw(batch, "text"))
            at, owner, found, hashes = _anchors(words, size, group)
            asked = batch.column("anchors")
            of = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            values = asked.flatten().to_numpy(zero_copy_only=False)
            pair = lambda t, a: a.view(np.uint64) ^ mix(t.astype(np.uint64) + np.uint64(1))
            hit = np.flatnonzero(np.isin(pair(owner, found), pair(of, values)))
            if not len(hit):
                continue
            new = np.append(True, (np.diff(at[hit]) != 1) | (np.diff(owner[hit]) != 0) | (np.diff(found[hit]) != 0))
            head = np.flatnonzero(new)
            many = np.diff(np.append(head, len(hit)))
            begin, owner = at[hit][head], owner[hit][head]
            yield _rows(batch, words, owner, begin, begin + many - 1 + size, many, hashes)

    return run


def _window_rows(size):
    """Every window of the runs that are asked for."""

    def run(batches):
        for batch in steps(batches, "text", STEP):
            words = Words(raw(batch, "text"))
            marks, asked = _marks(words), batch.column("runs")
            of = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            place = asked.flatten().field("place").to_numpy(zero_copy_only=False)
            many = asked.flatten().field("many").to_numpy(zero_copy_only=False).astype(np.int64)
            own = (place & ((1 << _TEXT_BITS) - 1)) == marks[of]
            of, begin, many = of[own], words.first[of[own]] + (place[own] >> _TEXT_BITS), many[own]
            if not len(many):
                continue
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin, owner = np.repeat(begin, many) + inner, np.repeat(of, many)
            yield _rows(batch, words, owner, begin, begin + size, np.ones(len(begin), np.int64), words.hashes())

    return run


_ROWS = "a long, b int, doc_id long, place long, many int"


def _rows(batch, words, owner, begin, end, many, hashes):
    first = stretches(hashes, begin, end).view(np.int64)
    second = (stretches(words.hashes(1), begin, end, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    place = (begin - words.first[owner]) << _TEXT_BITS | _marks(words)[owner]
    return pa.RecordBatch.from_arrays(
        [pa.array(first), pa.array(second), batch.column("doc_id").take(pa.array(owner)), pa.array(place),
         pa.array(many.astype(np.int32))], names=["a", "b", "doc_id", "place", "many"])


def _remove(size):
    def compute(batch):
        texts = raw(batch, "text")
        words = Words(texts)
        marks = _marks(words)
        out = [[], [], [], [], []]
        for i, (text, runs) in enumerate(zip(texts, batch.column("runs"))):
            own = (text or b"").split()
            covered = np.zeros(len(own) + 1, np.int64)
            if runs.is_valid:
                place = runs.values.field("place").to_numpy(zero_copy_only=False)
                many = runs.values.field("many").to_numpy(zero_copy_only=False)
                mine = (place & ((1 << _TEXT_BITS) - 1)) == marks[i]
                at = place[mine] >> _TEXT_BITS
                np.add.at(covered, at, 1)
                np.add.at(covered, at + many[mine] - 1 + size, -1)
            gone = np.cumsum(covered)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            out[0].append(len(own))
            out[1].append(int(gone.sum()))
            out[2].append(edge[0::2].astype(np.int32))
            out[3].append(edge[1::2].astype(np.int32))
            if len(edge):
                keep = np.flatnonzero(~gone).tolist()
                own = [own[k] for k in keep]
            out[4].append(b" ".join(own).decode())
        return out

    return compute


def _listed(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id").agg(F.collect_list(F.struct("place", "many")).alias("runs"))


def remove_passages(docs: DataFrame, *, size: int = 50) -> DataFrame:
    """``doc_id`` and ``REMOVED`` for each row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    A word is removed if it lies in a window of ``size`` consecutive words whose word sequence also starts in
    a document with a smaller ``doc_id``; windows are judged on the input. ``starts``/``ends`` are the maximal
    removal intervals in words, ``kept`` the other words joined by single spaces.

    Null texts have no words. Rows without ``doc_id`` lose nothing and make no other row lose anything. Rows
    that share a ``doc_id`` never remove each other's words. An empty table gives no rows.

    Consecutive windows with one anchor are first counted as one run; only the first document of each distinct
    run goes on to the count of single windows, since the others have the same windows as it. Counts are map-side
    combined aggregates, joined back on the hash, which adaptive execution splits where one hash is hot; hashes
    have 96 bits. The texts are shuffled once, by ``doc_id``, for runs, windows and result.
    """
    group = max(1, min(12, size))
    rows = docs.select("doc_id", "text")
    known = rows.where("doc_id IS NOT NULL")
    found = known.mapInArrow(_anchor_rows(size, group), "anchor long, doc_id long")
    repeated = (found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                .where("lo < hi").select("anchor"))
    asked = join_split(found, repeated, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    runs = known.join(asked, "doc_id").mapInArrow(_run_rows(size, group), _ROWS)
    first = runs.groupBy("a", "b").agg(F.min("doc_id").alias("lo"))
    ranked = join_split(runs, first, "a", "b")
    chosen = _listed(ranked.where("doc_id = lo"))
    single = known.join(chosen, "doc_id").mapInArrow(_window_rows(size), _ROWS)
    low = (single.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
           .where("lo < hi").select("a", "b", "lo"))
    later = join_split(single, low, "a", "b").where("doc_id > lo")
    columns = ["doc_id", "place", "many"]
    gone = _listed(ranked.where("doc_id > lo").select(columns).unionByName(later.select(columns)))
    alone = rows.where("doc_id IS NULL").withColumn("runs", F.lit(None).cast("array<struct<place:long,many:int>>"))
    both = known.join(gone, "doc_id", "left").unionByName(alone)
    compute = _remove(size)

    def run(batches):
        for batch in steps(batches, "text", STEP):
            found = compute(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()),
                 pa.array(found[2], pa.list_(pa.int32())), pa.array(found[3], pa.list_(pa.int32())),
                 pa.array(found[4], pa.string())], names=["doc_id", *REMOVED.names])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, starts array<int>, ends array<int>, "
                                "kept string")
