"""Document probabilities under a subword lattice of a given vocabulary.

A word is read along all paths of its lattice: every segmentation into pieces of the vocabulary, weighted by
their unigram scores, and for a word seen in training one more arc for the word as a whole, which takes the
counts less a discount; the discount is the weight of the pieces. The forward recursion sums the paths in log
space. Pieces never reach over a space, so the lattice of a text is the chain of the lattices of its words
and each distinct word is summed once. Counts are kept per class of training documents (their language), and
the probability of a text is the sum over the classes.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.lattice import MARK, Lattice, vocabulary
from sessionlore.llm.texts import raw, steps
from sessionlore.session import materialize

DISCOUNT = 0.75
#: Text bytes of a block, whose words are looked up together.
BLOCK_BYTES = 8 << 20
_FLUSH = 200_000
#: Pseudo-count of the file's own scores in the fitted ones.
_PRIOR = 1000.0


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _count_rows(batches):
    """Partial counts of words by class, combined within a task up to a bound."""
    counts: dict[int, Counter] = {}

    def flush():
        words = [w for own in counts.values() for w in own]
        kinds = np.repeat(np.array(list(counts), np.int32), [len(own) for own in counts.values()])
        out = pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()).cast(pa.string()), pa.array(kinds),
             pa.array([n for own in counts.values() for n in own.values()], pa.int64())], names=["word", "class", "n"])
        counts.clear()
        return out

    for batch in batches:
        for part in steps([batch], "text"):
            for k, text in zip(part.column("class").to_pylist(), raw(part, "text")):
                counts.setdefault(k, Counter()).update(tokens(text))
            if sum(map(len, counts.values())) > _FLUSH:
                yield flush()
    if counts:
        yield flush()


@lru_cache(maxsize=2)
def _lattice(content: bytes, logs: bytes) -> Lattice:
    names, _, byte = vocabulary(content)
    return Lattice(names, byte, np.frombuffer(logs))


def _expected_rows(shared):
    """Expected uses of each piece in the words of a task, each distinct word once."""

    def run(batches):
        total = None
        for batch in batches:
            words = [MARK + w for w in batch.column("word").to_pylist()]
            for i in range(0, len(words), 20_000):
                part = words[i:i + 20_000]
                _, found = _lattice(*shared.value).forward(part, np.ones(len(part)))
                total = found if total is None else total + found
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    return run


def fit_pieces(words: DataFrame, content: bytes, rounds: int = 2) -> bytes:
    """Log probabilities of the pieces after ``rounds`` of expectation maximisation over all distinct ``word``s.

    They start from the scores of the vocabulary, which also count as ``_PRIOR`` uses. Only a row for each piece
    of the vocabulary reaches the driver.
    """
    _, start, _ = vocabulary(content)
    prior, logs = np.exp(start), start
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((content, logs.tobytes()))
        uses = words.select("word").mapInArrow(_expected_rows(shared), "piece long, uses double")
        found = _PRIOR * prior
        for r in uses.groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            found[r.piece] += r.uses
        with np.errstate(divide="ignore"):
            logs = np.log(found / found.sum())
    return logs.tobytes()


def _spell(shared):
    """Log probability of each word over all its segmentations."""

    def run(batches):
        for batch in batches:
            words = [MARK + w for w in batch.column("word").to_pylist()]
            found = [_lattice(*shared.value).forward(words[i:i + 20_000]) for i in range(0, len(words), 20_000)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *found]))],
                                             names=["word", "pairs", "spelled"])

    return run


def _block_words(_, block):
    found = sorted(set().union(*map(tokens, raw(block, "text"))))
    number = block.column("block")[0].as_py()
    return pa.table({"block": pa.array([number] * len(found), pa.int64()), "i": pa.array(range(len(found)), pa.int32()),
                     "word": pa.array(found, pa.binary()).cast(pa.string())})


def _score_block(shared):
    def run(_, block, known):
        content, logs, classes, n_all, v_all, docs_all = shared.value
        texts = [tokens(t) for t in raw(block.combine_chunks(), "text")]
        found = sorted(set().union(*texts))
        size = len(found)
        counts = np.zeros((size, max(1, len(classes))))
        pairs = known.column("pairs").combine_chunks()
        lengths = pairs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pairs.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
        counts[np.repeat(known.column("i").to_numpy(), lengths // 2), flat[:, 0]] = flat[:, 1]
        spelled = np.full(size, np.nan)
        spelled[known.column("i").to_numpy()] = known.column("spelled").to_numpy()
        new = np.flatnonzero(np.isnan(spelled))  # words that nothing was learned of
        for i in range(0, len(new), 20_000):
            spelled[new[i:i + 20_000]] = _lattice(content, logs).forward([MARK + found[j].decode() for j in new[i:i + 20_000]])
        logp, end = np.empty(counts.shape), np.empty(counts.shape[1])
        for k, (docs, n, v) in enumerate(classes or [(1, 2, 1 / DISCOUNT)]):  # nothing learned: pieces, or the end
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(counts[:, k] - DISCOUNT, 0) / n)
                logp[:, k] = np.logaddexp(whole, np.log(DISCOUNT * v / n) + spelled)
            end[k] = np.log(docs / n) + np.log(docs / max(1, docs_all))
        total = counts.sum(1)
        base = np.log10((total + 1) / (n_all + v_all + 1))
        number = {w: i for i, w in enumerate(found)}
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for words in texts:
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            by_class = logp[ids].sum(0) + end
            top = by_class.max()
            out["n_tokens"].append(len(words) + 1)
            out["n_known"].append(int((total[ids] > 0).sum()) + (docs_all > 0))
            out["base_score"].append(float(base[ids].sum() + np.log10((docs_all + 1) / (n_all + v_all + 1))))
            out["score"].append(float((top + np.log(np.exp(by_class - top).sum())) / np.log(10)))
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.table({"doc_id": block.column("doc_id"), "held_out": block.column("held_out"),
                         **{c: pa.array(v, kinds[c]) for c, v in out.items()}})

    return run


def score_documents(docs: DataFrame, model_path: str, *, learn: Column, kind: str | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row.

    ``docs`` needs ``doc_id`` and ``text``; rows for which ``learn`` holds are learned from, in classes by the
    column ``kind``. ``score`` is the log10 probability of the text, ``base_score`` that of an add-one unigram model
    over whole words; each text ends with one end token. Null texts are empty. Words are counted over all
    rows learned from. With none, scores are those of the vocabulary alone. An empty table gives no rows.

    Words are counted with partial sums inside tasks, and each word learned is read through its lattice once. Documents
    are dealt to blocks by a hash of id and text; the distinct words of a block meet their counts and log probability
    in one join, and come back as numbers. Only words that nothing was learned of are read in the blocks.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        content = file.read()
    rows = docs.select("doc_id", "text", (F.col(kind).cast("string") if kind else F.lit("")).alias("kind"),
                       F.coalesce(learn, F.lit(False)).alias("learned"))
    lessons = rows.where("learned")
    of_class = {r["kind"]: r["count"] for r in lessons.groupBy("kind").count().collect()}
    names = sorted(of_class, key=lambda k: (k is not None, k))
    index = F.lit(None).cast("int")
    for k, name in enumerate(names):
        index = F.when(F.col("kind").eqNullSafe(F.lit(name)), F.lit(k)).otherwise(index)
    partial = lessons.select(index.alias("class"), "text").mapInArrow(_count_rows, "word string, class int, n long")
    sums = [F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)) for k in range(len(names))]
    pairs = F.flatten(F.filter(F.transform(F.col("c"), lambda x, k: F.array(k.cast("long"), x)), lambda p: p[1] > 0))
    counts = materialize(partial.groupBy("word").agg((F.array(*sums) if sums else F.array().cast("array<long>")).alias("c"))
                         .select("word", pairs.alias("pairs"), *[F.get("c", F.lit(k)).alias(f"c{k}") for k in range(len(names))]))
    each = [x for k in range(len(names)) for x in (F.sum(f"c{k}").alias(f"n{k}"), F.count_if(F.col(f"c{k}") > 0).alias(f"v{k}"))]
    found = counts.agg(F.count("*").alias("v"), *each).first()
    docs_all = sum(of_class.values())
    classes = [(of_class[name], (found[f"n{k}"] or 0) + of_class[name], found[f"v{k}"]) for k, name in enumerate(names)]
    n_all, v_all = sum(n for _, n, _ in classes), found["v"] + (docs_all > 0)
    logs = fit_pieces(counts, content)
    pieces = spark.sparkContext.broadcast((content, logs))
    learned = counts.select("word", "pairs").mapInArrow(_spell(pieces), "word string, pairs array<long>, spelled double")
    shared = spark.sparkContext.broadcast((content, logs, classes, n_all, v_all, docs_all))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // BLOCK_BYTES + 1)).alias("block")
    dealt = rows.select(block, "doc_id", (~F.col("learned")).alias("held_out"), "text")
    asked = dealt.groupBy("block").applyInArrow(_block_words, "block long, i int, word string")
    known = asked.join(learned, "word").select("block", "i", "pairs", "spelled")
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        _score_block(shared), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long"))
