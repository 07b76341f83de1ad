"""Language of words and documents by a linear-chain conditional random field.

Words have features (lower-cased form, prefixes, suffixes, character n-grams, membership in the lexicon of a
language) with a weight per language; transitions between neighbouring words have weights of their own, so that
text may switch languages. Forward-backward gives each word its probabilities, in segments read all at once: the
product of a segment's transition matrices carries its neighbours' state over it.
"""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.rolling import mix
from sessionlore.llm.texts import fields, holding, map_texts, packed

#: Weight rows shared by hashed features.
FEATURES = 1 << 16
#: Labelled documents that the model is fitted on, for each language, and words taken from each.
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 300, 80
#: Characters of a piece taken from a document, whatever its words.
SAMPLE_CHARACTERS = 2000
LEXICON = 400
SEGMENT = 128
#: Bytes of words, with their scores, that a worker remembers, and of text that it reads at once.
REMEMBERED, STEP = 24 << 20, 1 << 20
UNDETERMINED = "und"
PREDICTED = fields("lang_pred string, score double, n_words bigint, n_switches bigint")
_LETTERS = regex.compile(r"\p{L}+")
_U = np.uint64


@dataclass
class Model:
    """Weights of the fitted field; ``lexicon`` maps words to the languages that use them most."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: dict[str, list[int]]
    #: Distinguishes models, so that a worker remembers words of the latest one only.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scores(self, words: list[str]) -> np.ndarray:
        """Weight sums of each word for each language."""
        ids, owner = features(words, self.lexicon, len(self.languages))
        out = np.zeros((len(words), len(self.languages)))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owner, self.weights[ids, k], len(words))
        return out

    def emit(self, split: list[list[str]]) -> np.ndarray:
        """Scores of all words of all texts; a worker remembers the words it has met, up to a number of bytes."""
        holding(__name__, _memory.__init__)
        if _memory.name != self.name or _memory.size > REMEMBERED:
            _memory.__init__(self.name)
        known = _memory.known
        new = list(set().union(*split).difference(known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            _memory.scores.append(self.scores(new))
            _memory.size += sum(map(sys.getsizeof, new)) + 120 * len(new) + _memory.scores[-1].nbytes
            _memory.scores[:] = [np.concatenate(_memory.scores)]
        total = sum(map(len, split))
        at = np.fromiter((i for words in split for i in map(known.__getitem__, words)), np.int64, total)
        return _memory.scores[0][at] if total else np.zeros((0, len(self.languages)))


class _Memory:
    """Words met by this worker under one model, and their scores."""

    def __init__(self, name: str = ""):
        self.name, self.size = name, 0
        self.known: dict[str, int] = {}
        self.scores: list[np.ndarray] = []


_memory = _Memory()


def words_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def features(words: list[str], lexicon: dict[str, list[int]], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the words that they belong to."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in marked], np.int64)
    end = np.cumsum(size)
    begin = end - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - begin[owner]
    ids, owners = [], []

    def take(hashes, whose, kind):
        ids.append(mix(hashes + _U(kind * 0x9E3779B97F4A7C15 % (1 << 64))) % _U(FEATURES - languages))
        owners.append(whose)

    gram = codes
    for n in range(2, 5):
        gram = mix(gram[:-1] * _U(0xD6E8FEB86659FD93) + codes[n - 1:]) if len(gram) > 1 else gram[:0]
        inside = place[:len(gram)] + n <= size[owner[:len(gram)]]
        take(gram[inside], owner[:len(gram)][inside], n)
        # Affixes: the grams at the start and at the end of a word.
        first = begin[size >= n]
        take(gram[first], owner[first], 10 + n)
        last = end[size >= n] - n
        take(gram[last], owner[last], 20 + n)
    powers = np.multiply.accumulate(np.full(int(size.max(initial=1)) + 1, 0xC2B2AE3D27D4EB4F, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes) * powers[place], dtype=np.uint64)])
    take(mix(sums[end] - sums[begin]), np.arange(len(words)), 1)
    listed = [(i, k) for i, w in enumerate(words) for k in lexicon.get(w, ())]
    if listed:
        whose, which = np.array(listed, np.int64).T
        ids.append((which + FEATURES - languages).astype(np.uint64))
        owners.append(whose)
    return np.concatenate(ids).astype(np.int64), np.concatenate(owners)


def posteriors(emit: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities of each word's languages, for sequences one after the other."""
    n, k = emit.shape
    if not n:
        return emit
    local = np.exp(emit - emit.max(1, keepdims=True))
    move = np.exp(transitions - transitions.max())
    used = lengths[lengths > 0]
    parts = -(-used // SEGMENT)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    base = np.repeat(np.cumsum(used) - used, parts)
    begin = base + inner * SEGMENT
    size = np.minimum(np.repeat(used, parts) - inner * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin, size, first = begin[order], size[order], (inner == 0)[order]
    longest = int(size[0])
    active = (len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")).tolist()
    # Matrix of each segment: from the state before it to its last state.
    whole = np.broadcast_to(np.eye(k), (len(size), k, k)).copy()
    for t, m in enumerate(active):
        step = whole[:m] @ move * local[begin[:m] + t][:, None, :]
        if t == 0:
            step = np.where(first[:m, None, None], np.eye(k) * local[begin[:m]][:, None, :], step)
        whole[:m] = step / step.sum((1, 2), keepdims=True)
    # Compose segment by segment, all sequences at once, forwards and backwards.
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    seq = np.repeat(np.arange(len(used)), parts)
    before, after = np.ones((len(seq), k)) / k, np.ones((len(seq), k)) / k
    start = np.cumsum(parts) - parts
    by_parts = np.argsort(-parts, kind="stable")
    counts = parts[by_parts]
    for j in range(int(counts[0]) - 1):
        m = int(np.searchsorted(-counts, -(j + 1), side="left"))
        at = start[by_parts[:m]] + j
        state = np.einsum("ni,nij->nj", before[at], whole[back[at]])
        before[at + 1] = state / state.sum(1, keepdims=True)
        at = start[by_parts[:m]] + parts[by_parts[:m]] - 1 - j
        state = np.einsum("nij,nj->ni", whole[back[at]], after[at])
        after[at - 1] = state / state.sum(1, keepdims=True)
    # Forward and backward within segments.
    forward = np.empty((n, k))
    state = before[order]
    for t, m in enumerate(active):
        step = state[:m] @ move
        if t == 0:
            step = np.where(first[:m, None], 1.0, step)
        step = step * local[begin[:m] + t]
        state[:m] = step / step.sum(1, keepdims=True)
        forward[begin[:m] + t] = state[:m]
    out = np.empty((n, k))
    state = after[order]
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        both = forward[at] * state[:m]
        out[at] = both / both.sum(1, keepdims=True)
        step = (local[at] * state[:m]) @ move.T
        state[:m] = step / step.sum(1, keepdims=True)
    return out


def fit(rows: list[tuple[str, str]], rounds: int = 30, rate: float = 0.5, decay: float = 1e-6, seed: int = 7) -> Model:
    """Fit the field on (text, language) rows.

    Training sequences join pieces of several rows, so that transitions between languages are seen too. The
    gradient is that of the likelihood: observed counts less the expected ones of forward-backward.
    """
    languages = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    split = [(words_of(text), number[lang]) for text, lang in rows]
    split = [(w, k) for w, k in split if w]
    counts: dict[str, np.ndarray] = {}
    for words, k in split:
        for w in words:
            counts.setdefault(w, np.zeros(len(languages)))[k] += 1
    lexicon: dict[str, list[int]] = {}
    for k in range(len(languages)):
        for w in sorted(counts, key=lambda w: (-counts[w][k], w))[:LEXICON]:
            if counts[w][k] > 1 and counts[w][k] >= 0.5 * counts[w].sum():
                lexicon.setdefault(w, []).append(k)
    rng = np.random.default_rng(seed)
    pieces = []
    for words, k in split:
        at = 0
        while at < len(words):
            step = int(rng.integers(5, 40))
            pieces.append((words[at:at + step], k))
            at += step
    vocabulary = {w: i for i, w in enumerate(counts)}
    names = list(vocabulary)
    ids, owner = features(names, lexicon, len(languages)) if names else (np.zeros(0, np.int64),) * 2
    weights, moves = np.zeros((FEATURES, len(languages))), np.zeros((len(languages),) * 2)
    past, past_moves = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    for _ in range(rounds if len(languages) > 1 and pieces else 0):
        order = rng.permutation(len(pieces))
        joined = [[pieces[i] for i in order[a:a + 4]] for a in range(0, len(order), 4)]
        word = np.array([vocabulary[w] for s in joined for p, _ in s for w in p], np.int64)
        truth = np.array([k for s in joined for p, k in s for _ in p], np.int64)
        lengths = np.array([sum(len(p) for p, _ in s) for s in joined], np.int64)
        emit = np.stack([np.bincount(owner, weights[ids, k], len(names)) for k in range(len(languages))], 1)
        found = posteriors(emit[word], moves, lengths)
        error = -found
        error[np.arange(len(word)), truth] += 1
        by_word = np.stack([np.bincount(word, error[:, k], len(names)) for k in range(len(languages))], 1)
        step = np.stack([np.bincount(ids, by_word[owner, k], FEATURES) for k in range(len(languages))], 1)
        step = step / len(word) - decay * weights
        past += step ** 2
        weights += rate * step / np.sqrt(past)
        inner = np.ones(len(word), bool)
        inner[np.cumsum(lengths) - 1] = False
        a = np.flatnonzero(inner)
        # Expected transitions from neighbouring probabilities and the current weights.
        pair = found[a][:, :, None] * np.exp(moves - moves.max())[None] * found[a + 1][:, None, :]
        pair = (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        seen = np.zeros_like(moves)
        np.add.at(seen, (truth[a], truth[a + 1]), 1)
        step = (seen - pair) / len(word) - decay * moves
        past_moves += step ** 2
        moves += rate * step / np.sqrt(past_moves)
    return Model(languages, weights, moves, lexicon)


def training_rows(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: about ``SAMPLE_DOCUMENTS`` of each language, ``SAMPLE_WORDS`` words of each.

    Languages are counted over all rows; a row is drawn by a hash of its key and text with the chance that the count
    gives, so that rows without key or with equal keys are drawn apart. Of rows equal in all of these one is drawn. A
    piece has ``SAMPLE_CHARACTERS`` characters at most, also in scripts without blanks.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).alias("key")).where(
        "lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.groupBy("lang").count().collect()  # a row for each language that the model will know
    if not counts:
        return []
    chance = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], SAMPLE_DOCUMENTS / r["count"])])
    draw = F.pmod(F.xxhash64("key", "text", F.lit(3)), F.lit(1_000_003)) / 1_000_003.0
    words = F.split("text", r"[ \t-\r]+")
    place = lambda seed, size, most: F.pmod(
        F.xxhash64("key", "text", F.lit(seed)), F.greatest(size - most, F.lit(0)).cast("long") + 1).cast("int") + 1
    few = F.array_join(F.slice(words, place(5, F.size(words), SAMPLE_WORDS), SAMPLE_WORDS), " ")
    drawn = rows.where(draw < chance[F.col("lang")]).select("lang", F.xxhash64("key", "text").alias("key"), few.alias("text"))
    piece = F.substring("text", place(7, F.length("text"), SAMPLE_CHARACTERS), F.lit(SAMPLE_CHARACTERS))
    found = drawn.select(piece.alias("piece"), "lang", "key").distinct().orderBy("key", "lang", "piece").collect()
    return [(r.piece, r.lang) for r in found]


def predict(model: Model, texts: list[bytes | None]) -> list[list]:
    """Columns of ``PREDICTED``."""
    split = [words_of(t.decode()) if t else [] for t in texts]
    lengths = np.array([len(s) for s in split], np.int64)
    n = len(texts)
    if not model.languages:
        return [[UNDETERMINED] * n, [0.0] * n, lengths, [0] * n]
    found = posteriors(model.emit(split), model.transitions, lengths)
    owner = np.repeat(np.arange(n), lengths)
    share = np.stack([np.bincount(owner, found[:, k], n) for k in range(found.shape[1])], 1)
    share = share / np.maximum(lengths, 1)[:, None]
    best, label = share.argmax(1), found.argmax(1)
    switch = (label[1:] != label[:-1]) & (owner[1:] == owner[:-1])
    switches = np.bincount(owner[1:][switch], minlength=n) if len(owner) else np.zeros(n, np.int64)
    names = [model.languages[b] if m else UNDETERMINED for b, m in zip(best.tolist(), lengths.tolist())]
    return [names, np.clip(share.max(1), 0, 1), lengths, switches]


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """Words of a text with their most probable language and its probability."""
    words = words_of(text)
    found = posteriors(model.scores(words), model.transitions, np.array([len(words)])) if words else []
    return [(w, model.languages[int(p.argmax())], float(p.max())) for w, p in zip(words, found)]


def train(docs: DataFrame, **options) -> Model:
    return fit(training_rows(docs, **options))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``n_words`` and ``n_switches``.

    ``score`` is the mean probability of the language over the words, between 0 and 1; ``n_switches`` counts
    neighbouring words of different languages. Null texts and texts without a letter are ``und`` with score 0.
    Only the text is read. The model, of fixed size, is broadcast; there is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, PREDICTED, lambda texts: predict(shared.value, texts), text, STEP)


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, but for those that no language can be told of: null texts and texts without a letter."""
    return identify(packed(docs, text), model).where("n_words > 0").select("row.*")
