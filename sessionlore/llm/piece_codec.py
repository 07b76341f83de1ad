"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. A round looks up the rank of each adjacent pair, takes the
smallest rank of each word, merges its places from the left, all words at once, and compacts the array; a
word without a mergeable pair is done. A word here is a run of the space mark with what follows it, or what
follows a line end: no piece reaches over these places, so words are encoded once per task and remembered.
"""

from __future__ import annotations

import heapq
import re
import sys
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.llm.texts import PairTable, fields, holding, map_texts

MARK = "▁"
_MARK = MARK.encode()
ENCODED = fields("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
WITH_IDS = fields("n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>")
#: Bytes of words and ids that a worker remembers before it starts anew, and of text that it reads at once.
REMEMBERED, STEP = 40 << 20, 2 << 20
_NONE = np.int64(1) << 40
#: Kinds of pieces in a model file.
_NORMAL, _USER, _UNUSED, _BYTE = 1, 4, 5, 6


class PieceModel:
    """Vocabulary of a BPE model with byte fallback, a space mark before the text and no normalisation."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(content)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if trainer.model_type != pb.TrainerSpec.BPE or not trainer.byte_fallback or spec.precompiled_charsmap \
                or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces \
                or trainer.treat_whitespace_as_suffix or any(p.type in (_USER, _UNUSED) for p in model.pieces):
            raise ValueError("only plain BPE models with byte fallback are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.texts = [p.piece if p.type == _NORMAL else "" for p in model.pieces]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.byte = np.zeros(256, np.int64)
        self.byte_of = {}
        for i, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over a space")
        scores = np.array([p.score for p in model.pieces])
        _, self.rank = np.unique(-scores, return_inverse=True)  # smaller merges first
        shared = np.bincount(self.rank[list(self.ids.values())], minlength=len(scores))
        self.tied = shared > 1
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.size, lefts, merged = len(self.pieces), [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    lefts.append(a * self.size + b)
                    merged.append(i)
        self.pairs = PairTable(4 * len(lefts))
        self.pairs.add(np.array(lefts, np.int64), np.array(merged, np.int64))
        # A character outside all pieces is never merged over; a line end among them parts words.
        self.breaks = self.char[ord("\n")] < 0
        #: Ids of the words met, and the decoded text of those whose decoded text differs from them.
        self.words: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that already carry their space marks."""
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(n), sizes)
        symbol = self.char[codes] if len(codes) else np.zeros(0, np.int64)
        symbol = np.where(symbol < 0, -1 - codes, symbol)  # outside the vocabulary: kept as its code point
        done, redo = [], np.zeros(n, bool)
        last, several = np.full(n, -1, np.int64), np.zeros(n, bool)
        while len(symbol):
            apart = word[1:] != word[:-1]
            left, right = symbol[:-1], symbol[1:]
            to = self.pairs.get(np.where((left >= 0) & (right >= 0) & ~apart, left * self.size + right, _NONE))
            rank = np.append(np.where(to >= 0, self.rank[to], _NONE), _NONE)
            start = np.flatnonzero(np.append(True, apart))
            best = np.minimum.reduceat(rank, start)
            ids = word[start]
            # Several merges at once are right unless they open a better pair; a rank that pieces share
            # orders by place alone. Both are rare: such words go through the queue below.
            wrong = (several[ids] & (best < last[ids])) | ((best < _NONE) & self.tied[np.minimum(best, self.size - 1)])
            redo[ids[wrong]] = True
            last[ids] = best
            many = np.diff(np.append(start, len(symbol)))
            ended = np.repeat((best == _NONE) | wrong, many)
            place = np.flatnonzero((rank == np.repeat(best, many)) & ~ended)
            first = np.append(True, np.diff(place) != 1) if len(place) else np.zeros(0, bool)
            run = np.arange(len(place)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(place) else place
            place = place[run % 2 == 0]  # of overlapping places the left one merges
            several[:] = False
            count = np.bincount(word[place], minlength=n)
            several[count > 1] = True
            symbol[place] = to[place]
            keep = ~ended
            keep[place + 1] = False
            done.append((word[ended], symbol[ended]))
            word, symbol = word[keep], symbol[keep]
        out: list[list[int]] = [[] for _ in range(n)]
        if done:
            word, symbol = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(word, kind="stable")
            word, symbol = word[order], symbol[order]
            outside = np.bincount(word[symbol < 0], minlength=n) > 0
            ends, symbol = np.searchsorted(word, np.arange(n), side="right").tolist(), symbol.tolist()
            begin = 0
            for i, end in enumerate(ends):
                out[i] = symbol[begin:end]
                begin = end
            for i in np.flatnonzero(outside).tolist():
                out[i] = self._fallback(out[i])
            for i in np.flatnonzero(redo).tolist():
                out[i] = self._queue(words[i])
        return out

    def _fallback(self, symbols: list[int]) -> list[int]:
        return [i for s in symbols for i in ([s] if s >= 0 else self.byte[list(chr(-1 - s).encode())].tolist())]

    def _queue(self, word: str) -> list[int]:
        """One merge at a time, best rank first, then leftmost."""
        symbol = [int(self.char[ord(c)]) if self.char[ord(c)] >= 0 else -1 - ord(c) for c in word]
        text = list(word)
        before, after = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        heap: list[tuple] = []

        def offer(a, b):
            if a >= 0 and b >= 0 and (i := self.ids.get(text[a] + text[b])) is not None:
                heapq.heappush(heap, (int(self.rank[i]), a, b, i, len(text[a]) + len(text[b])))

        for a in range(len(word) - 1):
            offer(a, a + 1)
        while heap:
            _, a, b, i, size = heapq.heappop(heap)
            if not text[a] or not text[b] or len(text[a]) + len(text[b]) != size or after[a] != b:
                continue
            text[a] += text[b]
            text[b], symbol[a] = "", i
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return self._fallback([s for s, t in zip(symbol, text) if t])

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that form no character become the replacement character."""
        return self._decode(ids).removeprefix(" ")

    def _decode(self, ids) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(_characters(bytes(pending)))
                pending.clear()
            out.append(self.texts[i])
        if pending:
            out.append(_characters(bytes(pending)))
        return "".join(out).replace(MARK, " ")

    def split(self, text: str) -> list[str]:
        """Words as they are remembered: without the one space mark before them, or from a line end on."""
        body = text.replace("\n", " \n") if self.breaks else text
        if MARK not in body and "  " not in body and body[0] != " " and body[-1] != " ":
            return body.split(" ")
        body = MARK + text.replace(" ", MARK)
        found = re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*" if self.breaks else f"{MARK}+[^{MARK}]*", body)
        return [w[1:] if len(w) > 1 and w[0] == MARK and w[1] != MARK else w for w in found]

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        marked = [w if w[0] == MARK or w[0] == "\n" and self.breaks else MARK + w for w in new]
        name, text = self.names.__getitem__, self.texts.__getitem__
        for w, m, ids in zip(new, marked, self.encode_words(marked)):
            self.words[w] = joined = ",".join(map(name, ids))
            self.held += sys.getsizeof(w) + sys.getsizeof(joined) + 100
            if "".join(map(text, ids)) != m and (decoded := self._decode(ids)) != m.replace(MARK, " "):
                self.odd[w] = decoded

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        words = self.split(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.words[w].split(",")]

    def digests(self, texts: list[bytes | None], whole: bool = False) -> list[list]:
        """Columns of ``ENCODED``, or with ``whole`` those of ``WITH_IDS``."""
        if self.held > REMEMBERED:
            self.words.clear()
            self.odd.clear()
            self.held = 0
        split = [self.split(t.decode()) if t else [] for t in texts]
        self.learn(set().union(*split))
        get, odd, counts, ids, decoded, arrays = self.words.__getitem__, self.odd, [], [], [], []
        for text, words in zip(texts, split):
            joined = ",".join(map(get, words))
            counts.append(joined.count(",") + 1 if words else 0)
            ids.append(sha256(joined.encode()).hexdigest())
            if whole:
                arrays.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
            if odd and not odd.keys().isdisjoint(words):
                text = self.decode([int(i) for i in joined.split(",")]).encode()
            elif text and _MARK in text:
                text = text.replace(_MARK, b" ")
            decoded.append(sha256(text or b"").hexdigest())  # else each word decodes to itself
        return [counts, ids, decoded, arrays] if whole else [counts, ids, decoded]


def _characters(content: bytes) -> str:
    """UTF-8 of ``content`` with one replacement character for each byte that begins no character."""
    try:
        return content.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(content):
            for size in (1, 2, 3, 4):
                try:
                    out.append(content[at:at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=2)
def _model(content: bytes) -> PieceModel:
    return PieceModel(content)


def load(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return _model(file.read())


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: bool = False) -> DataFrame:
    """``docs`` with the ids of each whole text, and of the text decoded from them, as counts and digests.

    With ``ids`` the ids themselves come too. The model file, bounded by its vocabulary, is broadcast. Null and
    empty texts have no ids. Rows stay where they are: no shuffle, memory bounded by a step of texts, the longest
    text and the remembered words.
    """
    with open(model_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def compute(texts):
        holding(__name__, _model.cache_clear)
        return _model(content.value).digests(texts, ids)

    return map_texts(docs, WITH_IDS if ids else ENCODED, compute, text, STEP)


def decode_ids(rows: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``decoded``; null for null."""
    with open(model_path, "rb") as file:
        content = rows.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def text(column):
        return column.map(lambda x: None if x is None else _model(content.value).decode(x.tolist()))

    return rows.withColumn("decoded", text(F.col(ids)))
