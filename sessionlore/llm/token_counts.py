"""Token counts of a byte-level BPE by a deterministic finite-state transducer.

Text is cut at the places where the pattern of the tokenizer starts a new piece; such a place resets the
transducer. Within a piece the transducer reads bytes. Its state holds, for each earlier place from which a
longer token could still grow, the bytes read since, the last token before the place and how many tokens more
or fewer that reading has; a transition carries the change of the token count. States and transitions are
compiled when first met and kept in flat arrays.

Texts are read as chunks of equal size, all at once. What a chunk does up to its first reset is a map from incoming
states to outgoing states and changes of the count; the rest of it does not depend on the chunk before. Maps are built
over the states that occur at chunk borders, closed under each other, and composed by doubling: the maps of 2, 4, 8 ...
chunks in a row, so that the counts of a text without resets take a logarithmic number of steps.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from sessionlore.llm.texts import PairTable, fields, map_texts

CHUNK = 256
#: Compiled states that a worker keeps before it starts anew.
MOST_STATES = 1_500_000
COUNTED = fields("n_bytes bigint, n_tokens bigint, over_limit boolean")
_OTHER, _LETTER, _NUMBER, _SPACE, _BLANK = range(5)
#: Endings that the pattern takes as pieces after an apostrophe (fixed values).
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_SHIFT = 512  # of the change of the count, which is small, beside the next state in one number


def character_kinds() -> np.ndarray:
    """The kind of every code point, from the pattern engine that the tokenizers use themselves."""
    from tokenizers import Regex, pre_tokenizers

    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, code = "".join(map(chr, codes)), np.array(codes)
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _BLANK)):
        inside = np.ones(len(codes), bool)
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
            inside[a:b] = False
        kinds[code[inside]] = kind
    kinds[ord(" ")] = _SPACE
    return kinds


class Transducer:
    def __init__(self, content: bytes, kinds: np.ndarray):
        spec = json.loads(content)
        model, before, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or not before["use_regex"] \
                or before["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges") \
                or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("only plain byte-level BPE is supported")
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        hidden = [c for c in range(256) if c not in set(shown)]
        byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(hidden)}
        plain = lambda token: bytes(byte[c] for c in token)
        names = [a["content"].encode() for a in added]
        self.special = re.compile(b"|".join(map(re.escape, sorted(names, key=len, reverse=True)))) if names else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(plain(a), plain(b)): i for i, (a, b) in enumerate(merges)}
        self.tokens = {plain(t) for t in model["vocab"] if t.encode() not in set(names)}
        self.openings = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.kinds = kinds
        self.pairs: dict[tuple, bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states = [((b"", None, 0),)]
        self.numbers = {self.states[0]: 0}
        self.table = PairTable(1 << 16)

    def merge(self, text: bytes) -> list[bytes]:
        """The tokens of a short piece."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            pair, out, k = (parts[i], parts[i + 1]), [], 0
            while k < len(parts):
                both = k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair
                out.append(parts[k] + parts[k + 1] if both else parts[k])
                k += 1 + both
            parts = out
        return parts

    def follows(self, last: bytes | None, token: bytes) -> bool:
        """Whether ``token`` can stand after ``last``, or first: the two do not merge otherwise."""
        key = (last, token)
        if key not in self.pairs:
            self.pairs[key] = self.merge((last or b"") + token) == ([token] if last is None else [last, token])
        return self.pairs[key]

    def compile(self, keys: np.ndarray) -> None:
        """Add the transitions of new keys, each a state and a byte."""
        values = np.empty(len(keys), np.int64)
        for n, key in enumerate(keys.tolist()):
            state, byte = self.states[key >> 8], bytes([key & 255])
            token = change = None
            for read, last, ahead in state:  # exactly one reading is the tokenizer's
                if read + byte in self.tokens and self.follows(last, read + byte):
                    token, change = read + byte, ahead + 1
                    break
            grown = [(read + byte, last, ahead - change) for read, last, ahead in state
                     if read + byte in self.openings]
            following = (*grown, (b"", token, 0))
            number = self.numbers.setdefault(following, len(self.states))
            if number == len(self.states):
                self.states.append(following)
            values[n] = number * 2 * _SHIFT + change + _SHIFT
        self.table.add(keys, values)

    def pieces(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts, which are not empty, and where pieces start."""
        joined = b"".join(texts)
        codes = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.cumsum(width, dtype=np.int64) - width
        n = len(codes)
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(place, np.cumsum([0, *map(len, texts)])[:-1])] = True
        first[n] = True
        kind = self.kinds[codes]
        blank = kind >= _SPACE
        before = np.append(np.uint8(_BLANK), kind[:-1])
        after_blank = np.append(True, blank[:-1])
        closes = np.append(~blank[1:], False) & ~first[1:]  # a blank right before a character that is none
        start = np.where(blank, ~after_blank | closes, np.where(after_blank, before == _BLANK, before != kind))
        start |= first[:-1]
        quote = np.flatnonzero((codes == ord("'")) & start)
        for ending in _ENDINGS:
            at = quote[quote + len(ending) < n]
            for k, letter in enumerate(ending, 1):
                at = at[(codes[at + k] == ord(letter)) & ~first[at + k]]
            start[at + 1] = False
            at = at[at + len(ending) + 1 < n]
            start[at + len(ending) + 1] = True
        flags = np.zeros(len(joined), bool)
        flags[place[start]] = True
        return np.frombuffer(joined, np.uint8), flags

    def run(self, data, flags, begin, end, state):
        """Outgoing states and changes of the count of stretches read from given states."""
        order = np.argsort(begin - end, kind="stable")
        begin, state = begin[order], state[order].copy()
        size = end[order] - begin
        count = np.zeros(len(order), np.int64)
        longest = int(size[0]) if len(size) else 0
        active = len(size) - np.searchsorted(size[::-1], np.arange(longest), side="right")
        for t, m in enumerate(active.tolist()):
            at = begin[:m] + t
            key = np.where(flags[at], 0, state[:m]) << 8 | data[at]
            value = self.table.get(key)
            if value.min() < 0:
                self.compile(np.unique(key[value < 0]))
                value = self.table.get(key)
            state[:m] = value // (2 * _SHIFT)
            count[:m] += value % (2 * _SHIFT) - _SHIFT
        out, counts = np.empty_like(state), np.empty_like(count)
        out[order], counts[order] = state, count
        return out, counts

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > MOST_STATES:
            self._restart()
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            cut = self.special.split(text) if self.special else [text]
            total[i] += len(cut) - 1
            parts += [c for c in cut if c]
            owner += [i] * sum(map(bool, cut))
        if not parts:
            return total
        data, flags = self.pieces(parts)
        length = np.array([len(p) for p in parts], np.int64)
        chunks = -(-length // CHUNK)
        part = np.repeat(np.arange(len(parts)), chunks)
        inner = np.arange(len(part)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        base = (np.cumsum(length) - length)[part]
        begin, end = base + inner * CHUNK, base + np.minimum((inner + 1) * CHUNK, length[part])
        resets = np.append(np.flatnonzero(flags), len(data))
        reset = np.minimum(resets[np.searchsorted(resets, begin)], end)
        constant = reset < end
        # From the reset on; a chunk without one is read from the first state, for a state that occurs after it.
        out, count = self.run(data, flags, np.where(constant, reset, begin), end, np.zeros(len(begin), np.int64))
        text = np.array(owner)[part]
        total += np.bincount(text, np.where(constant, count, 0), len(texts)).astype(np.int64)
        chunk, changed = self.compose(data, flags, begin, reset, constant, out)
        return total + np.bincount(text[chunk], changed, len(texts)).astype(np.int64)

    def compose(self, data, flags, begin, reset, constant, out):
        """For each stretch of bytes before a reset that spans chunks: its first chunk, and the change of the count.

        ``out`` is the state after each chunk, exact where the chunk is ``constant``.
        """
        waiting = reset > begin
        nodes, results = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        first = np.flatnonzero(waiting)
        new = np.unique(first << 32 | out[first - 1])
        while len(new):  # the maps, over the states that come up
            at = new >> 32
            found = np.stack(self.run(data, flags, begin[at], reset[at], new & 0xFFFFFFFF), 1)
            nodes, results = np.append(nodes, new), np.concatenate([results, found])
            on = ~constant[at] & (at + 1 < len(begin))
            on[on] = waiting[at[on] + 1]
            new = np.setdiff1d((at[on] + 1) << 32 | found[on, 0], nodes)
        order = np.argsort(nodes)
        nodes, state, changed = nodes[order], results[order, 0], results[order, 1]
        at = nodes >> 32
        on = ~constant[at] & (at + 1 < len(begin))
        on[on] = waiting[at[on] + 1]
        following = np.where(on, np.searchsorted(nodes, (at + 1) << 32 | state), -1)
        while (following >= 0).any():  # maps of twice as many chunks
            on = np.flatnonzero(following >= 0)
            to = following[on]
            changed[on] = changed[on] + changed[to]
            following[on] = following[to]
        starts = np.flatnonzero(waiting & np.append(True, constant[:-1]))
        return starts, changed[np.searchsorted(nodes, starts << 32 | out[starts - 1])]

    def columns(self, texts: list[bytes | None], limit: int) -> list:
        texts = [t or b"" for t in texts]
        counts = self.count(texts)
        return [[len(t) for t in texts], counts, counts > limit]


@lru_cache(maxsize=1)
def _kinds() -> bytes:
    return character_kinds().tobytes()


@lru_cache(maxsize=2)
def _transducer(content: bytes, kinds: bytes) -> Transducer:
    return Transducer(content, np.frombuffer(kinds, np.uint8))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of each whole text.

    Counts are those of the tokenizer file, strings of its special tokens in a text included, without tokens
    added around the text. Null texts count as empty: no bytes, no tokens. The tokenizer, bounded by its
    vocabulary, is broadcast; there is no shuffle, and memory is bounded by a step of texts, the longest text
    and ``MOST_STATES``.
    """
    with open(tokenizer_path, "rb") as file:
        content = file.read()
    parts = docs.sparkSession.sparkContext.broadcast((content, _kinds()))
    return map_texts(docs, COUNTED, lambda texts: _transducer(*parts.value).columns(texts, limit), text, 2 << 20)
