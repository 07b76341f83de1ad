"""Rolling Rabin-Karp hashes of words and of windows of words, for many texts at once.

A word's hash sums a random number for each (place, byte). Over words, hashes are polynomials modulo the prime
2**61 - 1 in a fixed random base: a stretch is a difference of prefix sums of value * base**place, divided by
base**start. Neither has the regular strings that make polynomials modulo a power of two collide.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
PRIME = (1 << 61) - 1
#: Base and seed of each lane; two lanes give 122 bits.
_LANES = ((0x0A3B195354A39B71, 0xD6E8FEB86659FD93), (0x1D8E4E27C47D124F, 0xA0761D6478BD642F))
#: Places of a word whose random numbers are kept in a table.
_NEAR = 64
#: Powers kept between steps; longer inputs make their own.
_KEPT = 1 << 19
_P, _LOW = _U(PRIME), _U(0xFFFFFFFF)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return x - _P * (x >= _P)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it."""
    a1, a0, b1, b0 = a >> _U(32), a & _LOW, b >> _U(32), b & _LOW
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced((a1 * b1 << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32))
                    + (low >> _U(61)) + (low & _P))


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(max(1, size), np.uint64)
    have = 1
    while have < size:
        step = min(have, size - have)
        out[have:have + step] = times(out[:step], _U(pow(base, have, PRIME)))
        have += step
    return out


@lru_cache(maxsize=4)
def _kept(base: int) -> np.ndarray:
    return _powers(base, _KEPT)


def _power(base: int, size: int) -> np.ndarray:
    """base**i for i below ``size``."""
    return _kept(base)[:size] if size <= _KEPT else _powers(base, size)


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values * base**place over all beginnings, modulo the prime."""
    terms = times(_reduced(values), _power(base, len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    low, high = np.cumsum(terms & _LOW, dtype=np.uint64), np.cumsum(terms >> _U(32), dtype=np.uint64)
    out[1:] = _reduced((high >> _U(29)) + ((high & _U((1 << 29) - 1)) << _U(32)) + (low >> _U(61)) + (low & _P))
    return out


def _between(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    back = _power(pow(base, -1, PRIME), len(sums))
    return times(_reduced(sums[end] + (_P - sums[begin])), back[begin])


def _spots(spots: np.ndarray, lane: int) -> np.ndarray:
    """A random number for each place * 256 + byte."""
    return mix(mix(spots.astype(np.uint64) + _U(_LANES[lane][1])) + _U(_LANES[lane][1]))


@lru_cache(maxsize=2)
def _near(lane: int) -> np.ndarray:
    return _spots(np.arange(_NEAR * 256), lane)


class Words:
    """Words ``[^ \\t-\\r]+`` of texts, one after the other; ``first[i]:first[i+1]`` are those of text i."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        joined = b" ".join((t or b"") for t in texts) + b" "
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        word = np.concatenate([[False], ~_BLANK[data]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.data, self.begin, self.end = data, edge[0::2], edge[1::2]
        self.letters = data[word[1:]]
        ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.begin, ends)])
        self.count = np.diff(self.first)
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, lane: int = 0) -> np.ndarray:
        if lane not in self._hashes:
            size = self.end - self.begin
            start = np.cumsum(size) - size
            spot = (np.arange(len(self.letters)) - np.repeat(start, size)) << 8 | self.letters
            value = _near(lane)[np.minimum(spot, _NEAR * 256 - 1)]
            far = np.flatnonzero(spot >= _NEAR * 256)
            value[far] = _spots(spot[far], lane)
            sums = np.add.reduceat(value, start) if len(start) else value
            self._hashes[lane] = mix(sums + size.astype(np.uint64))
        return self._hashes[lane]


def windows(values: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive values, by start; across texts too, callers leave those out."""
    begin = np.arange(max(0, len(values) - size + 1))
    if not len(begin):
        return np.zeros(0, np.uint64)
    base = _LANES[lane][0]
    return mix(_between(_prefix(values, base), begin, begin + size, base))


def stretches(values: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of the values from ``begin`` to ``end`` of each stretch."""
    base = _LANES[lane][0]
    return mix(_between(_prefix(values, base), begin, end, base) + mix((end - begin).astype(np.uint64)))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    out, reach = values, 1
    while reach < size:
        step = min(reach, size - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


def starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which ``size`` values of one text begin, and the texts."""
    many = np.maximum(np.diff(first) - size + 1, 0)
    owner = np.repeat(np.arange(len(many)), many)
    return np.repeat(first[:-1], many) + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many), owner
