"""Vectorised hashes of words and of word windows over UTF-8 bytes (numpy)."""

from __future__ import annotations

import re

import numpy as np

#: Bytes hashed at once: bounds the temporary arrays whatever a text's length.
SLICE = 1 << 20
_CYCLE = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = _powers(0x5851F42D4C957F2D, _CYCLE)


def _hash_slice(data: np.ndarray) -> np.ndarray:
    solid = ~_SPACE[data]
    edge = np.diff(solid.astype(np.int8), prepend=0)
    if not solid.any():
        return np.empty(0, np.uint64)
    body = data[solid]
    first = np.nonzero(edge == 1)[0]
    places = np.cumsum(solid) - 1
    starts = places[first]
    lengths = np.diff(starts, append=len(body))
    inside = np.arange(len(body)) - np.repeat(starts, lengths)
    terms = _BYTE[body] * _PLACE[inside & (_CYCLE - 1)]
    return mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(data: bytes) -> np.ndarray:
    """64-bit hash of each word (runs of bytes other than space and 09-0D), in order."""
    if len(data) <= SLICE:
        return _hash_slice(np.frombuffer(data, np.uint8))
    parts, at = [], 0
    while at < len(data):
        stop = len(data)
        if stop - at > SLICE:
            cut = _BREAK.search(data, at + SLICE)
            stop = cut.start() if cut else stop
        parts.append(_hash_slice(np.frombuffer(data, np.uint8, stop - at, at)))
        at = stop
    return np.concatenate(parts)


class Windows:
    """Hashes of all windows of ``length`` consecutive words."""

    def __init__(self, length: int, base: int):
        self.length, self.base, self.inverse = length, base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        n = len(words) - self.length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        if len(self.up) < len(words):
            size = max(len(words), 1 << 12)
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=sums[1:])
        return mix((sums[self.length :] - sums[:-self.length]) * self.down[:n])


class BitFilter:
    """A Bloom filter of fixed size, cut into slices that can be built apart.

    The top bits of a hash choose the slice, two other bit fields the two bits
    set in it.  Its size is bounded by ``MOST_BITS`` whatever the data; when it
    fills up it lets more through, and never drops a member.
    """

    SLICES = 64
    LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits = bits
        self.per_slice = bits // self.SLICES
        self.data = np.zeros(bits // 8, np.uint8) if words is None else words

    @classmethod
    def sized(cls, expected: int) -> int:
        wanted = 1 << max(0, (16 * max(expected, 1) - 1)).bit_length()
        return min(cls.MOST_BITS, max(cls.LEAST_BITS, wanted))

    @staticmethod
    def slice_of(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(58)).astype(np.int64)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        span = np.uint64(self.per_slice - 1)
        base = self.slice_of(h) * self.per_slice
        return base + (h & span).astype(np.int64), base + ((h >> np.uint64(29)) & span).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for at in self._places(h):
            np.bitwise_or.at(self.data, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = self._places(h)
        return ((self.data[a >> 3] >> (a & 7).astype(np.uint8)) & (self.data[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
