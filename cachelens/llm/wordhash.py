"""Vectorised words and hashes of word windows over many texts at once.

Words are maximal runs of bytes outside space and \\x09-\\x0D, which in UTF-8 are the words of the same class of characters.
A word's hash sums a random 64-bit value of each byte times a power of its place; a window's hash sums its words'
hashes times powers of their places, by prefix sums.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words:
    """The words of some texts: ``start`` and ``end`` in ``buf``, and the range ``first[d]:first[d + 1]`` of text ``d``."""

    def __init__(self, texts: list[bytes]):
        self.buf = buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[buf]
        turn = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = turn[::2], turn[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.space = space

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


class Lane:
    """One independent family of hashes, fixed by ``seed``."""

    def __init__(self, seed: int):
        self.byte = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x1000003))
        self.byte[_SPACE] = 0
        self.base = int(mix(np.array([seed * 2 + 12345], U))[0]) | 1
        self.step = int(mix(np.array([seed * 2 + 54321], U))[0]) | 1
        self.back = pow(self.step, -1, 2**64)
        self._cache: dict[int, np.ndarray] = {}

    def powers(self, of: int, n: int) -> np.ndarray:
        """At least n powers of ``of``; kept and grown by doubling."""
        have = self._cache.get(of)
        if have is None or len(have) < n:
            have, size = np.array([1], U), 1
            with np.errstate(over="ignore"):
                while size < n:
                    have = np.concatenate([have, have * U(pow(of, size, 2**64))])
                    size *= 2
            self._cache[of] = have
        return have[:n]

    def words(self, w: Words) -> np.ndarray:
        """The hash of each word."""
        if not len(w):
            return np.zeros(0, U)
        with np.errstate(over="ignore"):
            span = np.diff(w.start, append=len(w.buf))
            place = np.arange(w.start[0], len(w.buf)) - np.repeat(w.start, span)
            longest = int((w.end - w.start).max()) + 1
            np.minimum(place, longest - 1, out=place)
            x = self.byte[w.buf[w.start[0] :]]
            x *= self.powers(self.base, longest)[place]
            return mix(np.add.reduceat(x, w.start - w.start[0]))

    def prefix(self, words: np.ndarray) -> np.ndarray:
        """Prefix sums from which ``windows`` takes any window."""
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, U), np.cumsum(words * self.powers(self.step, len(words)))])

    def windows(self, prefix: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
        """The hashes of the windows of ``k`` words that start at the words ``at``."""
        with np.errstate(over="ignore"):
            return mix((prefix[at + k] - prefix[at]) * self.powers(self.back, len(prefix))[at])
