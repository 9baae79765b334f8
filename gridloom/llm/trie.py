"""Levels of an n-gram trie in Elias-Fano sequences, each pair of levels in one memory-mapped file.

The upper level has the contexts in order, the lower one the successors of every
context behind one another, made one ascending sequence by their context's
place; successors are places in the shard's own list of words. Monotone
pointers say where a context's successors begin, and a successor is searched
for in its context's range alone. Each has a code of one byte, for a quantised
probability or count, and a rest, mostly 0, that makes the count exact. The
places of successors are the contexts of a next level.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Steps of a quantised probability in each power of 2; the code for none.
STEPS, NONE = 8, 255


class EliasFano:
    """An ascending sequence of 64-bit values: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros
        self.ones = 64 * np.arange(len(zeros)) - zeros

    @staticmethod
    def arrays(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift > 0
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) + 1 if n else 0) + 64
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))])
        return n, bits, low, high, zeros

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of zero, or one, number k (from 0)."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, "right") - 1
        rest = k - before[word]
        bits, at = self.high[word] if one else ~self.high[word], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (bits >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)
            here = np.bitwise_count(part).astype(np.int64)
            go = rest >= here
            rest = np.where(go, rest - here, rest)
            at = np.where(go, at + width, at)
        return word * 64 + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = shift > 0
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at indices i."""
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, q: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value that is at least q, and whether it equals q, among those from ``begin`` to before ``end`` (else n)."""
        out, equal = np.full(len(q), self.n, np.int64), np.zeros(len(q), bool)
        if not self.n or not len(q):
            return out, equal
        high = (q >> np.uint64(self.low_bits)).astype(np.int64)
        low = q & np.uint64((1 << self.low_bits) - 1)
        most = int(self.zeros[-1])
        live = np.flatnonzero(high < most)
        h, want = high[live], low[live]
        # The values with this high part, halved until the first that is large enough is left.
        first = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1 - h, 0)
        until = self._select(h, False) - h
        if end is not None:
            first, until = np.maximum(first, begin[live]), np.minimum(until, end[live])
        last = until
        while (first < last).any():
            open_ = first < last
            middle = (first + last) // 2
            less = self._low(np.minimum(middle, self.n - 1)) < want
            first = np.where(open_ & less, middle + 1, first)
            last = np.where(open_ & ~less, middle, last)
        out[live] = first
        equal[live] = (first < until) & (self._low(np.minimum(first, self.n - 1)) == want)
        return out, equal

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)


class Trie:
    """Successors of contexts with one-byte codes and rests; ``close`` lets the file go."""

    def __init__(self, contexts: np.ndarray, starts: np.ndarray, successors: np.ndarray, codes: np.ndarray, rests: np.ndarray | None = None):
        """contexts ascending uint64; successors (uint64) ascending in each; starts: where each context's begin, and the end; rests: unsigned, else 0."""
        of = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(starts))
        kinds = np.unique(successors)
        self.kinds = np.uint64(max(1, len(kinds)))
        relative = of * self.kinds + np.searchsorted(kinds, successors).astype(np.uint64)
        levels = [EliasFano.arrays(x) for x in (contexts, starts.astype(np.uint64), relative, kinds)]
        arrays = [a for _, _, *three in levels for a in three] + [np.zeros(len(codes), np.uint8) if rests is None else rests, codes.astype(np.uint8)]
        self.file = tempfile.TemporaryFile(prefix="gridloom-")  # noqa: SIM115  held open while it is mapped
        places = []
        for a in arrays:
            self.file.write(b"\0" * (-self.file.tell() % 8))
            places.append(self.file.tell())
            self.file.write(a.tobytes())
        self.file.flush()
        mapped = [np.memmap(self.file, a.dtype, "r", p, a.shape) if a.size else a for p, a in zip(places, arrays, strict=True)]
        self.contexts, self.pointers, self.successors, self.words = (EliasFano(n, bits, *mapped[3 * k : 3 * k + 3]) for k, (n, bits, *_) in enumerate(levels))
        self.rests, self.codes = mapped[-2:]

    def find(self, contexts: np.ndarray, successors: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and places of successors (uint64) of contexts, ``size`` of them for each; NONE and the number of places where the trie has none.

        Pointers give each context's range, in which the successor, relative to
        the context, is searched for.
        """
        out, places = np.full(len(successors), NONE, np.uint8), np.full(len(successors), self.successors.n, np.uint64)
        place, known = self.contexts.successor(contexts)
        asked, name = np.unique(successors, return_inverse=True)
        word, spelt = (x[name] for x in self.words.successor(asked))
        live = np.flatnonzero(np.repeat(known, size) & spelt)
        of = np.repeat(place, size)[live]
        want = of.astype(np.uint64) * self.kinds + word[live].astype(np.uint64)
        begin, end = (np.repeat(self.pointers.get(np.where(known, place + k, 0)), size)[live].astype(np.int64) for k in (0, 1)) if self.contexts.n else (np.zeros(0, np.int64),) * 2
        at, found = self.successors.successor(want, begin, end)
        out[live[found]] = self.codes[at[found]]
        places[live[found]] = at[found]
        return out, places

    def rest(self, places: np.ndarray) -> np.ndarray:
        """Rests of the successors at the places that ``find`` gives; 0 where the trie has none."""
        out, here = np.zeros(len(places), self.rests.dtype), np.flatnonzero(places < self.successors.n)
        out[here] = self.rests[places[here].astype(np.int64)]
        return out

    def close(self) -> None:
        del self.contexts, self.pointers, self.successors, self.words, self.rests, self.codes
        self.file.close()


def quantised(p: np.ndarray) -> np.ndarray:
    """One-byte codes of probabilities, rounded down; too small ones have none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.ceil(-STEPS * np.log2(np.maximum(p, 1e-300)) - 1e-9), NONE), NONE).astype(np.uint8)


def probability(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == NONE, 0.0, 2.0 ** (-codes.astype(float) / STEPS))


def at_least(codes: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A count that no count with this code as its share of ``whole`` is below; without a code 0."""
    return np.ceil(probability(codes) * whole * (1 - 2.0**-30))


def count_codes(k: np.ndarray) -> np.ndarray:
    """One-byte codes of counts, rounded down (exact up to 11)."""
    return np.where(k > 0, np.minimum(np.floor(STEPS * np.log2(np.maximum(k, 1)) + 1e-9), NONE - 1), NONE).astype(np.uint8)


def counts(codes: np.ndarray) -> np.ndarray:
    return np.where(codes == NONE, 0.0, np.ceil(2.0 ** (codes.astype(float) / STEPS) * (1 - 2.0**-30)))
