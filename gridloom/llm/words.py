"""Texts of an Arrow batch as flat byte and word arrays.

Texts stay in Arrow's own buffers: words are found, folded and hashed for a
whole block of documents at once, without a Python object for each word.
Nulls count as empty texts. A block holds at most ``BLOCK_BYTES`` bytes, or
one longer text, which is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; bounds a task's memory.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20_261).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at once, so that they stay in the processor's cache.
_PIECE = 1 << 14
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, _BASE if which == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * BLOCK_BYTES:
            _powers[which] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit name of the ordered pair (a, b)."""
    return mix(mix(a + np.uint64((2 * salt + 1) * 0x632BE59BD9B4E019 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93) + b)


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start[i]:end[i]] for each i."""
    n = len(data)
    sums, up = np.zeros(n + 1, np.uint64), _power("up", n)
    for a in range(0, n, _PIECE):
        part = _BYTES[data[a : a + _PIECE]]
        part *= up[a : a + _PIECE]
        part[:1] += sums[a : a + 1]
        np.cumsum(part, out=sums[a + 1 : a + 1 + len(part)])
    raw = (sums[end] - sums[start]) * _power("down", n + 1)[start]
    return mix(raw ^ (end - start).astype(np.uint64))


@dataclass
class Texts:
    """UTF-8 bytes of consecutive texts; text i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.at) - 1

    def lower(self) -> Texts:
        """A-Z in lower case; other letters stay."""
        return Texts(_LOWER[self.data], self.at, self.first)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """The column's texts in order, in blocks of ``limit`` bytes or one text."""
    data, at = utf8(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Texts(data[at[first] : at[last]], at[first : last + 1] - at[first], first)
        first = last


@dataclass
class Words:
    """Words of a block: bytes start[i]:end[i]; text d has words at[d]:at[d + 1]."""

    texts: Texts
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return range_hashes(self.texts.data, self.start, self.end)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words joined by one space each: bytes, starts and ends there."""
        size = self.end - self.start
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = self.texts.data[~_SPACE[self.texts.data]]
        return out, starts, ends


def words(texts: Texts) -> Words:
    """Maximal runs of bytes other than space, tab and 0x0A-0x0D."""
    n = len(texts.data)
    inside = ~_SPACE[texts.data]
    edge = np.zeros(n + 1, bool)
    edge[texts.at] = True
    left = np.ones(n + 1, bool)
    left[1:] = ~inside
    left |= edge
    start = np.flatnonzero(inside & left[:-1])
    right = np.ones(n + 1, bool)
    right[:-1] = ~inside
    right |= edge
    end = np.flatnonzero(inside & right[1:]) + 1
    return Words(texts, start, end, np.searchsorted(start, texts.at))


def sums_by(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values[at[d]:at[d + 1]] for each d."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
