"""Suffix arrays by external induced sorting.

Suffix tuples (position, in order) go through one first-in-first-out queue for
each first symbol. In induced sorting tuples enter a symbol's queue in their
final order, so the queues together are a priority queue over (symbol, rank);
a queue that outgrows memory goes on in a temporary file. One pass upward
induces the larger-than-next suffixes from the sorted seeds, one pass downward
the others. Seeds get their order from a reduced string of named seed
substrings by recursion; a reduced string that fits in memory is sorted there
by doubling.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that all queues of a pass hold in memory, tuples worked on at once, and symbols that are sorted in memory.
IN_MEMORY, PIECE, BASE = 1 << 22, 1 << 18, 1 << 21


class Queues:
    """First-in-first-out queues of positions, by symbol; beyond ``limit`` tuples they go to a temporary file."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit, self.held, self.file = limit, 0, None
        self.parts: dict[int, list] = {}

    def push(self, symbol: int, positions: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append(positions)
        self.held += len(positions)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="gridloom-")  # noqa: SIM115  it has no name and goes with this object
        for parts in self.parts.values():
            fresh = [p for p in parts if isinstance(p, np.ndarray)]
            if fresh:
                data = np.concatenate(fresh).astype(np.int64)
                parts[:] = [p for p in parts if not isinstance(p, np.ndarray)]
                parts.append((self.file.seek(0, 2), len(data)))
                data.tofile(self.file)
        self.held = 0

    def pop(self, symbol: int) -> Iterator[np.ndarray]:
        """The symbol's positions in order, in pieces; the queue is empty after."""
        near: list[np.ndarray] = []
        size = 0
        for p in self.parts.pop(symbol, []):
            if isinstance(p, np.ndarray):
                self.held -= len(p)
                near.append(p)
                size += len(p)
                if size >= PIECE:
                    yield np.concatenate(near)
                    near, size = [], 0
                continue
            if near:
                yield np.concatenate(near)
                near, size = [], 0
            at, n = p
            for done in range(0, n, PIECE):
                self.file.seek(at + 8 * done)
                yield np.fromfile(self.file, np.int64, min(PIECE, n - done))
        if near:
            yield np.concatenate(near)


def _smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them; the end is smaller than all."""
    n = len(t)
    out = np.zeros(n, bool)
    if n > 1:
        out[:-1] = t[:-1] < t[1:]
        same = np.zeros(n, bool)
        same[:-1] = t[:-1] == t[1:]
        at = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
        last = np.minimum.accumulate(np.where(same, at.dtype.type(n - 1), at)[::-1])[::-1]
        out = out[last]
    return out


def _spread(queues: Queues, t: np.ndarray, positions: np.ndarray) -> None:
    if len(positions):
        key = t[positions]
        order = np.argsort(key, kind="stable")
        key, positions = key[order], positions[order]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            queues.push(int(key[lo]), positions[lo:hi])


def _induce(t: np.ndarray, small: np.ndarray, symbols: list[int], seeds: Queues) -> Iterator[np.ndarray]:
    """All suffixes in descending order, in pieces, from seeds by ascending symbol."""
    n = len(t)
    large, up = Queues(), Queues()
    first = np.array([n - 1], np.int32 if n < 1 << 31 else np.int64)
    _spread(up, t, first[~small[first]])
    for c in symbols:
        waves = list(up.pop(c))
        while waves:
            for wave in waves:
                large.push(c, wave)
                before = wave[wave > 0] - 1
                _spread(up, t, before[~small[before]])
            waves = list(up.pop(c))
        for wave in seeds.pop(c):
            before = wave[wave > 0] - 1
            _spread(up, t, before[~small[before]])
    down = Queues()
    for c in reversed(symbols):
        waves = list(down.pop(c))
        while waves:
            for wave in waves:
                yield wave
                before = wave[wave > 0] - 1
                _spread(down, t, before[small[before]])
            waves = list(down.pop(c))
        for wave in reversed(list(large.pop(c))):
            wave = wave[::-1]
            yield wave
            before = wave[wave > 0] - 1
            _spread(down, t, before[small[before]])


def _doubling(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``t``, whose symbols count from 1, in ascending order; each step sorts those with an equal."""
    n, step = len(t), 1
    count = np.bincount(t)
    rank = (np.cumsum(count) - count + 1)[t]  # the place of the first suffix that looks the same so far
    tied = np.flatnonzero(count[t] > 1)
    while len(tied):
        after = np.zeros(len(tied), np.int64)
        more = tied + step < n
        after[more] = rank[tied[more] + step]
        key = rank[tied] * (n + 1) + after
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        group, place = rank[tied], np.arange(len(tied))
        first, fresh = np.ones(len(tied), bool), np.ones(len(tied) + 1, bool)
        first[1:] = group[1:] != group[:-1]
        fresh[1:-1] = key[1:] != key[:-1]
        rank[tied] = group + np.maximum.accumulate(np.where(fresh[:-1], place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
        tied = tied[~(fresh[:-1] & fresh[1:])]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank - 1] = np.arange(n)
    return out


def gathered(pieces: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """The same positions in pieces of ``size`` or more, the last one aside."""
    held, n = [], 0
    for p in pieces:
        held.append(p)
        n += len(p)
        if n >= size:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def suffix_array(t: np.ndarray, base: int = BASE) -> Iterator[np.ndarray]:
    """Positions of the suffixes of ``t`` (integers) in descending order, in pieces."""
    n = len(t)
    if n < 2:
        yield np.arange(n)
        return
    kind = np.int32 if n < 1 << 31 else np.int64
    small = _smaller_than_next(t)
    symbols = np.unique(t).tolist()
    seed = np.zeros(n, bool)
    seed[1:] = small[1:] & ~small[:-1]
    at = np.flatnonzero(seed).astype(kind)
    seeds = Queues()
    if len(at) > 1:
        # Seed substrings in order: one induction from seeds by first symbol alone.
        rough = Queues()
        _spread(rough, t, at)
        found = [p[seed[p]] for p in _induce(t, small, symbols, rough)]
        order = np.concatenate(found)[::-1]
        end = np.append(at[1:], n - 1)
        place = np.empty(n, kind)
        place[at] = np.arange(len(at), dtype=kind)
        stop = end[place[order]]
        size = stop - order + 1
        differs = np.ones(len(order), bool)
        differs[1:] = size[1:] != size[:-1]
        x, y = order[1:], order[:-1]
        open_ = np.flatnonzero(~differs[1:])
        offset = 0
        while len(open_):
            apart = t[x[open_] + offset] != t[y[open_] + offset]
            differs[open_[apart] + 1] = True
            offset += 1
            open_ = open_[~apart]
            open_ = open_[size[open_ + 1] > offset]
        differs[1:] |= (stop[1:] == n - 1) != (stop[:-1] == n - 1)
        reduced = np.empty(len(at), np.int64)
        reduced[place[order]] = np.cumsum(differs)
        if int(reduced.max()) == len(at):
            ranked = order
        elif len(at) <= base:
            ranked = at[_doubling(reduced)]
        else:
            ranked = at[np.concatenate(list(suffix_array(reduced, base)))[::-1]]
        _spread(seeds, t, ranked)
    else:
        _spread(seeds, t, at)
    yield from _induce(t, small, symbols, seeds)
