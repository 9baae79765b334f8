"""XXH64 of many byte strings at once (published algorithm and constants)."""

from __future__ import annotations

import numpy as np

# The primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of data[start[i]:end[i]] for each i, as uint64."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    halves = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    size, pos = end - start, start.copy()
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(start), s + P5, np.uint64)
        act = np.flatnonzero(size >= 32)
        if len(act):
            acc = np.empty((4, len(act)), np.uint64)
            acc[:] = np.array([s + P1 + P2, s + P2, s, s - P1], np.uint64)[:, None]
            stripes, done = size[act] // 32, 0
            live = np.arange(len(act))
            while len(live):
                at = pos[act[live]]
                for k in range(4):
                    acc[k, live] = _round(acc[k, live], lanes[at + 8 * k])
                pos[act[live]] += 32
                done += 1
                live = live[stripes[live] > done]
            v = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for k in range(4):
                v = (v ^ _round(np.zeros(len(act), np.uint64), acc[k])) * P1 + P4
            h[act] = v
        h += size.astype(np.uint64)
        for _ in range(3):
            act = np.flatnonzero(end - pos >= 8)
            if not len(act):
                break
            h[act] = _turn(h[act] ^ _round(np.uint64(0), lanes[pos[act]]), 27) * P1 + P4
            pos[act] += 8
        act = np.flatnonzero(end - pos >= 4)
        h[act] = _turn(h[act] ^ (halves[pos[act]].astype(np.uint64) * P1), 23) * P2 + P3
        pos[act] += 4
        for _ in range(3):
            act = np.flatnonzero(end > pos)
            if not len(act):
                break
            h[act] = _turn(h[act] ^ (padded[pos[act]].astype(np.uint64) * P5), 11) * P1
            pos[act] += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
