"""Resampling kernels and their taps by phase."""

from __future__ import annotations

import math
from enum import Enum
from functools import lru_cache


class Kernel(Enum):
    NEAREST = "nearest"
    BILINEAR = "bilinear"
    BICUBIC = "bicubic"
    MITCHELL = "mitchell"
    LANCZOS2 = "lanczos2"
    LANCZOS3 = "lanczos3"


RADIUS = {Kernel.NEAREST: 0.5, Kernel.BILINEAR: 1.0, Kernel.BICUBIC: 2.0, Kernel.MITCHELL: 2.0, Kernel.LANCZOS2: 2.0, Kernel.LANCZOS3: 3.0}


def sinc(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)


def cubic(x: float, b: float, c: float) -> float:
    """The two-parameter family of cubic kernels."""
    if x < 1:
        return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
    if x < 2:
        return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
    return 0.0


def weight(kernel: Kernel, x: float) -> float:
    x = abs(x)
    if kernel is Kernel.NEAREST:
        return float(x < 0.5)
    if kernel is Kernel.BILINEAR:
        return max(0.0, 1 - x)
    if kernel is Kernel.BICUBIC:
        return cubic(x, 0.0, 0.5)
    if kernel is Kernel.MITCHELL:
        return cubic(x, 1 / 3, 1 / 3)
    lobes = 2 if kernel is Kernel.LANCZOS2 else 3
    return sinc(x) * sinc(x / lobes) if x < lobes else 0.0


@lru_cache
def phases(kernel: Kernel, scale: int) -> tuple[tuple[tuple[int, float], ...], ...]:
    """For each output phase, (offset from the source sample, weight) with weights that sum to 1.

    Weights repeat with the phase: exactly for scales that are powers of 2, to
    the last bit for others.
    """
    out = []
    for p in range(scale):
        centre, r = (p + 0.5) / scale - 0.5, RADIUS[kernel]
        taps = [(i, weight(kernel, centre - i)) for i in range(math.floor(centre - r) + 1, math.ceil(centre + r))]
        taps = [(i, w) for i, w in taps if w]
        every = sum(w for _, w in taps)
        out.append(tuple((i, w / every) for i, w in taps))
    return tuple(out)
