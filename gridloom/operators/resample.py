"""Resampling of planes: separable kernels, translation, field lifting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import Index, at, clamped, div, grid, let, lit, mirrored, total
from ..functions.kernels import Kernel, phases


def _taps(kernel: Kernel, scale: int) -> list[tuple[Column, Column]]:
    """(offsets, weights) of each tap as arrays by phase; short phases end in taps of weight 0."""
    table = phases(kernel, scale)
    most = max(map(len, table))
    full = [[*t, *[(0, 0.0)] * (most - len(t))] for t in table]
    return [(F.array(*(F.lit(p[k][0]) for p in full)), F.array(*(F.lit(p[k][1]) for p in full))) for k in range(most)]


def upsample(v: Column, w: Index, h: Index, scale: int, kernel: Kernel) -> Column:
    """The plane ``scale`` times as large: rows first, then columns, taps in order."""
    taps, w, h = _taps(kernel, scale), lit(w), lit(h)

    def across(u: Column) -> Column:
        return grid(w * scale, h, lambda y, x: total([at(wt, x % scale) * at(u, y * w + mirrored(div(x, scale) + at(off, x % scale), w)) for off, wt in taps]))

    def down(u: Column) -> Column:
        return grid(w * scale, h * scale, lambda y, x: total([at(wt, y % scale) * at(u, mirrored(div(y, scale) + at(off, y % scale), h) * w * scale + x) for off, wt in taps]))

    return let(let(v, across), down)


def repeat(v: Column, w: Index, h: Index, scale: int) -> Column:
    """Every sample ``scale`` times in both directions."""
    return let(v, lambda u: grid(lit(w) * scale, lit(h) * scale, lambda y, x: at(u, div(y, scale) * lit(w) + div(x, scale))))


def _bilinear(u: Column, w: Column, h: Column, sy: Column, sx: Column) -> Column:
    def mixed(y: Column, x: Column, fy: Column, fx: Column) -> Column:
        x0, x1, y0, y1 = clamped(x, w), clamped(x + 1, w), clamped(y, h), clamped(y + 1, h)
        return total([at(u, y0 * w + x0) * (1 - fx) * (1 - fy), at(u, y0 * w + x1) * fx * (1 - fy), at(u, y1 * w + x0) * (1 - fx) * fy, at(u, y1 * w + x1) * fx * fy])

    return mixed(F.floor(sy).cast("int"), F.floor(sx).cast("int"), sy - F.floor(sy), sx - F.floor(sx))


def shift(v: Column, w: Index, h: Index, dx: Column | float, dy: Column | float) -> Column:
    """Bilinear translation by (dx, dy), border samples held."""
    w, h, dx, dy = lit(w), lit(h), lit(dx), lit(dy)

    def held(i: Column, d: Column, n: Column) -> Column:
        return F.least(n - 1.0, F.greatest(F.lit(0.0), i - d))

    return let(v, lambda u: grid(w, h, lambda y, x: _bilinear(u, w, h, held(y, dy, h), held(x, dx, w))))


def lift(v: Column, w: Index, h: Index, scale: int) -> Column:
    """A field of source samples at output samples, bilinear with centres aligned and borders held."""
    w, h = lit(w), lit(h)
    return let(v, lambda u: grid(w * scale, h * scale, lambda y, x: _bilinear(u, w, h, (y + 0.5) / scale - 0.5, (x + 0.5) / scale - 0.5)))
