"""The forward model: box means, residuals, projection, ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import Index, array_sum, at, div, grid, let, lit, total


def box_mean(v: Column, w: Index, h: Index, scale: int) -> Column:
    """Means of scale x scale blocks of a w x h plane, samples added in row order; fails unless both sides divide."""
    w, h = lit(w), lit(h)
    checked = F.when((w % scale == 0) & (h % scale == 0), v).otherwise(F.raise_error(F.lit("box mean of a plane that the scale does not divide")))
    cells = [(dy, dx) for dy in range(scale) for dx in range(scale)]
    return let(checked, lambda u: grid(div(w, scale), div(h, scale), lambda y, x: total([at(u, (y * scale + dy) * w + x * scale + dx) for dy, dx in cells]) / float(scale * scale)))


def residual(x: Column, y: Column, w: Index, h: Index, scale: int) -> Column:
    """y less the box means of x; w and h are of y."""
    return F.zip_with(y, box_mean(x, lit(w) * scale, lit(h) * scale, scale), lambda a, b: a - b)


def rms(r: Column) -> Column:
    return F.sqrt(array_sum(F.transform(r, lambda a: a * a)) / F.size(r))


def project(x: Column, y: Column, w: Index, h: Index, scale: int) -> Column:
    """x with every block moved so that its mean is the sample of y."""
    w, h = lit(w), lit(h)
    return let(x, lambda u: let(residual(u, y, w, h, scale), lambda r: F.transform(u, lambda s, i: s + at(r, div(div(i, w * scale), scale) * w + div(i % (w * scale), scale)))))


def is_constant(v: Column) -> Column:
    return F.array_min(v) == F.array_max(v)


def value_range(v: Column) -> Column:
    return F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
