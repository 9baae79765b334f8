"""Stencils over planes as higher-order expressions: narrow, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Index = Column | int


def lit(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def at(v: Column, i: Column) -> Column:
    return F.get(v, i.cast("int"))


def div(a: Index, b: Index) -> Column:
    return F.call_function("div", lit(a), lit(b)).cast("int")


def clamped(i: Index, n: Index) -> Column:
    return F.greatest(F.lit(0), F.least(lit(i), lit(n) - 1))


def mirrored(i: Index, n: Index) -> Column:
    """Whole-sample reflection at both ends, then held inside: defined for any n of 1 or more."""
    i, n = lit(i), lit(n)
    return clamped(F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i), n)


def grid(w: Index, h: Index, value: Callable[[Column, Column], Column]) -> Column:
    """The plane of value(y, x)."""
    w, h = lit(w), lit(h)
    return F.transform(F.sequence(F.lit(0), (w * h - 1).cast("int")), lambda i: value(div(i, w), i % w))


def total(terms: list[Column]) -> Column:
    """A sum in the order of its terms."""
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def array_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
