"""Regularisation: Laplacian, lifted maps, edge overshoot, deblocking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import Index, at, grid, let, lit
from .descriptors import PERIOD, descriptors, neighbour
from .resample import lift

#: Weights of the frequency and edge terms.
ETA_FREQUENCY, ETA_EDGE = 0.0, 0.05


@dataclass(frozen=True)
class Deblock:
    """Weight of the deblocking term and the most that it moves a sample."""

    eta: float = 0.1
    cap: float = 0.5


def laplacian(v: Column, w: Index, h: Index) -> Column:
    """4 * sample - left - right - above - below, border samples repeated."""
    return let(v, lambda u: grid(w, h, lambda y, x: 4.0 * neighbour(u, w, h, y, x) - neighbour(u, w, h, y, x - 1) - neighbour(u, w, h, y, x + 1) - neighbour(u, w, h, y - 1, x) - neighbour(u, w, h, y + 1, x)))


def maps(v: Column, w: Index, h: Index, scale: int) -> Column:
    """Struct of output-size planes: alias risk, edge confidence, least and largest neighbours of a source plane."""
    return let(descriptors(v, w, h), lambda d: F.struct(*(lift(d[k], w, h, scale).alias(k) for k in ("alias", "edge", "lo", "hi"))))


def edge_step(x: Column, m: Column, eta: float = ETA_EDGE) -> Column:
    """2 * eta * edge * (what of x is beyond the local range)."""
    return let(m, lambda d: F.transform(x, lambda s, i: 2.0 * eta * at(d["edge"], i) * F.when(s > at(d["hi"], i), s - at(d["hi"], i)).when(s < at(d["lo"], i), s - at(d["lo"], i)).otherwise(0.0)))


def frequency_step(x: Column, alias: Column, w: Index, h: Index, eta: float) -> Column:
    """2 * eta * Laplacian of (alias * Laplacian of x)."""
    weighted = F.zip_with(alias, laplacian(x, w, h), lambda a, b: a * b)
    return F.transform(laplacian(weighted, w, h), lambda s: eta * 2.0 * s)


def step(x: Column, m: Column, w: Index, h: Index, eta_frequency: float = ETA_FREQUENCY, eta_edge: float = ETA_EDGE) -> Column:
    """Both terms; one with weight 0 is left out of the plan."""
    if eta_frequency == 0.0:
        return edge_step(x, m, eta_edge)
    return F.zip_with(frequency_step(x, m["alias"], w, h, eta_frequency), edge_step(x, m, eta_edge), lambda a, b: a + b)


def deblock(x: Column, w: Index, h: Index, scale: int, stats: Column, p: Deblock) -> Column:
    """Corrections beside the interior lines of the artifact grid, within the cap; 0 elsewhere and where nothing was found."""
    w, h, period = lit(w), lit(h), PERIOD * scale

    def plane(u: Column, s: Column) -> Column:
        def on_line(i: Column, phase: Column) -> Column:
            return F.pmod(i - phase * scale, F.lit(period)) == 0

        def value(y: Column, c: Column) -> Column:
            own = at(u, y * w + c)
            near = F.lit(0.0)
            for hit, dy, dx in (((on_line(c, s["phase_x"])) & (c > 0), 0, -1), (on_line(c + 1, s["phase_x"]) & (c < w - 1), 0, 1), (on_line(y, s["phase_y"]) & (y > 0), -1, 0), (on_line(y + 1, s["phase_y"]) & (y < h - 1), 1, 0)):
                near = near + F.when(hit, neighbour(u, w, h, y + dy, c + dx) - own).otherwise(0.0)
            return F.greatest(F.lit(-p.cap), F.least(F.lit(p.cap), p.eta * s["strength"] * near))

        return F.when(s["strength"] == 0.0, F.transform(u, lambda _: F.lit(0.0))).otherwise(grid(w, h, value))

    return let(x, lambda u: let(stats, lambda s: plane(u, s)))
