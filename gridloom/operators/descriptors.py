"""Local descriptors and block-artifact statistics of planes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import Index, array_sum, at, clamped, grid, let, lit, total

# Scales and floors that results depend on.
EDGE_SCALE, VARIANCE_SCALE, DETAIL_SCALE, COHERENCE_FLOOR = 32.0, 1600.0, 24.0, 1e-12
PERIOD, RATIO_GATE, RATIO_ALONE = 8, 1.35, 1000.0


def neighbour(v: Column, w: Index, h: Index, y: Column, x: Column) -> Column:
    """The sample at (y, x), border samples held."""
    return at(v, clamped(y, h) * lit(w) + clamped(x, w))


def gradient_x(v: Column, w: Index, h: Index) -> Column:
    """Central differences along rows, one-sided at borders; 0 where a row has one sample."""
    n = lit(w)
    return let(v, lambda u: grid(w, h, lambda y, x: (neighbour(u, w, h, y, x + 1) - neighbour(u, w, h, y, x - 1)) / F.greatest(clamped(x + 1, n) - clamped(x - 1, n), F.lit(1))))


def gradient_y(v: Column, w: Index, h: Index) -> Column:
    n = lit(h)
    return let(v, lambda u: grid(w, h, lambda y, x: (neighbour(u, w, h, y + 1, x) - neighbour(u, w, h, y - 1, x)) / F.greatest(clamped(y + 1, n) - clamped(y - 1, n), F.lit(1))))


def gradient_l1(v: Column, w: Index, h: Index) -> Column:
    """|right - left| + |below - above|, not divided."""
    return let(v, lambda u: grid(w, h, lambda y, x: F.abs(neighbour(u, w, h, y, x + 1) - neighbour(u, w, h, y, x - 1)) + F.abs(neighbour(u, w, h, y + 1, x) - neighbour(u, w, h, y - 1, x))))


def _window(u: Column, w: Index, h: Index, y: Column, x: Column) -> list[Column]:
    return [neighbour(u, w, h, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def local_min(v: Column, w: Index, h: Index) -> Column:
    return let(v, lambda u: grid(w, h, lambda y, x: F.least(*_window(u, w, h, y, x))))


def local_max(v: Column, w: Index, h: Index) -> Column:
    return let(v, lambda u: grid(w, h, lambda y, x: F.greatest(*_window(u, w, h, y, x))))


def local_mean(v: Column, w: Index, h: Index) -> Column:
    return let(v, lambda u: grid(w, h, lambda y, x: total(_window(u, w, h, y, x)) / 9.0))


def local_variance(v: Column, w: Index, h: Index) -> Column:
    """max(0, mean of squares less square of mean) of 3 x 3 samples."""

    def variance(cells: list[Column]) -> Column:
        mean = total(cells) / 9.0
        return F.greatest(F.lit(0.0), total([c * c for c in cells]) / 9.0 - mean * mean)

    return let(v, lambda u: grid(w, h, lambda y, x: variance(_window(u, w, h, y, x))))


def coherence(gx: Column, gy: Column, w: Index, h: Index) -> Column:
    """(l1 - l2) / (l1 + l2) of the 3 x 3 structure tensor of gradients; 0 where their sum is next to none."""

    def of(a: list[Column], b: list[Column]) -> Column:
        xx, yy, xy = total([p * p for p in a]), total([p * p for p in b]), total([p * q for p, q in zip(a, b, strict=True)])
        spread = F.sqrt((xx - yy) * (xx - yy) + 4.0 * xy * xy)
        return F.when(xx + yy > COHERENCE_FLOOR, spread / (xx + yy)).otherwise(0.0)

    return let(gx, lambda p: let(gy, lambda q: grid(w, h, lambda y, x: of(_window(p, w, h, y, x), _window(q, w, h, y, x)))))


def descriptors(v: Column, w: Index, h: Index) -> Column:
    """Struct of planes: edge confidence, alias risk, and the least and largest of 3 x 3 samples."""

    def compose(u: Column) -> Column:
        def fields(gx: Column, gy: Column, coh: Column, mean: Column, var: Column) -> Column:
            n = F.sequence(F.lit(0), F.size(u) - 1)
            edge = F.transform(n, lambda i: at(coh, i) * F.least(F.lit(1.0), F.hypot(at(gx, i), at(gy, i)) / EDGE_SCALE))
            alias = F.transform(n, lambda i: F.least(F.lit(1.0), F.abs(at(u, i) - at(mean, i)) / DETAIL_SCALE) * (1 - at(coh, i)) * F.least(F.lit(1.0), at(var, i) / VARIANCE_SCALE))
            return F.struct(edge.alias("edge"), alias.alias("alias"), local_min(u, w, h).alias("lo"), local_max(u, w, h).alias("hi"))

        return let(gradient_x(u, w, h), lambda gx: let(gradient_y(u, w, h), lambda gy: let(coherence(gx, gy, w, h), lambda coh: let(local_mean(u, w, h), lambda m: let(local_variance(u, w, h), lambda s: fields(gx, gy, coh, m, s))))))

    return let(v, compose)


def _best_phase(steps: Column, place: Column, count: Column) -> Column:
    """(ratio, phase) with the largest ratio of boundary to interior mean step; the lowest phase wins, 1.0 and 0 without any."""

    def at_phase(p: Column, every: Column) -> Column:
        own = array_sum(F.zip_with(steps, place, lambda d, x: F.when(x % PERIOD == p, d).otherwise(0.0)))
        n = F.size(F.filter(place, lambda x: x % PERIOD == p))
        inner, m = every - own, count - n
        ratio = F.when((inner > 0) & (m > 0), (own / F.greatest(n, F.lit(1))) / (inner / F.greatest(m, F.lit(1)))).when(own > 0, RATIO_ALONE).otherwise(1.0)
        return F.struct(F.when(n > 0, ratio).otherwise(0.0).alias("ratio"), (-p).alias("down"))

    best = let(array_sum(steps), lambda every: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(PERIOD - 1)), lambda p: at_phase(p, every))))
    return let(best, lambda b: F.when(b["ratio"] > 1.0, F.struct(b["ratio"].alias("ratio"), (-b["down"]).alias("phase"))).otherwise(F.struct(F.lit(1.0).alias("ratio"), F.lit(0).alias("phase"))))


def artifact_stats(v: Column, w: Index, h: Index) -> Column:
    """Struct ratio_h, ratio_v, phase_x, phase_y, present, strength of 8-sample block edges; none below 2 x 2 samples."""
    w, h = lit(w), lit(h)

    def stats(u: Column) -> Column:
        across = grid(w - 1, h, lambda y, x: F.abs(at(u, y * w + x + 1) - at(u, y * w + x)))
        across_at = grid(w - 1, h, lambda y, x: x + 1)
        down = grid(w, h - 1, lambda y, x: F.abs(at(u, (y + 1) * w + x) - at(u, y * w + x)))
        down_at = grid(w, h - 1, lambda y, x: y + 1)

        def found(a: Column, b: Column) -> Column:
            most = F.greatest(a["ratio"], b["ratio"])
            strength = F.when(most > RATIO_GATE, F.least(F.lit(1.0), most - RATIO_GATE)).otherwise(0.0)
            return F.struct(a["ratio"].alias("ratio_h"), b["ratio"].alias("ratio_v"), a["phase"].alias("phase_x"), b["phase"].alias("phase_y"), (most > RATIO_GATE).alias("present"), strength.alias("strength"))

        return let(_phases(across, across_at), lambda a: let(_phases(down, down_at), lambda b: found(a, b)))

    def _phases(steps: Column, place: Column) -> Column:
        return let(steps, lambda d: let(place, lambda x: _best_phase(d, x, F.size(d))))

    none = F.struct(F.lit(1.0).alias("ratio_h"), F.lit(1.0).alias("ratio_v"), F.lit(0).alias("phase_x"), F.lit(0).alias("phase_y"), F.lit(False).alias("present"), F.lit(0.0).alias("strength"))
    return F.when((w < 2) | (h < 2), none).otherwise(let(v, stats))


__all__ = ["artifact_stats", "coherence", "descriptors", "gradient_l1", "gradient_x", "gradient_y", "local_max", "local_mean", "local_min", "local_variance", "neighbour"]
