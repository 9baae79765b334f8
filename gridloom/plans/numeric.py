"""The reconstruction loop on NumPy stacks of equal-size planes, for Arrow batches.

All functions take stacks (n, h, w) and add taps and samples in a fixed order,
so that a plane's result does not depend on its batch.
"""

from __future__ import annotations

import numpy as np

from ..functions.kernels import Kernel, phases
from ..operators.descriptors import COHERENCE_FLOOR, DETAIL_SCALE, EDGE_SCALE, PERIOD, RATIO_ALONE, RATIO_GATE, VARIANCE_SCALE
from ..operators.quantize import AMPLITUDE, BYTE, bayer
from ..operators.regularize import ETA_EDGE, Deblock


def _axis(p: np.ndarray, scale: int, kernel: Kernel, axis: int) -> np.ndarray:
    n, table = p.shape[axis], phases(kernel, scale)
    place = np.arange(n)
    shape = [*p.shape]
    shape[axis] = n * scale
    out = np.empty(shape)
    for phase, taps in enumerate(table):
        value = None
        for off, wt in taps:
            i = place + off
            i = np.where(i < 0, -i, np.where(i >= n, 2 * n - 2 - i, i)).clip(0, n - 1)
            term = wt * p.take(i, axis)
            value = term if value is None else value + term
        out[(slice(None), slice(phase, None, scale)) if axis == 1 else (slice(None), slice(None), slice(phase, None, scale))] = value
    return out


def upsample(p: np.ndarray, scale: int, kernel: Kernel) -> np.ndarray:
    return _axis(_axis(p, scale, kernel, 2), scale, kernel, 1)


def box_mean(x: np.ndarray, s: int) -> np.ndarray:
    out = None
    for dy in range(s):
        for dx in range(s):
            out = x[:, dy::s, dx::s] + (0.0 if out is None else out)
    return out / float(s * s)


def blocks(r: np.ndarray, s: int) -> np.ndarray:
    return r.repeat(s, 1).repeat(s, 2)


def _bilinear(p: np.ndarray, y: np.ndarray, fy: np.ndarray, x: np.ndarray, fx: np.ndarray) -> np.ndarray:
    """Samples between rows y and y + 1, columns x and x + 1, at fractions fy and fx; borders held."""
    h, w = p.shape[1:]
    fy, fx = fy[:, None], fx[None, :]
    y0, y1, x0, x1 = (i.clip(0, n - 1) for i, n in ((y, h), (y + 1, h), (x, w), (x + 1, w)))
    top, low = p[:, y0], p[:, y1]
    return top[:, :, x0] * (1 - fx) * (1 - fy) + top[:, :, x1] * fx * (1 - fy) + low[:, :, x0] * (1 - fx) * fy + low[:, :, x1] * fx * fy


def shift(p: np.ndarray, dx: float, dy: float) -> np.ndarray:
    h, w = p.shape[1:]
    sy, sx = np.clip(np.arange(h) - dy, 0.0, h - 1.0), np.clip(np.arange(w) - dx, 0.0, w - 1.0)
    y, x = np.floor(sy).astype(int), np.floor(sx).astype(int)
    return _bilinear(p, y, sy - y, x, sx - x)


def shift_each(p: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """``shift`` with each plane's own dx and dy."""
    n, h, w = p.shape
    sy, sx = np.clip(np.arange(h) - dy[:, None], 0.0, h - 1.0), np.clip(np.arange(w) - dx[:, None], 0.0, w - 1.0)
    y, x = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = (sy - y)[:, :, None], (sx - x)[:, None, :]
    k = np.arange(n)[:, None, None]
    y0, y1, x0, x1 = y[:, :, None], (y + 1).clip(0, h - 1)[:, :, None], x[:, None, :], (x + 1).clip(0, w - 1)[:, None, :]
    return p[k, y0, x0] * (1 - fx) * (1 - fy) + p[k, y0, x1] * fx * (1 - fy) + p[k, y1, x0] * (1 - fx) * fy + p[k, y1, x1] * fx * fy


def lift(p: np.ndarray, s: int) -> np.ndarray:
    """Fields of source samples at output samples; fractions depend on the phase alone, so that a tile has those of its image."""

    def places(n: int) -> tuple[np.ndarray, np.ndarray]:
        off = (np.arange(s) + 0.5) / s - 0.5
        low = np.floor(off).astype(int)
        return (np.arange(n)[:, None] + low).reshape(-1), np.tile(off - low, n)

    h, w = p.shape[1:]
    return _bilinear(p, *places(h), *places(w))


def _cells(p: np.ndarray) -> list[np.ndarray]:
    h, w = p.shape[1:]
    q = np.pad(p, ((0, 0), (1, 1), (1, 1)), "edge")
    return [q[:, dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)]


def _fold(parts) -> np.ndarray:
    out = None
    for p in parts:
        out = p if out is None else out + p
    return out


def gradients(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, w = p.shape[1:]
    c = _cells(p)
    x, y = np.arange(w), np.arange(h)
    across = np.maximum((x + 1).clip(0, w - 1) - (x - 1).clip(0, w - 1), 1)
    down = np.maximum((y + 1).clip(0, h - 1) - (y - 1).clip(0, h - 1), 1)
    return (c[5] - c[3]) / across, (c[7] - c[1]) / down[:, None]


def gradient_l1(p: np.ndarray) -> np.ndarray:
    c = _cells(p)
    return np.abs(c[5] - c[3]) + np.abs(c[7] - c[1])


def descriptors(p: np.ndarray) -> dict[str, np.ndarray]:
    gx, gy = gradients(p)
    a, b, c = _cells(gx), _cells(gy), _cells(p)
    xx, yy, xy = _fold(i * i for i in a), _fold(i * i for i in b), _fold(i * j for i, j in zip(a, b, strict=True))
    both = xx + yy
    some = both > COHERENCE_FLOOR
    coherence = np.where(some, np.sqrt((xx - yy) ** 2 + 4.0 * xy * xy) / np.where(some, both, 1.0), 0.0)
    mean = _fold(c) / 9.0
    variance = np.maximum(0.0, _fold(i * i for i in c) / 9.0 - mean * mean)
    stack = np.stack(c)
    return {
        "edge": coherence * np.minimum(1.0, np.hypot(gx, gy) / EDGE_SCALE),
        "alias": np.minimum(1.0, np.abs(p - mean) / DETAIL_SCALE) * (1 - coherence) * np.minimum(1.0, variance / VARIANCE_SCALE),
        "lo": stack.min(0),
        "hi": stack.max(0),
    }


def artifact_stats(p: np.ndarray) -> dict[str, float]:
    """Statistics of one plane (h, w)."""
    out = {"strength": 0.0, "phase_x": 0, "phase_y": 0}
    if min(p.shape) < 2:
        return out
    ratios = []
    for name, steps in (("phase_x", np.abs(np.diff(p, axis=1)).sum(0)), ("phase_y", np.abs(np.diff(p, axis=0)).sum(1))):
        place = np.arange(1, len(steps) + 1) % PERIOD
        lines = p.shape[0] if name == "phase_x" else p.shape[1]
        best, every = 1.0, steps.sum()
        for phase in range(PERIOD):
            here = place == phase
            own, n, m = steps[here].sum(), here.sum() * lines, (~here).sum() * lines
            if not n:
                continue
            inner = every - own if m else 0.0
            ratio = (own / n) / (inner / m) if inner > 0 and m else RATIO_ALONE if own > 0 else 1.0
            if ratio > best:
                best, out[name] = ratio, phase
        ratios.append(best)
    if max(ratios) > RATIO_GATE:
        out["strength"] = min(1.0, max(ratios) - RATIO_GATE)
    return out


def deblock(x: np.ndarray, s: int, stats: list[dict], p: Deblock) -> np.ndarray:
    h, w = x.shape[1:]
    out = np.zeros_like(x)
    col, row = np.arange(w), np.arange(h)
    for k, st in enumerate(stats):
        if not st["strength"] or not p.eta:
            continue
        u = x[k]
        q = np.pad(u, 1, "edge")
        line = lambda i, phase: (i - phase * s) % (PERIOD * s) == 0
        near = np.where(line(col, st["phase_x"]) & (col > 0), q[1:-1, :-2] - u, 0.0)
        near = near + np.where(line(col + 1, st["phase_x"]) & (col < w - 1), q[1:-1, 2:] - u, 0.0)
        near = near + np.where((line(row, st["phase_y"]) & (row > 0))[:, None], q[:-2, 1:-1] - u, 0.0)
        near = near + np.where((line(row + 1, st["phase_y"]) & (row < h - 1))[:, None], q[2:, 1:-1] - u, 0.0)
        out[k] = np.clip(p.eta * st["strength"] * near, -p.cap, p.cap)
    return out


def rms(r: np.ndarray) -> np.ndarray:
    return np.sqrt((r * r).mean((1, 2)))


#: Bits behind the point of exact sums of squares, and bits of a limb.
SQUARE_BITS, LIMB_BITS, LIMBS = 200, 32, 10


def square_sum(r: np.ndarray) -> int:
    """The sum of squares of finite samples, in units of 2**-200: exact, so that it is the same in any order and any parts."""
    m, e = np.frexp(r.reshape(-1) * r.reshape(-1))
    m = np.ldexp(m, 53).astype(np.int64)
    at = (e - e.min()).astype(np.int64) if len(e) else e
    total = 0
    for part, up in ((m >> 27, 27), (m & ((1 << 27) - 1), 0)):
        sums = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
        np.add.at(sums, at, part)
        for k in np.flatnonzero(sums):
            move = int(k) + int(e.min()) - 53 + up + SQUARE_BITS
            total += int(sums[k]) << move if move >= 0 else int(sums[k]) >> -move
    return total


def limbs(total: int) -> list[int]:
    """A sum as numbers of 32 bits, the lowest first, which add up limb by limb."""
    return [total >> LIMB_BITS * k & ((1 << LIMB_BITS) - 1) for k in range(LIMBS - 1)] + [total >> LIMB_BITS * (LIMBS - 1)]


def root_mean(parts: list[int], count: int) -> float:
    """The root of the mean of ``count`` squares whose limbs add up to ``parts``."""
    return float(np.sqrt(sum(int(x) << LIMB_BITS * k for k, x in enumerate(parts)) / (count << SQUARE_BITS)))


def exact_rms(r: np.ndarray) -> np.ndarray:
    """``rms`` by exact sums: which pass an image stops at does not depend on how it is cut."""
    return np.array([root_mean([square_sum(p)], p.size) for p in r])


def stops(before: float, now: float, tolerance: float) -> bool:
    """Whether a pass has not made the residual worse and gained no more than the tolerance."""
    return now <= before and (before - now) / max(before, 1e-15) <= tolerance


def one_pass(y: np.ndarray, x: np.ndarray, s: int, edge: np.ndarray, low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray, deblocking: Deblock | None = None, stats: list[dict] | None = None) -> np.ndarray:
    """Back-projection of the residual, held to the local range at edges, clamped and projected; it reads one source sample around."""
    moved = x + upsample(y - box_mean(x, s), s, Kernel.BILINEAR)
    beyond = np.where(moved > high, moved - high, np.where(moved < low, moved - low, 0.0))
    out = moved - 2.0 * ETA_EDGE * edge * beyond
    if deblocking and stats:
        out = out + deblock(moved, s, stats, deblocking)
    out = np.clip(out, lo[:, None, None], hi[:, None, None])
    return out + blocks(y - box_mean(out, s), s)


def reconstruct(y: np.ndarray, s: int, passes: int, lo: np.ndarray, hi: np.ndarray, x: np.ndarray | None = None, deblocking: Deblock | None = None, stats: list[dict] | None = None, auto: tuple[int, int, float] | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Iterative back-projection of a stack: planes, residuals before the first and after each pass, passes used.

    ``auto`` (least, most, tolerance) stops each plane once it no longer gains
    and is not worse; planes that stopped stay as they were.
    """
    x = upsample(y, s, Kernel.LANCZOS3) if x is None else x
    d = descriptors(y)
    edge, low, high = (lift(d[k], s) for k in ("edge", "lo", "hi"))
    size = exact_rms if auto else rms
    history = [size(y - box_mean(x, s))]
    used, live = np.zeros(len(y), int), np.ones(len(y), bool)
    for t in range(auto[1] if auto else passes):
        x = np.where(live[:, None, None], one_pass(y, x, s, edge, low, high, lo, hi, deblocking, stats), x)
        used += live
        history.append(np.where(live, size(y - box_mean(x, s)), history[-1]))
        if auto and t + 1 >= auto[0]:
            live &= ~np.array([stops(a, b, auto[2]) for a, b in zip(history[-2].tolist(), history[-1].tolist(), strict=True)])
            if not live.any():
                break
    return x, history, used


def progressive(y: np.ndarray, scale: int, passes: int, lo: np.ndarray, hi: np.ndarray, deblocking: Deblock | None, stats: list[dict] | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Stages 2, 4, 8 up to ``scale``, each from the one before and against the source: planes and last residuals."""
    x, ends, s = None, [], 1
    while s < scale:
        s *= 2
        x, history, _ = reconstruct(y, s, passes, lo, hi, None if x is None else upsample(x, 2, Kernel.LANCZOS3), deblocking, stats)
        ends.append(history[-1])
    return x, ends


def quantise(x: np.ndarray, y: np.ndarray, s: int, dither: int = 0, amplitude: float = AMPLITUDE, peak: int = BYTE) -> np.ndarray:
    """Whole samples from 0 to ``peak`` with exact block sums, blocks of the whole stack at once."""
    if dither:
        table = (np.array(bayer()).reshape(8, 8) / 64.0 - 0.5) * amplitude
        h, w = x.shape[1:]
        x = x + np.tile(table, (-(-h // 8), -(-w // 8)))[:h, :w]
    c = np.clip(x, 0.0, float(peak))
    n, h, w = y.shape
    flat = c.reshape(n, h, s, w, s).transpose(0, 1, 3, 2, 4).reshape(-1, s * s)
    q = np.floor(flat + 0.5)
    frac = flat - q
    target = float(s * s) * y.reshape(-1)
    err = np.where(target >= 0, np.floor(target + 0.5), -np.floor(0.5 - target)) - q.sum(1)
    while True:
        act = np.flatnonzero(err)
        if not len(act):
            break
        up = err[act] > 0
        room = np.where(up[:, None], q[act] < peak, q[act] > 0)
        key = np.where(room, np.where(up[:, None], frac[act], -frac[act]), -np.inf)
        i = key.argmax(1)
        ok = room[np.arange(len(act)), i]
        step = np.where(up, 1.0, -1.0)
        q[act[ok], i[ok]] += step[ok]
        frac[act[ok], i[ok]] -= step[ok]
        err[act[ok]] -= step[ok]
        err[act[~ok]] = 0
    return q.reshape(n, h, w, s, s).transpose(0, 1, 3, 2, 4).reshape(n, h * s, w * s).astype(np.int32)


def laplacian(p: np.ndarray) -> np.ndarray:
    c = _cells(p)
    return 4.0 * c[4] - c[3] - c[5] - c[1] - c[7]


def maps(p: np.ndarray, s: int) -> dict[str, np.ndarray]:
    """Descriptor fields at output size."""
    return {k: lift(f, s) for k, f in descriptors(p).items()}


def edge_step(x: np.ndarray, m: dict[str, np.ndarray], eta: float = ETA_EDGE) -> np.ndarray:
    return 2.0 * eta * m["edge"] * np.where(x > m["hi"], x - m["hi"], np.where(x < m["lo"], x - m["lo"], 0.0))


def frequency_step(x: np.ndarray, alias: np.ndarray, eta: float) -> np.ndarray:
    return eta * 2.0 * laplacian(alias * laplacian(x))
