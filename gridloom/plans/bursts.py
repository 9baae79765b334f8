"""Bursts as a relation of frames: one row a frame, gates and weights as columns.

A frame meets its burst's reference in a join; registration, errors and the
correction of a pass are functions of that one row, computed on stacks of
equal-size planes. Gates and weights are windows over a burst's few numbers. A
pass joins the estimate to the kept frames, and adds their corrections up in
the order of frames. All joins, windows and sums are on (burst_id, c), so that
the frames are shuffled once and the estimates not at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.kernels import Kernel
from ..operators.tiling import BURST_FRAMES, BURST_SIDE, MB, PEAK_MB, burst_bytes
from . import numeric
from .rounds import stored
from .stacks import STACK_SAMPLES

# Fixed values of the gates: steps of the search, how far it is sure, shifts and differences of frames that only alias, bounds of weights.
GRIDS, SURE = ((-1.0, -0.5, 0.0, 0.5, 1.0), (-0.5, 0.0, 0.5), (-0.25, 0.0, 0.25)), 1.5
ALIAS_SHIFT, ALIAS_LEVELS, LEAST_WEIGHT, LEAST_MIDDLE = 0.25, 0.5, 0.1, 1e-6
KEYS = ("burst_id", "c")


def stacked(h: pa.Array, w: pa.Array, planes: list[pa.Array], numbers: list[pa.Array], work: Callable[..., np.ndarray | list[np.ndarray]], scales: tuple[int, ...]) -> list:
    """work(stacks of each of ``planes``, arrays of ``numbers``) for rows of equal size together; what it returns for each row.

    ``scales`` say how many times w and h each plane's sides are.
    """
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, size in enumerate(zip(h.to_pylist(), w.to_pylist(), strict=True)):
        sizes.setdefault(size, []).append(i)
    out: list = [None] * len(h)
    values = [np.asarray(x) for x in numbers]
    for (high, wide), rows in sizes.items():
        step = max(1, STACK_SAMPLES // (high * wide * max(scales) ** 2))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            stacks = [np.stack([np.asarray(p[i].values, float) for i in part]).reshape(-1, high * s, wide * s) for p, s in zip(planes, scales, strict=True)]
            for i, got in zip(part, work(*stacks, *(v[part] for v in values)), strict=True):
                out[i] = got
    return out


def registered(ref: np.ndarray, mov: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dx, dy, confidence) of each frame against its reference: gradient fields matched on ever finer grids."""
    r, m = numeric.gradient_l1(ref), numeric.gradient_l1(mov)
    x = y = np.zeros(len(r))
    for steps in GRIDS:
        # On the last grid the middle comes last, so that it wins no tie.
        places = [(dy, dx) for dy in steps for dx in steps]
        if steps is GRIDS[-1]:
            places.sort(key=lambda p: p == (0.0, 0.0))
        costs = np.stack([((r - numeric.shift_each(m, x + dx, y + dy)) ** 2).sum((1, 2)) for dy, dx in places])
        order = costs.argsort(0, kind="stable")
        at = np.array(places)[order[0]]
        x, y = x + at[:, 1], y + at[:, 0]
    best, second = (np.take_along_axis(costs, order[k : k + 1], 0)[0] for k in (0, 1))
    sure = (second > 0) & (np.abs(x) <= SURE) & (np.abs(y) <= SURE)
    return -x, -y, np.where(sure, 1.0 - best / np.where(second > 0, second, 1.0), 0.0)


def estimate_shift(ref: np.ndarray, mov: np.ndarray) -> tuple[float, float, float]:
    """``registered`` for one pair of planes."""
    return tuple(float(v[0]) for v in registered(ref[None], mov[None]))


def _with_reference(frames: DataFrame, scale: int) -> DataFrame:
    """Frames with ``ref``, the samples of their burst's frame 0; bursts that break a rule fail."""
    one = frames.groupBy(*KEYS).agg(
        F.max(F.when(F.col("frame") == 0, F.col("v"))).alias("ref"),
        F.count("*").alias("n"),
        F.count_distinct("frame").alias("different"),
        *(f(k).alias(f"{name}_{k}") for k in ("w", "h") for name, f in (("least", F.min), ("most", F.max))),
    )
    rules = [
        (F.col("ref").isNull() | (F.col("different") < F.col("n")), "a burst has no frame 0, or a frame twice"),
        ((F.col("least_w") < F.col("most_w")) | (F.col("least_h") < F.col("most_h")) | (F.col("n") > BURST_FRAMES[1]), "frames of a burst differ in size or are too many"),
        (F.greatest("most_w", "most_h") > BURST_SIDE, f"a side of a burst is over {BURST_SIDE}"),
        (burst_bytes(F.col("most_w"), F.col("most_h"), scale, F.col("n")) > PEAK_MB * MB, "a burst is over the limits of admission"),
    ]
    ref = F.col("ref")
    for broken, what in reversed(rules):
        ref = F.when(broken, F.raise_error(F.lit(what)).cast("array<double>")).otherwise(ref)
    one = one.select(*(F.col(k).alias(f"_{k}") for k in KEYS), ref.alias("ref"))
    return frames.join(one, F.col("burst_id").eqNullSafe(F.col("_burst_id")) & F.col("c").eqNullSafe(F.col("_c"))).drop("_burst_id", "_c")


def _over() -> W:
    return W.partitionBy(*KEYS).orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def gated(frames: DataFrame, scale: int, confidence: float) -> DataFrame:
    """Frames (with ``ref``) and their dx, dy, confidence, kept and weight."""
    kind = "struct<dx: double, dy: double, confidence: double, apart: double, error: double, still: double, off: double>"

    @F.arrow_udf(kind)
    def facts(frame: pa.Array, h: pa.Array, w: pa.Array, v: pa.Array, ref: pa.Array) -> pa.Array:
        def work(mov: np.ndarray, base: np.ndarray) -> list[tuple[float, ...]]:
            dx, dy, sure = registered(base, mov)
            up = numeric.upsample(base, scale, Kernel.LANCZOS3)
            mean = lambda x: x.mean((1, 2))
            moved = numeric.box_mean(numeric.shift_each(up, dx * scale, dy * scale), scale)
            off = np.sqrt(mean((numeric.shift_each(base, dx, dy) - mov) ** 2))
            return list(zip(dx, dy, sure, mean(np.abs(mov - base)), mean((moved - mov) ** 2), mean((numeric.box_mean(up, scale) - mov) ** 2), off, strict=True))

        names = ("dx", "dy", "confidence", "apart", "error", "still", "off")
        first = (0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)
        got = stacked(h, w, [v, ref], [], work, (1, 1))
        rows = [first if f == 0 else g for f, g in zip(frame.to_pylist(), got, strict=True)]
        return pa.array([dict(zip(names, map(float, r), strict=True)) for r in rows], pa.struct([(n, pa.float64()) for n in names]))

    f = lambda name: F.col(f"f.{name}")
    over, later = _over(), F.col("frame") > 0
    rows = frames.withColumn("f", facts("frame", "h", "w", "v", "ref"))
    sure = ~later | (f("confidence") >= confidence)
    aliased = (F.max(F.when(sure, F.abs(f("dx")) + F.abs(f("dy")))).over(over) < ALIAS_SHIFT) & (F.avg(F.when(later, f("apart"))).over(over) > ALIAS_LEVELS)
    foretold = F.sum(F.when(sure & later, f("error"))).over(over) < F.sum(F.when(sure & later, f("still"))).over(over)
    rows = rows.withColumn("kept", ~later | (sure & F.coalesce(foretold & ~F.coalesce(aliased, F.lit(False)), F.lit(False))))
    others = F.array_sort(F.collect_list(F.when(F.col("kept") & later, f("off"))).over(over))  # at most 7 numbers
    rows = rows.withColumn("_middle", F.greatest(F.get(others, F.call_function("div", F.size(others), F.lit(2)).cast("int")), F.lit(LEAST_MIDDLE)))
    ratio = f("off") / F.col("_middle")
    raw = F.when(~later, 1.0).when(F.col("kept"), F.least(F.lit(1.0), F.greatest(F.lit(LEAST_WEIGHT), f("confidence"))) * F.exp(-0.5 * ratio * ratio))
    rows = rows.withColumn("_raw", raw)
    return rows.withColumn("weight", F.col("_raw") / F.sum("_raw").over(over)).withColumns({n: f(n) for n in ("dx", "dy", "confidence")}).drop("f", "_raw", "_middle")


def known(frames: DataFrame, shifts: DataFrame) -> DataFrame:
    """Frames (with ``ref``) at given shifts (burst_id, frame, dx, dy): all are kept with one weight."""
    finite = lambda x: F.when(F.col(x).isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("shift is not finite")).cast("double")).otherwise(F.col(x).cast("double"))
    given = shifts.select(F.col("burst_id").alias("_b"), F.col("frame").alias("_f"), finite("dx").alias("_dx"), finite("dy").alias("_dy"))
    met = frames.join(given, F.col("burst_id").eqNullSafe(F.col("_b")) & (F.col("frame") == F.col("_f")), "left")
    first = F.col("frame") == 0
    # A given shift is looked at for frame 0 too, so that one that is not finite fails.
    of = lambda x: F.when(first, F.coalesce(F.col(x), F.lit(0.0)) * 0.0).when(F.col(x).isNull(), F.raise_error(F.lit("a frame has no shift")).cast("double")).otherwise(F.col(x))
    return met.withColumns({"dx": of("_dx"), "dy": of("_dy"), "confidence": F.lit(1.0), "kept": F.lit(True), "weight": 1.0 / F.count("*").over(W.partitionBy(*KEYS)).cast("double")}).drop("_b", "_f", "_dx", "_dy")


def fused(frames: DataFrame, scale: int, passes: int, shifts: DataFrame | None, confidence: float, floats: bool) -> DataFrame:
    """See ``upscale.fuse_burst``; ``frames`` are checked planes."""
    both = _with_reference(frames.select(*KEYS, F.col("frame").cast("int").alias("frame"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "v"), scale)
    rows = stored(gated(both, scale, confidence) if shifts is None else known(both, shifts))
    doubles = "array<double>"

    @F.arrow_udf(doubles)
    def start(h: pa.Array, w: pa.Array, ref: pa.Array) -> pa.Array:
        return pa.array(stacked(h, w, [ref], [], lambda p: list(numeric.upsample(p, scale, Kernel.LANCZOS3).reshape(len(p), -1)), (1,)), pa.list_(pa.float64()))

    @F.arrow_udf(doubles)
    def correction(h: pa.Array, w: pa.Array, v: pa.Array, x: pa.Array, dx: pa.Array, dy: pa.Array, weight: pa.Array) -> pa.Array:
        def work(frame: np.ndarray, now: np.ndarray, ax: np.ndarray, ay: np.ndarray, wt: np.ndarray) -> list[np.ndarray]:
            r = frame - numeric.box_mean(numeric.shift_each(now, ax * scale, ay * scale), scale)
            back = numeric.shift_each(numeric.upsample(r, scale, Kernel.BILINEAR), -ax * scale, -ay * scale)
            return list((back * wt[:, None, None]).reshape(len(frame), -1))

        return pa.array(stacked(h, w, [v, x], [dx, dy, weight], work, (1, scale)), pa.list_(pa.float64()))

    @F.arrow_udf(doubles)
    def corrected(h: pa.Array, w: pa.Array, ref: pa.Array, x: pa.Array, fix: pa.Array) -> pa.Array:
        def work(base: np.ndarray, now: np.ndarray, moved: np.ndarray) -> list[np.ndarray]:
            out = np.clip(now + moved, base.min((1, 2))[:, None, None], base.max((1, 2))[:, None, None])
            return list((out + numeric.blocks(base - numeric.box_mean(out, scale), scale)).reshape(len(base), -1))

        return pa.array(stacked(h, w, [ref, x, fix], [], work, (1, scale, scale)), pa.list_(pa.float64()))

    out_kind = f"struct<v: array<{'double' if floats else 'int'}>, residual: double>"

    @F.arrow_udf(out_kind)
    def finished(h: pa.Array, w: pa.Array, ref: pa.Array, x: pa.Array) -> pa.Array:
        def work(base: np.ndarray, now: np.ndarray) -> list[tuple[np.ndarray, float]]:
            q = now if floats else numeric.quantise(now, base, scale)
            return list(zip(q.reshape(len(base), -1), numeric.rms(base - numeric.box_mean(now, scale)).tolist(), strict=True))

        got = stacked(h, w, [ref, x], [], work, (1, scale))
        v = pa.array([g[0] for g in got], pa.list_(pa.float64() if floats else pa.int32()))
        return pa.StructArray.from_arrays([v, pa.array([g[1] for g in got], pa.float64())], names=["v", "residual"])

    used = rows.where("kept").select(*KEYS, "frame", "w", "h", "v", "dx", "dy", "weight")
    told = rows.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("frame", "dx", "dy", "confidence", "kept"))).alias("shifts"), F.max("w").alias("w"), F.max("h").alias("h"), F.max(F.when(F.col("frame") == 0, F.col("ref"))).alias("ref"))
    now = told.withColumn("x", start("h", "w", "ref"))
    add: Callable[[Column, Column], Column] = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    for _ in range(passes):
        e = now.select(*(F.col(k).alias(f"e_{k}") for k in KEYS), "shifts", "ref", "x")
        met = used.join(e, F.col("burst_id").eqNullSafe(F.col("e_burst_id")) & F.col("c").eqNullSafe(F.col("e_c")))
        parts = met.withColumn("part", correction("h", "w", "v", "x", "dx", "dy", "weight"))
        one = parts.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("frame", "part"))).alias("parts"), F.max("w").alias("w"), F.max("h").alias("h"), *(F.first(k).alias(k) for k in ("shifts", "ref", "x")))
        # Corrections are added in the order of frames; a burst has at most 8.
        fix = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.element_at("parts", 1)["part"], lambda a, p: add(a, p["part"]))
        now = one.withColumn("x", corrected("h", "w", "ref", "x", fix)).drop("parts")
    done = now.withColumn("o", finished("h", "w", "ref", "x"))
    return done.select(*KEYS, (F.col("w") * scale).cast("int").alias("w"), (F.col("h") * scale).cast("int").alias("h"), "o.v", "o.residual", "shifts")
