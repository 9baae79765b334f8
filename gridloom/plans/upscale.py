"""Enlargement and burst fusion of plane relations.

A plane is a row (image_id, c, w, h, v): a channel's samples row by row. A
batch of planes goes through Arrow to NumPy in stacks of equal size, without
a shuffle; bursts are relations of frames, see ``bursts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Kernel
from ..operators import mosaic
from ..operators.quantize import AMPLITUDE, BYTE, Dither
from ..operators.regularize import Deblock
from ..operators.tiling import HALO, TILE, admitted, needs_tiling, stitch
from . import bursts, numeric
from .rounds import small_batches
from .stacks import STACK_SAMPLES

PASSES, AUTO, DEBLOCK, BURST_CONFIDENCE = 4, (2, 8, 1e-6), Deblock(), 0.05
_OUT = "w int, h int, v array<int>, residual double, iters int"


def _valid(scale: int, allowed: tuple[int, ...], passes: int) -> None:
    if scale not in allowed:
        raise ValueError(f"scale {scale} is not one of {allowed}")
    if passes < 0:
        raise ValueError("passes below 0")


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _checked(planes: DataFrame) -> DataFrame:
    bad = (F.col("w") < 1) | (F.col("h") < 1) | (F.size("v") != F.col("w") * F.col("h")) | F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return planes.withColumn("v", F.when(bad | F.col("v").isNull(), F.raise_error(F.lit("plane has no samples, the wrong number, or one that is null or not finite"))).otherwise(F.col("v").cast("array<double>")))


def _lists(stack: np.ndarray) -> list[np.ndarray]:
    return list(stack.reshape(len(stack), -1))


def _srgb(v: np.ndarray, back: bool) -> np.ndarray:
    if back:
        return np.where(v <= 0, 0.0, np.where(v >= 1, 1.0, np.where(v <= 0.0031308, 12.92 * v, 1.055 * np.maximum(v, 1e-12) ** (1 / 2.4) - 0.055)))
    return np.where(v <= 0, 0.0, np.where(v <= 0.04045, v / 12.92, ((np.maximum(v, 0) + 0.055) / 1.055) ** 2.4))


def sliced(whole: pa.RecordBatch, scale: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most 256 planes of a batch, of no more than ``STACK_SAMPLES`` output samples unless one plane has more."""
    start = held = 0
    for i, (w, h) in enumerate(zip(whole["w"].to_pylist(), whole["h"].to_pylist(), strict=True)):
        n = w * h * scale * scale
        if i > start and (i - start == 256 or held + n > STACK_SAMPLES):
            yield whole.slice(start, i - start)
            start, held = i, 0
        held += n
    if whole.num_rows:
        yield whole.slice(start)


def _worker(keep: list[str], scale: int, passes: int, mode: str, dither: Dither, amplitude: float, iters: str, working_space: str, deblocking: Deblock | None, floats: bool, grain: int | None, peak: int = BYTE) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``upscale`` does with batches of planes, which have columns ``keep``, w, h, v, _lo, _hi and stats."""

    def stack(rows: list[int], b: pa.RecordBatch, w: int, h: int):
        src = np.stack([np.asarray(b["v"][i].values) for i in rows]).reshape(-1, h, w)
        y = _srgb(src / 255.0, False) * 255.0 if working_space == "linear" else src
        own = b["_lo"][rows[0]].as_py() is None
        lo = y.min((1, 2)) if own else np.array([b["_lo"][i].as_py() for i in rows])
        hi = y.max((1, 2)) if own else np.array([b["_hi"][i].as_py() for i in rows])
        if working_space == "linear" and not own:  # ranges are given in bytes
            lo, hi = (_srgb(np.asarray(r) / 255.0, False) * 255.0 for r in (lo, hi))
        given = [b["stats"][i].as_py() for i in rows]
        stats = [g or numeric.artifact_stats(p) for g, p in zip(given, y, strict=True)] if deblocking and iters == "fixed" else None
        if iters == "auto":
            x, history, used = numeric.reconstruct(y, scale, passes, lo, hi, auto=AUTO)
            worst = history[-1]
        elif scale in (4, 8) or mode == "progressive":
            x, ends = numeric.progressive(y, scale, passes, lo, hi, deblocking, stats)
            worst, used = np.max(ends, 0), np.full(len(y), passes * len(ends))
        else:
            x, history, used = numeric.reconstruct(y, scale, passes, lo, hi, None, deblocking, stats)
            worst, used = history[-1], np.full(len(y), passes)
        if working_space == "linear":
            x = _srgb(x / 255.0, True) * 255.0
        if grain is not None:
            x = np.floor(x * 2.0**grain + 0.5) / 2.0**grain
        return src, x, worst, used

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, scale):
                sizes: dict[tuple[int, int, bool], list[int]] = {}
                for i, (w, h) in enumerate(zip(b["w"].to_pylist(), b["h"].to_pylist(), strict=True)):
                    sizes.setdefault((w, h), []).append(i)
                done: list = [None] * b.num_rows
                for (w, h), rows in sizes.items():
                    flat = [i for i in rows if iters == "fixed" and working_space == "gamma" and np.ptp(np.asarray(b["v"][i].values)) == 0]
                    for i in flat:  # a constant plane stays what it is
                        p = np.asarray(b["v"][i].values).reshape(1, h, w)
                        x = numeric.blocks(p, scale)
                        done[i] = ((x if floats else numeric.quantise(x, p, scale, dither, amplitude, peak))[0].reshape(-1), 0.0, 0)
                    rest = [i for i in rows if done[i] is None]
                    step = max(1, STACK_SAMPLES // max(1, w * h * scale * scale))
                    for k in range(0, len(rest), step):
                        part = rest[k : k + step]
                        src, x, worst, used = stack(part, b, w, h)
                        out = x if floats else numeric.quantise(x, src, scale, dither, amplitude, peak)
                        for i, v, r, n in zip(part, _lists(out), worst, used, strict=True):
                            done[i] = (v, float(r), int(n))
                cols = [b[c] for c in keep]
                for_out = [pa.array([w * scale for w in b["w"].to_pylist()], pa.int32()), pa.array([h * scale for h in b["h"].to_pylist()], pa.int32()), pa.array([d[0] for d in done], pa.list_(pa.float64() if floats else pa.int32())), pa.array([d[1] for d in done], pa.float64()), pa.array([d[2] for d in done], pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *for_out], names=[*keep, "w", "h", "v", "residual", "iters"])

    return run


def upscale(planes: DataFrame, scale: int, passes: int = PASSES, mode: str = "direct", clamp: DataFrame | None = None, dither: Dither | int = Dither.NONE, amplitude: float = AMPLITUDE, iters: str = "fixed", working_space: str = "gamma", deblocking: Deblock | None = DEBLOCK, floats: bool = False, grain: int | None = None, limits: bool = True, peak: int = BYTE) -> DataFrame:
    """Planes ``scale`` times as large in bytes whose block sums are exact, with residual and passes used.

    ``mode`` is direct (2, 3, 4; 4 in stages) or progressive (2, 4, 8);
    ``clamp`` (one row for each plane), or columns lo and hi, have a range in place of each plane's own;
    ``iters`` auto stops early, without deblocking or the short way of
    constant planes; ``working_space`` linear works on light, with ranges given
    in bytes and statistics, if given, of the light. ``floats``
    returns the float planes before bytes; with ``grain`` those are rounded to
    so many bits behind the point first, so that samples that are equal but
    for rounding are equal, and other engines make the same bytes. ``peak`` is the largest
    sample of planes that are no bytes, as counts are. Empty relations give empty ones;
    planes with null or non-finite samples fail.
    """
    _valid(scale, (2, 4, 8) if mode == "progressive" else (2, 3, 4), passes)
    dither = Dither(dither)
    if mode not in ("direct", "progressive") or iters not in ("fixed", "auto") or working_space not in ("gamma", "linear"):
        raise ValueError("unknown mode, iters or working_space")
    if iters == "auto" and scale not in (2, 3):
        raise ValueError("iters auto takes scale 2 or 3")
    small_batches(planes.sparkSession)
    df = _checked(planes)
    if limits:
        df = df.withColumn("w", F.when(admitted(F.col("w"), F.col("h"), scale), F.col("w")).otherwise(F.raise_error(F.lit("plane is over the limits of admission")).cast("int")))
    if clamp is not None:
        bad = F.col("lo").isNull() | F.col("hi").isNull() | F.isnan("lo") | F.isnan("hi") | (F.col("lo") > F.col("hi")) | (F.abs("lo") == float("inf")) | (F.abs("hi") == float("inf"))
        given = clamp.groupBy("image_id", "c").agg(F.count("*").alias("_given"), F.first(F.col("lo").cast("double")).alias("lo"), F.first(F.col("hi").cast("double")).alias("hi"))
        given = given.select("image_id", "c", "_given", F.when(bad, F.raise_error(F.lit("clamp range is not finite and ascending")).cast("double")).otherwise(F.col("lo")).alias("_lo"), F.col("hi").alias("_hi"))
        alone = F.when(F.col("_given").isNull(), F.raise_error(F.lit("plane has no clamp range")).cast("double")).when(F.col("_given") > 1, F.raise_error(F.lit("plane has several clamp ranges")).cast("double")).otherwise(F.col("_lo"))
        df = df.join(given, ["image_id", "c"], "left").withColumn("_lo", alone).drop("_given")
    elif {"lo", "hi"} <= set(df.columns):
        df = df.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    else:
        df = df.withColumns({"_lo": F.lit(None).cast("double"), "_hi": F.lit(None).cast("double")})
    if "stats" not in df.columns:
        df = df.withColumn("stats", F.lit(None).cast("struct<strength double, phase_x int, phase_y int>"))
    keep = [c for c in df.columns if c not in ("w", "h", "v", "_lo", "_hi", "stats")]
    kind = "double" if floats else "int"
    schema = f"{_fields(df, keep)}, {_OUT.replace('array<int>', f'array<{kind}>')}"

    run = _worker(keep, scale, passes, mode, dither, amplitude, iters, working_space, deblocking, floats, grain, peak)
    return df.select(*keep, "w", "h", "v", "_lo", "_hi", "stats").mapInArrow(run, schema)


def upscaled_tiles(planes: DataFrame, scale: int, tile: int = TILE, halo: int = HALO, **options) -> DataFrame:
    """Output tiles (image_id, c, size, t, v, residual) with their halos: size has the source's w and h, t the boxes of ``split``.

    Planes are cut into a tile relation at once; see ``tiled.enlarged_tiles``.
    With ``iters`` auto each image stops where the whole image would, and
    tiles have no halos; ``residual`` is the image's then.
    """
    from . import tiled

    tiles = mosaic.cut(_checked(planes).select("image_id", "c", "w", "h", "v"), tile)
    if options.get("iters", "fixed") == "auto":
        return tiled.boxed(tiled.enlarged_tiles(tiles, scale, tile, **options), tile, scale)
    return upscale(tiled.ready(tiles, tile, halo, options.get("working_space") == "linear"), scale, **options).select("image_id.*", "v", "residual")


def worst_residual(tiles: DataFrame) -> DataFrame:
    """(image_id, c, residual): the largest residual of each plane's tiles, halos included."""
    return tiles.groupBy("image_id", "c").agg(F.max("residual").alias("residual"))


def dispatched(planes: DataFrame, scale: int, tile: int = TILE, halo: int = HALO, **options) -> tuple[DataFrame, DataFrame]:
    """Planes that need no tiling enlarged whole, and the output tiles of the others; a plane over the limits of admission fails."""
    large = needs_tiling(F.col("w"), F.col("h"), scale)
    mode = options.pop("mode", "progressive" if scale == 8 else "direct")
    tiles = upscaled_tiles(planes.where(large), min(scale, 4), tile, halo, **options)  # at scale 8 no plane is large
    return upscale(planes.where(~large), scale, mode=mode, **options), tiles


def enlarged(planes: DataFrame, scale: int, tile: int = TILE, halo: int = HALO, **options) -> DataFrame:
    """Output tiles as ``upscaled_tiles`` gives them: planes that need tiling are cut, others are one tile each; see ``dispatched``."""
    zero = F.lit(0)
    whole, tiles = dispatched(planes.select("image_id", "c", "w", "h", "v"), scale, tile, halo, **options)
    w, h = (F.call_function("div", F.col(k), F.lit(scale)).cast("int") for k in ("w", "h"))
    box = F.struct(*(c.cast("int").alias(n) for n, c in {"tile_id": zero, "vx0": zero, "vy0": zero, "vx1": w, "vy1": h, "px0": zero, "py0": zero, "pw": w, "ph": h}.items()))
    small = whole.select("image_id", "c", F.struct(w.alias("w"), h.alias("h")).alias("size"), box.alias("t"), "v", "residual")
    return small if scale == 8 else small.unionByName(tiles)


def upscale_tiled(planes: DataFrame, scale: int, tile: int = TILE, halo: int = HALO, **options) -> DataFrame:
    """Pixels (image_id, c, y, x, v) of images enlarged tile by tile, the same as whole images give; see ``upscaled_tiles``."""
    return stitch(upscaled_tiles(planes, scale, tile, halo, **options), scale)


def fuse_burst(frames: DataFrame, scale: int, passes: int = PASSES, shifts: DataFrame | None = None, confidence: float = BURST_CONFIDENCE, floats: bool = False) -> DataFrame:
    """(burst_id, c, w, h, v, residual, shifts): frames (burst_id, frame, c, w, h, v) fused on frame 0 of each channel.

    ``shifts`` (burst_id, frame, dx, dy) replaces registration and its gates.
    A burst has one size, sides up to 1024, its frame 0 and at most 8 frames; one
    alone is enlarged as a single image is by the same loop. ``floats`` returns
    float planes before bytes.
    """
    _valid(scale, (2, 4), passes)
    small_batches(frames.sparkSession)
    return bursts.fused(_checked(frames), scale, passes, shifts, confidence, floats)
