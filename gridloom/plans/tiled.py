"""Enlargement of tile relations: no task sees more than a tile and its halo.

With a fixed number of passes one exchange brings halos that cover the reach
of all of them. With an adaptive number each round exchanges the one source
sample that a pass reads around, sums squared residuals per image exactly, and
goes on with the tiles of images that have not stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import srgb_to_linear
from ..functions.kernels import Kernel
from ..operators import mosaic
from ..operators.mosaic import KEYS
from ..operators.quantize import AMPLITUDE, BYTE, Dither
from ..operators.tiling import HALO, TILE
from . import numeric
from .rounds import small_batches, stored

AUTO = (2, 8, 1e-6)
#: Source samples around a tile that its start and its descriptors read.
START_HALO = 4


def enlarged_tiles(tiles: DataFrame, scale: int, tile: int = TILE, halo: int = HALO, **options) -> DataFrame:
    """Output tiles (image_id, c, ty, tx, w, h, v, residual) of input tiles: w and h stay the source's, v is ``scale`` times as dense.

    Options are those of ``upscale``. Ranges and artifact statistics are merged
    over all tiles of an image, so that the output is the whole image's,
    sample by sample; ``residual`` is that of the tile with its halo. An image
    that is constant stays so. ``iters`` auto goes to ``adaptive``.
    """
    from .upscale import upscale

    if options.get("iters", "fixed") == "auto":
        plain = {k: v for k, v in options.items() if k in ("floats", "dither", "amplitude", "peak")}
        if len(plain) + 1 < len(options):
            raise ValueError("adaptive tiles take floats, dither, amplitude and peak alone")
        return adaptive(tiles, scale, tile, **plain).drop("iters")
    out = upscale(ready(tiles, tile, halo, options.get("working_space") == "linear"), scale, **options).select("image_id.*", "v", "residual")
    return out.select("image_id", "c", F.call_function("div", F.col("t.vy0"), F.lit(tile)).cast("int").alias("ty"), F.call_function("div", F.col("t.vx0"), F.lit(tile)).cast("int").alias("tx"), "size.w", "size.h", cropped(out, scale).alias("v"), "residual")


def ready(tiles: DataFrame, tile: int, halo: int, linear: bool) -> DataFrame:
    """Padded tiles with their image's range and artifact statistics, as ``upscale`` takes them; image_id has the image, its size and the tile's boxes."""
    if halo % 8 or tile % 8:
        raise ValueError("tile and halo keep the 8-sample grid")
    light = tiles.withColumn("v", F.transform("v", lambda a: srgb_to_linear(a / 255.0) * 255.0)) if linear else tiles
    stats = mosaic.merged_stats(light, tile)
    if linear:  # ranges are given in bytes
        stats = stats.drop("lo", "hi").join(tiles.groupBy("image_id", "c").agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi")), ["image_id", "c"])
    joined = mosaic.padded(tiles, tile, halo).join(stats, ["image_id", "c"])
    moved = [F.pmod(F.col(f"stats.phase_{a}") - F.col(f"t.p{a}0"), F.lit(8)).cast("int").alias(f"phase_{a}") for a in ("x", "y")]
    return joined.select(F.struct("image_id", "c", "size", "t").alias("image_id"), F.lit(0).alias("c"), "w", "h", "v", F.struct(F.col("stats.strength").alias("strength"), *moved).alias("stats"), "lo", "hi")


def boxed(tiles: DataFrame, tile: int, scale: int) -> DataFrame:
    """Output tiles without halos in the form of ``upscale.upscaled_tiles``: image_id, c, size, t, v, residual."""
    y, x = F.col("ty") * tile, F.col("tx") * tile
    wide, high = mosaic.side_in(F.col("w"), F.col("tx"), tile), mosaic.side_in(F.col("h"), F.col("ty"), tile)
    across = F.call_function("div", F.col("w") + (tile - 1), F.lit(tile))
    box = {"tile_id": F.col("ty") * across + F.col("tx"), "vx0": x, "vy0": y, "vx1": x + wide, "vy1": y + high, "px0": x, "py0": y, "pw": wide, "ph": high}
    return tiles.select("image_id", "c", F.struct("w", "h").alias("size"), F.struct(*(c.cast("int").alias(n) for n, c in box.items())).alias("t"), "v", "residual")


def cropped(out: DataFrame, scale: int):
    """The valid box of padded output tiles with boxes t, line by line."""
    t, wide = F.col("t"), F.col("t.pw") * scale
    first = (t["vx0"] - t["px0"]) * scale + 1
    lines = F.sequence((t["vy0"] - t["py0"]) * scale, (t["vy1"] - t["py0"]) * scale - 1)
    return F.flatten(F.transform(lines, lambda y: F.slice(out["v"], y * wide + first, (t["vx1"] - t["vx0"]) * scale)))


def _sums(parts: list[list[int]]) -> pa.Array:
    return pa.array(parts, pa.list_(pa.int64()))


def _residuals(state: DataFrame) -> DataFrame:
    """(image_id, c, now): the root mean square of whole images from the limbs of their tiles."""

    @F.arrow_udf("double")
    def root(count: pa.Array, *parts: pa.Array) -> pa.Array:
        return pa.array([numeric.root_mean(p, n) for n, *p in zip(count.to_pylist(), *(x.to_pylist() for x in parts), strict=True)], pa.float64())

    names = [f"l{k}" for k in range(numeric.LIMBS)]
    sums = state.groupBy("image_id", "c").agg(F.max(F.col("w").cast("long") * F.col("h")).alias("n"), *(F.sum(F.get("limbs", F.lit(k))).alias(x) for k, x in enumerate(names)))
    return sums.select("image_id", "c", root("n", *names).alias("now"))


def adaptive(tiles: DataFrame, scale: int, tile: int = TILE, policy: tuple[int, int, float] = AUTO, floats: bool = False, dither: Dither | int = Dither.NONE, amplitude: float = AMPLITUDE, peak: int = BYTE) -> DataFrame:
    """Output tiles (image_id, c, ty, tx, w, h, v, residual, iters): each image stops where the whole image would.

    ``policy`` is the least and the most passes and the relative gain that is
    too small. As with ``upscale(iters="auto")`` there is no deblocking and no
    short way for constant planes. Each round is a table in the shared folder;
    what reaches the driver is whether any image goes on.
    """
    if scale not in (2, 3):
        raise ValueError("iters auto takes scale 2 or 3")
    if tile < START_HALO or tile * scale % 8:
        raise ValueError("tiles are smaller than what a start reads around them, or off the grid of the dither table")
    small_batches(tiles.sparkSession)
    kinds = mosaic._kinds(tiles, ["image_id", "c"])
    ranges = tiles.groupBy("image_id", "c").agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"))
    schema = f"{kinds}, ty int, tx int, w int, h int, around array<double>, lo double, hi double, v array<double>, limbs array<long>"

    def pads(tx: int, ty: int, w: int, h: int, reach: int) -> tuple[int, int, int, int]:
        """Lines above, samples left, and size of a tile with its halo."""
        y, x = ty * tile, tx * tile
        top, left = min(reach, y), min(reach, x)
        return top, left, min(y + tile + reach, h) - y + top, min(x + tile + reach, w) - x + left

    def out(b: pa.RecordBatch, around: list, x: list, sums: list) -> pa.RecordBatch:
        doubles = pa.list_(pa.float64())
        kept = {k: b[k] for k in (*KEYS, "w", "h")}
        return pa.RecordBatch.from_pydict(kept | {"around": pa.array(around, doubles), "lo": b["lo"], "hi": b["hi"], "v": pa.array(x, doubles), "limbs": _sums(sums)})

    def inner(p: np.ndarray, top: int, left: int, high: int, wide: int) -> np.ndarray:
        return p[top : top + high, left : left + wide]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            around, x, sums = [], [], []
            for i, (ty, tx, w, h) in enumerate(zip(*(b[k].to_pylist() for k in ("ty", "tx", "w", "h")), strict=True)):
                p, top, left = mosaic.assembled(b["pieces"][i])
                high, wide = min(tile, h - ty * tile), min(tile, w - tx * tile)
                first = inner(numeric.upsample(p[None], scale, Kernel.LANCZOS3)[0], top * scale, left * scale, high * scale, wide * scale)
                around.append(p.reshape(-1))
                x.append(np.ascontiguousarray(first).reshape(-1))
                sums.append(numeric.limbs(numeric.square_sum(inner(p, top, left, high, wide) - numeric.box_mean(first[None], scale)[0])))
            yield out(b, around, x, sums)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, sums = [], []
            for i, (ty, tx, w, h) in enumerate(zip(*(b[k].to_pylist() for k in ("ty", "tx", "w", "h")), strict=True)):
                top, left, high, wide = pads(tx, ty, w, h, START_HALO)
                y = np.asarray(b["around"][i].values).reshape(1, high, wide)
                before, near, side = mosaic.assembled(b["pieces"][i])
                near, side = near // scale, side // scale
                near_high, near_wide = before.shape[0] // scale, before.shape[1] // scale
                box = (slice(None), slice((top - near) * scale, (top - near + near_high) * scale), slice((left - side) * scale, (left - side + near_wide) * scale))
                d = numeric.descriptors(y)
                maps = [numeric.lift(d[k], scale)[box] for k in ("edge", "lo", "hi")]
                part = y[:, top - near : top - near + near_high, left - side : left - side + near_wide]
                lo, hi = (np.array([b[k][i].as_py()]) for k in ("lo", "hi"))
                after = numeric.one_pass(part, before[None], scale, *maps, lo, hi)[0]
                own_high, own_wide = min(tile, h - ty * tile), min(tile, w - tx * tile)
                after = inner(after, near * scale, side * scale, own_high * scale, own_wide * scale)
                x.append(np.ascontiguousarray(after).reshape(-1))
                sums.append(numeric.limbs(numeric.square_sum(inner(y[0], top, left, own_high, own_wide) - numeric.box_mean(after[None], scale)[0])))
            yield out(b, [v.values for v in b["around"]], x, sums)

    first = mosaic.exchanged(tiles, tile, START_HALO).join(ranges, ["image_id", "c"])
    live = stored(first.mapInArrow(start, schema))
    before = _residuals(live).withColumnRenamed("now", "before")
    done: DataFrame | None = None
    carry = ("around", "lo", "hi")
    for t in range(1, policy[1] + 1):
        state = stored(mosaic.exchanged(live, tile, 1, scale, carry).mapInArrow(once, schema))
        told = _residuals(state).join(before, ["image_id", "c"])
        gain = (F.col("before") - F.col("now")) / F.greatest("before", F.lit(1e-15))
        over = F.lit(t == policy[1]) | (F.lit(t >= policy[0]) & (F.col("now") <= F.col("before")) & (gain <= policy[2]))
        told = stored(told.withColumn("over", over))
        ended = state.join(told.where("over").select("image_id", "c", F.col("now").alias("residual"), F.lit(t).alias("iters")), ["image_id", "c"])
        done = ended if done is None else done.unionByName(ended)
        if not told.where("not over").limit(1).count():
            break
        live = state.join(told.where("not over").select("image_id", "c"), ["image_id", "c"], "left_semi")
        before = told.select("image_id", "c", F.col("now").alias("before"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = []
            for i, (ty, tx, w, h) in enumerate(zip(*(b[k].to_pylist() for k in ("ty", "tx", "w", "h")), strict=True)):
                top, left, high, wide = pads(tx, ty, w, h, START_HALO)
                own_high, own_wide = min(tile, h - ty * tile), min(tile, w - tx * tile)
                y = inner(np.asarray(b["around"][i].values).reshape(high, wide), top, left, own_high, own_wide)
                x = np.asarray(b["v"][i].values).reshape(1, own_high * scale, own_wide * scale)
                v.append((x if floats else numeric.quantise(x, y[None], scale, dither, amplitude, peak))[0].reshape(-1))
            kind = pa.float64() if floats else pa.int32()
            yield pa.RecordBatch.from_pydict({k: b[k] for k in (*KEYS, "w", "h")} | {"v": pa.array(v, pa.list_(kind)), "residual": b["residual"], "iters": b["iters"]})

    dither = int(Dither(dither))
    return done.mapInArrow(finish, f"{kinds}, ty int, tx int, w int, h int, v array<{'double' if floats else 'int'}>, residual double, iters int")
