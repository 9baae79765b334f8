"""Tiles with halos, stitching, and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at, div, grid, lit

# Tile side, and limits of admission.
TILE, MB, PEAK_MB, LARGE_SIDE, PROGRESSIVE_SIDE, BURST_FRAMES, BURST_SIDE = 512, 1 << 20, 768, 512, 512, (2, 8), 1024
#: Source samples around a tile: the reach of four staged passes with deblocking, rounded up to the 8-sample grid.
HALO = 24


def working_bytes(w: Column, h: Column, scale: int) -> Column:
    """Peak bytes of one image: three double planes and two byte images of output size, two of source size."""
    source = w.cast("long") * h.cast("long")
    return source * (scale * scale * (3 * 8 + 2 * 4) + 2 * 4)


def burst_bytes(w: Column, h: Column, scale: int, frames: Column) -> Column:
    """Peak bytes of a burst: six double planes and one byte image of output size, and its frames."""
    source = w.cast("long") * h.cast("long")
    return source * (scale * scale * (6 * 8 + 4)) + frames.cast("long") * source * 8


def needs_tiling(w: Column, h: Column, scale: int) -> Column:
    """Whether an image is cut: a side over the limit or a large working set; never at scale 8."""
    return F.lit(scale != 8) & ((w > LARGE_SIDE) | (h > LARGE_SIDE) | (working_bytes(w, h, scale) > 256 * MB))


def admitted(w: Column, h: Column, scale: int) -> Column:
    """Whether one untiled image stays under the peak and the side limit of scale 8."""
    return (working_bytes(w, h, scale) <= PEAK_MB * MB) & (F.greatest(w, h) <= PROGRESSIVE_SIDE if scale == 8 else F.lit(True))


def burst_admitted(w: Column, h: Column, scale: int, frames: Column) -> Column:
    """2 to 8 frames, sides up to 1024, under the peak."""
    return frames.between(*BURST_FRAMES) & (F.greatest(w, h) <= BURST_SIDE) & (burst_bytes(w, h, scale, frames) <= PEAK_MB * MB)


def job_budget_ms(w: Column, h: Column, scale: int, frames: Column) -> Column:
    """Time that a job may take: 30 s and 12 ms for each 1000 output samples and twice the source samples of all frames."""
    source = (w.cast("long") * h.cast("long")).cast("double")
    return 30_000 + (source * (scale * scale) + 2 * source * frames) / 1000 * 12


def tile_ids(w: Column, h: Column, tile: int = TILE, halo: int = HALO) -> Column:
    """Array of structs: tile_id, the valid box vx0, vy0, vx1, vy1 and the padded box px0, py0, pw, ph."""
    across, down = div(w + (tile - 1), tile), div(h + (tile - 1), tile)

    def box(y: Column, x: Column) -> Column:
        vx0, vy0 = x * tile, y * tile
        vx1, vy1 = F.least(vx0 + tile, w), F.least(vy0 + tile, h)
        px0, py0 = F.greatest(vx0 - halo, F.lit(0)), F.greatest(vy0 - halo, F.lit(0))
        fields = {"tile_id": y * across + x, "vx0": vx0, "vy0": vy0, "vx1": vx1, "vy1": vy1, "px0": px0, "py0": py0, "pw": F.least(vx1 + halo, w) - px0, "ph": F.least(vy1 + halo, h) - py0}
        return F.struct(*(c.cast("int").alias(n) for n, c in fields.items()))

    return grid(across, down, box)


def split(planes: DataFrame, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """Planes cut in tiles: the columns of ``planes`` with w, h, v of the padded tile, ``t`` (its boxes) and full_w."""
    cut = planes.withColumn("t", F.explode(tile_ids(F.col("w"), F.col("h"), tile, halo))).withColumn("full_w", F.col("w"))
    part = grid(F.col("t.pw"), F.col("t.ph"), lambda y, x: at(F.col("v"), (y + F.col("t.py0")) * F.col("full_w") + x + F.col("t.px0")))
    return cut.withColumn("v", part).withColumn("w", F.col("t.pw")).withColumn("h", F.col("t.ph"))


def crop(v: Column, t: Column, scale: int) -> Column:
    """The valid box of a tile's output plane."""
    wide = t["pw"] * scale
    return grid((t["vx1"] - t["vx0"]) * scale, (t["vy1"] - t["vy0"]) * scale, lambda y, x: at(v, (y + (t["vy0"] - t["py0"]) * scale) * wide + x + (t["vx0"] - t["px0"]) * scale))


def stitch(tiles: DataFrame, scale: int, keep: tuple[str, ...] = ("image_id", "c")) -> DataFrame:
    """Pixels (keep, y, x, v) of whole images from output tiles ``v`` with boxes ``t``: narrow, tiles never overlap."""
    cut = tiles.select(*keep, "t", F.posexplode(crop(F.col("v"), F.col("t"), scale)).alias("_i", "v"))
    wide = (F.col("t.vx1") - F.col("t.vx0")) * lit(scale)
    return cut.select(*keep, (div(F.col("_i"), wide) + F.col("t.vy0") * scale).alias("y"), (F.col("_i") % wide + F.col("t.vx0") * scale).alias("x"), "v")
