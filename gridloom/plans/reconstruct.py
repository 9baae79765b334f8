"""The reconstruction loop as column expressions: every step a narrow projection of the plane's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import Index, let, lit
from ..functions.kernels import Kernel
from ..operators.forward import project, residual, rms
from ..operators.regularize import Deblock, deblock, maps, step
from ..operators.resample import upsample


def back_projection_pass(x: Column, y: Column, w: Index, h: Index, scale: int, m: Column, lo: Column, hi: Column, stats: Column | None = None, deblocking: Deblock | None = None) -> Column:
    """x plus the lifted residual, less the edge term, deblocked, held in [lo, hi], block means put right."""
    wide, high = lit(w) * scale, lit(h) * scale

    def held(moved: Column) -> Column:
        out = F.zip_with(moved, step(moved, m, wide, high), lambda a, b: a - b)
        if deblocking is not None and stats is not None:
            out = F.zip_with(out, deblock(moved, wide, high, scale, stats, deblocking), lambda a, b: a + b)
        return F.transform(out, lambda s: F.least(hi, F.greatest(lo, s)))

    def moved(u: Column) -> Column:
        return F.zip_with(u, upsample(residual(u, y, w, h, scale), w, h, scale, Kernel.BILINEAR), lambda a, b: a + b)

    return let(x, lambda u: project(let(moved(u), held), y, w, h, scale))


def reconstruct(planes: DataFrame, scale: int, passes: int = 4, deblocking: Deblock | None = None) -> DataFrame:
    """``planes`` with ``x`` (the float plane) and ``residuals`` before the first and after each pass."""
    w, h = F.col("w"), F.col("h")
    df = planes.withColumn("_m", maps(F.col("v"), w, h, scale)).withColumn("x", upsample(F.col("v"), w, h, scale, Kernel.LANCZOS3))
    df = df.withColumn("residuals", F.array(rms(residual(F.col("x"), F.col("v"), w, h, scale))))
    lo, hi = F.array_min("v"), F.array_max("v")
    stats = F.col("stats") if deblocking is not None else None
    for _ in range(passes):
        df = df.withColumn("x", back_projection_pass(F.col("x"), F.col("v"), w, h, scale, F.col("_m"), lo, hi, stats, deblocking))
        df = df.withColumn("residuals", F.concat("residuals", F.array(rms(residual(F.col("x"), F.col("v"), w, h, scale)))))
    return df.drop("_m")


__all__ = ["back_projection_pass", "reconstruct"]
