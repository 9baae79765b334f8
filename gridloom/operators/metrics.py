"""Measures of planes and relations of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import Index, array_sum, at, div, lit
from .descriptors import PERIOD


def pixels(planes: DataFrame, v: str = "v", w: Column | None = None, keep: tuple[str, ...] = ("image_id", "c")) -> DataFrame:
    """(keep, y, x, v): one row for each sample of the plane column ``v``, ``w`` samples wide."""
    wide = w if w is not None else F.col("w")
    long = planes.select(*keep, wide.alias("_w"), F.posexplode(v).alias("_i", "v"))
    return long.select(*keep, div(F.col("_i"), F.col("_w")).alias("y"), (F.col("_i") % F.col("_w")).alias("x"), "v")


def planes(pixels: DataFrame, keep: tuple[str, ...] = ("image_id", "c")) -> DataFrame:
    """The inverse of ``pixels``: one shuffle, samples in row order. Nulls and non-finite samples fail."""
    v = F.when(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf")), F.raise_error(F.lit("sample is null or not finite"))).otherwise(F.col("v").cast("double"))
    rows = pixels.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("y", "x", v.alias("v")))).alias("s"), (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return rows.select(*keep, F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), F.transform("s", lambda s: s["v"]).alias("v"))


def mse(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))) / F.size(a)


def psnr(a: Column, b: Column, equal: float = 1e9) -> Column:
    """10 * log10(255 * 255 / mse); ``equal`` where nothing differs."""
    e = mse(a, b)
    return F.when(e == 0, F.lit(equal)).otherwise(10.0 * F.log10(65025.0 / F.when(e == 0, F.lit(1.0)).otherwise(e)))


def max_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p - q)))


def boundary_energy(v: Column, w: Index, h: Index, phase_x: Index = 0, phase_y: Index = 0) -> Column:
    """Squared steps across the interior lines of the 8-sample grid at a phase."""
    w, h = lit(w), lit(h)

    def steps(s: Column, i: Column) -> Column:
        y, x = div(i, w), i % w
        left = F.when((x > 0) & (F.pmod(x - lit(phase_x), F.lit(PERIOD)) == 0), F.pow(s - at(v, i - 1), F.lit(2.0))).otherwise(0.0)
        above = F.when((y > 0) & (F.pmod(y - lit(phase_y), F.lit(PERIOD)) == 0), F.pow(s - at(v, i - w), F.lit(2.0))).otherwise(0.0)
        return left + above

    return array_sum(F.transform(v, steps))


def block_audit(output: DataFrame, source: DataFrame, scale: int) -> DataFrame:
    """Blocks of ``output`` pixels whose sum is not scale * scale times the ``source`` pixel; none where sums are exact."""
    sums = output.groupBy("image_id", "c", div(F.col("y"), scale).alias("y"), div(F.col("x"), scale).alias("x")).agg(F.sum("v").alias("block_sum"))
    joined = sums.join(source.withColumnRenamed("v", "src"), ["image_id", "c", "y", "x"], "full")
    return joined.where(~F.col("block_sum").eqNullSafe(F.col("src") * (scale * scale)))


def alpha_used(v: Column) -> Column:
    """Whether any alpha sample is below 255."""
    return F.exists(v, lambda a: a < 255)


def regressions(measured: dict[str, float], baseline: dict[str, float], tolerance: float = 0.1) -> list[str]:
    """Names whose PSNR is more than ``tolerance`` below the baseline; names without one are skipped."""
    return sorted(k for k, v in measured.items() if k in baseline and v < baseline[k] - tolerance)


def regressed(measured: DataFrame, baseline: DataFrame, name: str = "image_id", tolerance: float = 0.1) -> DataFrame:
    """(name, psnr, before): rows of ``measured`` (name, psnr) more than ``tolerance`` below their row of ``baseline``; names without one are skipped."""
    before = baseline.select(F.col(name).alias("_name"), F.col("psnr").alias("before"))
    met = measured.join(before, F.col(name) == F.col("_name"))
    return met.where(F.col("psnr") < F.col("before") - tolerance).select(name, "psnr", "before")
