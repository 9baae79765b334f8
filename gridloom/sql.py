"""The engine in SQL text: ``register(spark)``, then

    SELECT * FROM gridloom_upscale(TABLE(SELECT CAST(image_id AS STRING) AS image_id, c, w, h, v FROM planes), 2)
    SELECT image_id, gridloom_psnr(a, b) FROM pairs

Table functions work on Arrow batches where the rows are; scalar ones are SQL
expressions that Catalyst inlines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .operators.quantize import AMPLITUDE, Dither
from .plans.upscale import DEBLOCK, PASSES, _valid, _worker
from .sources import datasource

_RESULT = "image_id string, c int, w int, h int, v array<{kind}>, residual double, iters int"


def _enlarged(batch: pa.RecordBatch, scale: pa.Array, floats: bool, **options) -> Iterator[pa.Table]:
    if not batch.num_rows:
        return
    s = scale[0].as_py()
    settings = {"mode": "progressive" if s == 8 else "direct", "passes": PASSES, "dither": Dither.NONE, "amplitude": AMPLITUDE, "iters": "fixed", "working_space": "gamma", "deblocking": DEBLOCK, "grain": None} | options
    _valid(s, (2, 3, 4, 8), settings["passes"])
    n, doubles = batch.num_rows, pa.list_(pa.float64())
    for v, w, h in zip(batch["v"], batch["w"].to_pylist(), batch["h"].to_pylist(), strict=True):
        x = v.values
        if x is None or len(x) != w * h or x.null_count or not all(map(_finite, (x.to_numpy().min(), x.to_numpy().max()))):
            raise ValueError("plane has no samples, the wrong number, or one that is null or not finite")
    none = {"_lo": pa.nulls(n, pa.float64()), "_hi": pa.nulls(n, pa.float64()), "stats": pa.nulls(n, pa.struct([("strength", pa.float64()), ("phase_x", pa.int32()), ("phase_y", pa.int32())]))}
    cut = {"image_id": batch["image_id"].cast(pa.string()), "c": batch["c"], "w": batch["w"], "h": batch["h"], "v": batch["v"].cast(doubles)}
    for out in _worker(["image_id", "c"], s, floats=floats, **settings)(iter([pa.RecordBatch.from_pydict(cut | none)])):
        yield pa.Table.from_batches([out])


def _finite(x: float) -> bool:
    return x - x == 0


@arrow_udtf(returnType=_RESULT.format(kind="int"))
class Upscale:
    """Bytes with exact block sums of a table of planes (image_id string, c, w, h, v)."""

    def eval(self, planes: pa.RecordBatch, scale: pa.Array) -> Iterator[pa.Table]:
        yield from _enlarged(planes, scale, False)


@arrow_udtf(returnType=_RESULT.format(kind="double"))
class UpscaleFloats:
    """The planes before bytes."""

    def eval(self, planes: pa.RecordBatch, scale: pa.Array) -> Iterator[pa.Table]:
        yield from _enlarged(planes, scale, True)


#: Scalar functions: parameters, result and body.
FUNCTIONS = {
    "gridloom_mse": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (p, q) -> (p - q) * (p - q)), 0D, (s, x) -> s + x) / size(a)"),
    "gridloom_psnr": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN gridloom_mse(a, b) = 0 THEN 1e9D ELSE 10 * log10(65025D / gridloom_mse(a, b)) END"),
    "gridloom_max_difference": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "array_max(zip_with(a, b, (p, q) -> abs(p - q)))"),
    "gridloom_to_linear": ("v DOUBLE", "DOUBLE", "CASE WHEN v <= 0 THEN 0D WHEN v <= 0.04045D THEN v / 12.92D ELSE pow((v + 0.055D) / 1.055D, 2.4D) END"),
    "gridloom_to_srgb": ("v DOUBLE", "DOUBLE", "CASE WHEN v <= 0 THEN 0D WHEN v >= 1 THEN 1D WHEN v <= 0.0031308D THEN 12.92D * v ELSE 1.055D * pow(v, 1 / 2.4D) - 0.055D END"),
    "gridloom_over_white": ("v DOUBLE, alpha DOUBLE", "DOUBLE", "v * alpha / 255 + 255 * (1 - alpha / 255)"),
    "gridloom_box_mean": ("v ARRAY<DOUBLE>, w INT, h INT, s INT", "ARRAY<DOUBLE>", "transform(sequence(0, (w div s) * (h div s) - 1), i -> aggregate(sequence(0, s * s - 1), 0D, (t, k) -> t + v[((i div (w div s)) * s + k div s) * w + (i % (w div s)) * s + k % s]) / (s * s))"),
}


def register(spark: SparkSession) -> None:
    """Makes table functions, scalar functions and image formats known to the session."""
    datasource.register(spark)
    spark.udtf.register("gridloom_upscale", Upscale)
    spark.udtf.register("gridloom_upscale_floats", UpscaleFloats)
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
