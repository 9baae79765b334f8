"""Enlargement of images as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.upscale import upscale


def arriving(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """A stream of plane rows from Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def enlarged(stream: DataFrame, scale: int, **options) -> DataFrame:
    """The stream's planes enlarged: no state, so that any trigger and output in append mode will do."""
    return upscale(stream, scale, **options)
