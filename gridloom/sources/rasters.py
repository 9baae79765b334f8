"""Planes from tables and from formulas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import grid


#: Most rows of a partition of vectors on average, so that tasks do not grow with the input.
ROWS = 4096


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, and over partitions of ``ROWS`` rows on average, if it has fewer; others stay as they are read."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def from_embeddings(embeddings: DataFrame, side: int = 8) -> DataFrame:
    """Vectors of side * side components as byte planes: -1 to 1 becomes 0 to 255."""
    v = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("double"))
    return embeddings.where(F.size("embedding") == side * side).select(F.col("vec_id").alias("image_id"), F.lit(0).alias("c"), F.lit(side).alias("w"), F.lit(side).alias("h"), v.alias("v"))


def from_events(events: DataFrame) -> DataFrame:
    """Counts by hour (24, across) and day of the month less 1 (30, down) of each event type: one partial aggregate, one row a type."""
    cell = (F.least(F.dayofmonth("ts"), F.lit(30)) - 1) * 24 + F.hour("ts")
    counts = events.groupBy("event_type", cell.alias("cell")).count().groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("cell", "count"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(24 * 30 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return counts.select(F.col("event_type").alias("image_id"), F.lit(0).alias("c"), F.lit(24).alias("w"), F.lit(30).alias("h"), v.alias("v"))


# Generated planes: value of (y, x, w, h).
STEP: Callable = lambda y, x, w, h: F.when(x < w / 2, 0.0).otherwise(255.0)
RAMP: Callable = lambda y, x, w, h: F.least(x * 8.0, F.lit(255.0))
FLAT: Callable = lambda y, x, w, h: F.lit(128.0)
CHECKER: Callable = lambda y, x, w, h: F.when((x + y) % 2 == 0, 0.0).otherwise(255.0)
STRIPES: Callable = lambda y, x, w, h: F.when(F.shiftright(x, 2) % 2 == 1, 0.0).otherwise(255.0)
MODULAR: Callable = lambda y, x, w, h: ((7 * x + 13 * y) % 251).cast("double")
OFFSET_GRID: Callable = lambda y, x, w, h: 50.0 + 35.0 * F.floor((x + 13) / 8) + 45.0 * F.floor((y + 11) / 8) + 0.5 * (x + y)
SINE: Callable = lambda y, x, w, h: 128.0 + 60.0 * F.sin(2 * 3.141592653589793 * x / 9) + 40.0 * F.sin(2 * 3.141592653589793 * y / 13 + 1)
ZONE: Callable = lambda y, x, w, h: 128.0 + 100.0 * F.sin(3.141592653589793 * ((x - w / 2) * (x - w / 2) + (y - h / 2) * (y - h / 2)) / 32)

CHROMA_RED: Callable = lambda y, x, w, h: 128.0 + 60.0 * F.sin(2 * 3.141592653589793 * x / 9)
CHROMA_BLUE: Callable = lambda y, x, w, h: 128.0 + 60.0 * F.sin(2 * 3.141592653589793 * y / 7 + 1)
DIAGONAL: Callable = lambda y, x, w, h: 30.0 + 180.0 * (x + y) / (2.0 * (2 * w - 1))
#: The diagonal ramp with each 8 x 8 block pulled three quarters to its mean, as strong compression leaves it.
BLOCKY: Callable = lambda y, x, w, h: 0.25 * DIAGONAL(y, x, w, h) + 0.75 * DIAGONAL(F.floor(y / 8) * 8 + 3.5, F.floor(x / 8) * 8 + 3.5, w, h)


def patterned(images: DataFrame, w: int, h: int, value: Callable[[Column, Column, int, int], Column], dy: Column, dx: Column) -> DataFrame:
    """A plane of value(y + dy, x + dx, w, h) for each image_id of ``images``: patterns that each row moves by its own columns."""
    v = grid(w, h, lambda y, x: value(y + dy, x + dx, w, h).cast("double"))
    return images.select("image_id", F.lit(0).alias("c"), F.lit(w).alias("w"), F.lit(h).alias("h"), v.alias("v"))


def chroma(spark: SparkSession, w: int, h: int) -> DataFrame:
    """One image of three channels: sines across in red and down in blue, no green."""
    planes = [generated(spark, w, h, f).withColumn("c", F.lit(c)) for c, f in enumerate((CHROMA_RED, lambda y, x, w, h: F.lit(0.0), CHROMA_BLUE))]
    return planes[0].unionByName(planes[1]).unionByName(planes[2])


def generated(spark: SparkSession, w: int, h: int, value: Callable[[Column, Column, int, int], Column], count: int = 1) -> DataFrame:
    """``count`` planes of value(y, x, w, h), numbered from 0."""
    return spark.range(count).select(F.col("id").alias("image_id"), F.lit(0).alias("c"), F.lit(w).alias("w"), F.lit(h).alias("h"), grid(w, h, lambda y, x: value(y, x, w, h).cast("double")).alias("v"))
