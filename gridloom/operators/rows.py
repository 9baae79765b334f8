"""Stencils on rows of tiles: across by array functions, down by lag and lead.

A row is (keys, y, row ARRAY<DOUBLE>): one line of a plane or of a padded tile.
All windows have one key and one order, so that any number of passes in a
chain takes one exchange and one sort. Border samples are held; where a pass
starts from padded tiles, each pass uses up one line of the halo.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import div, total


def rows_of(planes: DataFrame, keys: tuple[str, ...] = ("image_id", "c"), v: str = "v") -> DataFrame:
    """(keys, y, row) of planes or padded tiles with w and h: narrow."""
    lines = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.slice(v, y * F.col("w") + 1, F.col("w"))))
    return planes.select(*keys, lines.alias("y", "row"))


def _beside(row: Column) -> tuple[Column, Column]:
    """The row with each sample replaced by its left and its right neighbour."""
    n = F.size(row)
    return F.concat(F.slice(row, 1, 1), F.slice(row, F.lit(1), n - 1)), F.concat(F.slice(row, F.lit(2), n - 1), F.slice(row, n, F.lit(1)))


def _added(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def stencil(rows: DataFrame, keys: tuple[str, ...], of: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Rows replaced by of(row above, row, row below)."""
    down = W.partitionBy(*keys).orderBy("y")
    near = rows.withColumns({"_up": F.lag("row").over(down), "_low": F.lead("row").over(down)})
    return near.select(*keys, "y", of(F.coalesce("_up", "row"), F.col("row"), F.coalesce("_low", "row")).alias("row"))


def laplacian(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """4 x sample - left - right - above - below."""

    def of(up: Column, row: Column, low: Column) -> Column:
        left, right = _beside(row)
        return F.zip_with(F.transform(row, lambda x: 4.0 * x), _added([left, right, up, low]), lambda a, b: a - b)

    return stencil(rows, keys, of)


def mean(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The mean of 3 x 3 samples."""
    return stencil(rows, keys, lambda up, row, low: F.transform(_added([x for r in (up, row, low) for x in (_beside(r)[0], r, _beside(r)[1])]), lambda x: x / 9.0))


def extreme(rows: DataFrame, keys: tuple[str, ...], largest: bool) -> DataFrame:
    """The largest or the least of 3 x 3 samples."""
    pick = F.greatest if largest else F.least

    def of(up: Column, row: Column, low: Column) -> Column:
        column = F.zip_with(F.zip_with(up, row, lambda a, b: pick(a, b)), low, lambda a, b: pick(a, b))
        left, right = _beside(column)
        return F.zip_with(F.zip_with(left, column, lambda a, b: pick(a, b)), right, lambda a, b: pick(a, b))

    return stencil(rows, keys, of)


def gradient_l1(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """|right - left| + |below - above|."""

    def of(up: Column, row: Column, low: Column) -> Column:
        left, right = _beside(row)
        across, along = F.zip_with(right, left, lambda a, b: F.abs(a - b)), F.zip_with(low, up, lambda a, b: F.abs(a - b))
        return F.zip_with(across, along, lambda a, b: a + b)

    return stencil(rows, keys, of)


def shrunk(rows: DataFrame, keys: tuple[str, ...], scale: int) -> DataFrame:
    """Box means of scale x scale samples: sums across in each row, and down over the rows of a block."""
    n = div(F.size("row"), scale)
    across = F.transform(F.sequence(F.lit(0), n - 1), lambda x: total([F.get("row", x * scale + k) for k in range(scale)]))
    sums = rows.select(*keys, div(F.col("y"), scale).alias("y"), F.col("y").alias("_y"), across.alias("row")).groupBy(*keys, "y").agg(F.array_sort(F.collect_list(F.struct("_y", "row"))).alias("_r"))
    first = F.element_at("_r", 1)["row"]
    added = F.aggregate(F.slice("_r", F.lit(2), F.size("_r")), first, lambda a, r: F.zip_with(a, r["row"], lambda p, q: p + q))
    return sums.select(*keys, "y", F.transform(added, lambda x: x / float(scale * scale)).alias("row"))


def valid(rows: DataFrame) -> DataFrame:
    """(image_id, c, y, x, v): the samples of rows of padded tiles (with boxes ``t`` in their keys) that belong to the tile itself, placed in the image."""
    t = F.col("t")
    inside = rows.where((F.col("y") >= t["vy0"] - t["py0"]) & (F.col("y") < t["vy1"] - t["py0"]))
    own = F.slice("row", t["vx0"] - t["px0"] + 1, t["vx1"] - t["vx0"])
    long = inside.select("image_id", "c", "t", (F.col("y") + t["py0"]).alias("y"), F.posexplode(own).alias("x", "v"))
    return long.select("image_id", "c", "y", (F.col("x") + F.col("t.vx0")).alias("x"), "v")
