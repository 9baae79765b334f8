"""Images as relations of tiles, so that no row ever holds a whole plane.

A tile is a row (image_id, c, ty, tx, w, h, v): w and h are the image's size, v
the samples of the square of ``tile`` samples a side at (ty * tile, tx * tile),
cut at the image's border. Neighbours meet by an equi-join on computed tile
ids: each tile sends border strips, never more than itself, to up to 8 others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import at, div, grid
from .descriptors import PERIOD, RATIO_ALONE, RATIO_GATE
from .tiling import TILE

KEYS = ["image_id", "c", "ty", "tx"]
_BOX = ("tile_id", "vx0", "vy0", "vx1", "vy1", "px0", "py0", "pw", "ph")


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def side_in(w: Column, tx: Column, tile: int) -> Column:
    """Samples of tile ``tx`` along an axis of ``w`` samples."""
    return F.least(w - tx * tile, F.lit(tile))


def cut(planes: DataFrame, tile: int = TILE) -> DataFrame:
    """Planes (image_id, c, w, h, v) as tiles: narrow, each sample copied once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w, h = b["w"][i].as_py(), b["h"][i].as_py()
                p = np.asarray(b["v"][i].values, float).reshape(h, w)
                for ty in range(-(-h // tile)):
                    parts = [p[ty * tile : (ty + 1) * tile, x : x + tile] for x in range(0, w, tile)]
                    n = len(parts)
                    same = {k: b[k].take(pa.array([i] * n)) for k in ("image_id", "c", "w", "h")}
                    rows = {"ty": pa.array([ty] * n, pa.int32()), "tx": pa.array(range(n), pa.int32()), "v": pa.array([q.reshape(-1) for q in parts], pa.list_(pa.float64()))}
                    yield pa.RecordBatch.from_pydict({k: (same | rows)[k] for k in (*KEYS, "w", "h", "v")})

    return planes.select("image_id", "c", "w", "h", "v").mapInArrow(run, f"{_kinds(planes, ['image_id', 'c'])}, ty int, tx int, w int, h int, v array<double>")


def gathered(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """Pixels (image_id, c, w, h, y, x, v) as tiles: one shuffle, a group is one tile. A tile that lacks samples fails."""
    rows = pixels.groupBy("image_id", "c", "w", "h", div(F.col("y"), tile).alias("ty"), div(F.col("x"), tile).alias("tx")).agg(F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v")))).alias("s"))
    full = side_in(F.col("w"), F.col("tx"), tile) * side_in(F.col("h"), F.col("ty"), tile)
    v = F.when(F.size("s") == full, F.transform("s", lambda s: s["v"])).otherwise(F.raise_error(F.lit("a tile lacks samples or has one twice")).cast("array<double>"))
    return rows.select(*KEYS, "w", "h", v.alias("v"))


def generated(spark: SparkSession, w: int, h: int, value: Callable[[Column, Column, int, int], Column], tile: int = TILE, image_id: int = 0) -> DataFrame:
    """Tiles of value(y, x, w, h), made where they are needed."""
    across, down = -(-w // tile), -(-h // tile)
    t = spark.range(across * down).select(F.lit(image_id).cast("long").alias("image_id"), F.lit(0).alias("c"), div(F.col("id"), across).alias("ty"), (F.col("id") % across).cast("int").alias("tx"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    wide, high = side_in(F.col("w"), F.col("tx"), tile), side_in(F.col("h"), F.col("ty"), tile)
    return t.withColumn("v", grid(wide, high, lambda y, x: value(y + F.col("ty") * tile, x + F.col("tx") * tile, w, h).cast("double")))


def pages(planes: DataFrame, across: int, down: int, page: Column, slot: Column, tile: int = TILE, fill: float = 128.0) -> DataFrame:
    """Tiles of pages of ``across`` x ``down`` planes of one size: plane ``slot`` (from 0, row by row) of ``page``; slots without a plane hold ``fill``.

    Planes go to the tiles that they touch, which fill in what they lack: one
    shuffle, and never a page in a row. ``planes`` has w and h; tiles are
    multiples of them.
    """
    w, h = F.col("w"), F.col("h")
    placed = planes.select(page.alias("image_id"), "c", w.alias("pw"), h.alias("ph"), "v", (div(slot, across) * h).alias("y"), ((slot % across) * w).cast("int").alias("x"))
    placed = placed.withColumns({"ty": div(F.col("y"), tile), "tx": div(F.col("x"), tile)})
    # A page that has any plane has all its tiles.
    spans = placed.groupBy("image_id", "c").agg(F.max("pw").alias("pw"), F.max("ph").alias("ph"))
    every = spans.select("image_id", "c", "pw", "ph", F.explode(grid(div(F.col("pw") * across + (tile - 1), tile), div(F.col("ph") * down + (tile - 1), tile), lambda y, x: F.struct(y.alias("ty"), x.alias("tx")))).alias("t")).select("image_id", "c", "pw", "ph", "t.*", F.lit(None).cast("array<double>").alias("v"), F.lit(0).alias("y"), F.lit(0).alias("x"))
    both = placed.select(*every.columns).unionByName(every).groupBy(*KEYS, "pw", "ph").agg(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("y", "x", "v"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ty, tx, ph, pw, parts in zip(*(b[k].to_pylist() for k in ("ty", "tx", "ph", "pw")), b["p"], strict=True):
                y0, x0 = ty * tile, tx * tile
                p = np.full((min(tile, ph * down - y0), min(tile, pw * across - x0)), fill)
                for q in parts:
                    y, x = q["y"].as_py() - y0, q["x"].as_py() - x0
                    p[y : y + ph, x : x + pw] = np.asarray(q["v"].values).reshape(ph, pw)
                out.append(p.reshape(-1))
            n = b.num_rows
            yield pa.RecordBatch.from_pydict({k: b[k] for k in KEYS} | {"w": pa.array([x * across for x in b["pw"].to_pylist()], pa.int32()), "h": pa.array([x * down for x in b["ph"].to_pylist()], pa.int32()), "v": pa.array(out, pa.list_(pa.float64())) if n else pa.array([], pa.list_(pa.float64()))})

    fits = F.when((F.lit(tile) % F.col("pw") == 0) & (F.lit(tile) % F.col("ph") == 0), F.col("pw")).otherwise(F.raise_error(F.lit("tiles are no multiples of the planes")).cast("int"))
    return both.withColumn("pw", fits).mapInArrow(run, f"{_kinds(both, KEYS)}, w int, h int, v array<double>")


def _strip(p: np.ndarray, d: int, halo: int, axis: int) -> np.ndarray:
    """What the tile ``d`` tiles on needs along an axis: all, or the last or first lines that its halo reaches."""
    n = p.shape[axis]
    if d == 0 or halo >= n:
        return p
    return p.take(range(n - halo, n) if d > 0 else range(halo), axis)


def exchanged(tiles: DataFrame, tile: int, halo: int, scale: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, w, h, carry, pieces): each tile with the border strips of its neighbours, which one shuffle brings together.

    ``pieces`` are structs (sy, sx, wide, v), at most 9 where the halo reaches
    no further than the next tile: where a piece lies from the tile, its width
    and samples. Samples of ``v`` are ``scale`` times as dense as w, h,
    ``tile`` and ``halo`` say; ``carry`` columns stay with the tile.
    """
    rings = -(-halo // tile)
    around = range(-rings, rings + 1)
    reach = lambda d: (halo - (abs(d) - 1) * tile) * scale
    kinds = {c: pa.field(c, pa.null()) for c in carry}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ty, tx, sy, sx, wide, v = [], [], [], [], [], [], []
            for i, (y, x, w, h) in enumerate(zip(*(b[k].to_pylist() for k in ("ty", "tx", "w", "h")), strict=True)):
                high = min(tile, h - y * tile) * scale
                p = np.asarray(b["v"][i].values, float).reshape(high, -1)
                for dy in around:
                    for dx in around:
                        if 0 <= y + dy < -(-h // tile) and 0 <= x + dx < -(-w // tile):
                            q = _strip(_strip(p, dy, reach(dy), 0), dx, reach(dx), 1)
                            own.append(i)
                            ty.append(y + dy)
                            tx.append(x + dx)
                            sy.append(-dy)
                            sx.append(-dx)
                            wide.append(q.shape[1])
                            v.append(np.ascontiguousarray(q).reshape(-1))
            take = pa.array(own, pa.int64())
            mine = pa.array([i if not a and not c else None for i, a, c in zip(own, sy, sx, strict=True)], pa.int64())
            cols = {k: b[k].take(take) for k in ("image_id", "c")} | {"ty": pa.array(ty, pa.int32()), "tx": pa.array(tx, pa.int32())} | {k: b[k].take(take) for k in ("w", "h")}
            cols |= {"sy": pa.array(sy, pa.int32()), "sx": pa.array(sx, pa.int32()), "wide": pa.array(wide, pa.int32()), "v": pa.array(v, pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict(cols | {k: b[k].take(mine) for k in kinds})

    kept = f", {_kinds(tiles, list(carry))}" if carry else ""
    sent = tiles.select(*KEYS, "w", "h", "v", *carry).mapInArrow(run, f"{_kinds(tiles, KEYS)}, w int, h int, sy int, sx int, wide int, v array<double>{kept}")
    return sent.groupBy(*KEYS, "w", "h").agg(*(F.max_by(c, F.col(c).isNotNull()).alias(c) for c in carry), F.collect_list(F.struct("sy", "sx", "wide", "v")).alias("pieces"))


def assembled(pieces: pa.Scalar) -> tuple[np.ndarray, int, int]:
    """The padded tile of a row's pieces, and how many lines of halo it has above and samples left."""
    rows: dict[int, dict[int, np.ndarray]] = {}
    s = pieces.values
    for y, x, wide, v in zip(s.field("sy").to_pylist(), s.field("sx").to_pylist(), s.field("wide").to_pylist(), _parts(s.field("v")), strict=True):
        rows.setdefault(y, {})[x] = v.reshape(-1, wide)
    whole = [np.concatenate([rows[y][x] for x in sorted(rows[y])], 1) for y in sorted(rows)]
    top = sum(row[0].shape[0] for y, row in rows.items() if y < 0)
    left = sum(q.shape[1] for x, q in rows[0].items() if x < 0)
    return np.concatenate(whole), top, left


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    flat, ends = np.asarray(lists.values, float), np.asarray(lists.offsets)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def padded(tiles: DataFrame, tile: int = TILE, halo: int = 24) -> DataFrame:
    """Tiles with their halos as ``tiling.split`` gives them: image_id, c, w, h, v of the padded tile, size (w and h of the image) and its boxes t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes, sizes, wide, high, out = [], [], [], [], []
            for i, (ty, tx, w, h) in enumerate(zip(*(b[k].to_pylist() for k in ("ty", "tx", "w", "h")), strict=True)):
                p, top, left = assembled(b["pieces"][i])
                x, y = tx * tile, ty * tile
                boxes.append({"tile_id": ty * -(-w // tile) + tx, "vx0": x, "vy0": y, "vx1": min(x + tile, w), "vy1": min(y + tile, h), "px0": x - left, "py0": y - top, "pw": p.shape[1], "ph": p.shape[0]})
                sizes.append({"w": w, "h": h})
                wide.append(p.shape[1])
                high.append(p.shape[0])
                out.append(p.reshape(-1))
            ints = lambda names: pa.struct([(n, pa.int32()) for n in names])
            yield pa.RecordBatch.from_pydict({"image_id": b["image_id"], "c": b["c"], "w": pa.array(wide, pa.int32()), "h": pa.array(high, pa.int32()), "v": pa.array(out, pa.list_(pa.float64())), "size": pa.array(sizes, ints(("w", "h"))), "t": pa.array(boxes, ints(_BOX))})

    box = ", ".join(f"{n}: int" for n in _BOX)
    return exchanged(tiles, tile, halo).mapInArrow(run, f"{_kinds(tiles, ['image_id', 'c'])}, w int, h int, v array<double>, size struct<w: int, h: int>, t struct<{box}>")


def pixels(tiles: DataFrame, tile: int = TILE, scale: int = 1, v: str = "v") -> DataFrame:
    """(image_id, c, y, x, v) of tiles whose samples are ``scale`` times as dense."""
    wide = side_in(F.col("w"), F.col("tx"), tile) * scale
    long = tiles.select(*KEYS, wide.alias("_w"), F.posexplode(v).alias("_i", "v"))
    return long.select("image_id", "c", (div(F.col("_i"), F.col("_w")) + F.col("ty") * (tile * scale)).alias("y"), (F.col("_i") % F.col("_w") + F.col("tx") * (tile * scale)).cast("int").alias("x"), "v")


def _steps(tiles: DataFrame, tile: int) -> DataFrame:
    """(image_id, c, axis, phase, own, n): steps between neighbours of one tile by phase, and those over borders of tiles."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, n = [], []
            for ty, tx, w, v in zip(*(b[k].to_pylist() for k in ("ty", "tx", "w")), b["v"], strict=True):
                p = np.asarray(v.values, float).reshape(-1, min(tile, w - tx * tile))
                sums, counts = [], []
                for axis, start in ((1, tx), (0, ty)):
                    d = np.abs(np.diff(p, axis=axis))
                    phase = (np.arange(1, p.shape[axis]) + start * tile) % PERIOD
                    sums += np.bincount(phase, d.sum(1 - axis), PERIOD).tolist()
                    counts += (np.bincount(phase, minlength=PERIOD) * d.shape[1 - axis]).tolist()
                own.append(sums)
                n.append(counts)
            yield pa.RecordBatch.from_pydict({"image_id": b["image_id"], "c": b["c"], "own": pa.array(own, pa.list_(pa.float64())), "n": pa.array(n, pa.list_(pa.int64()))})

    kinds = _kinds(tiles, ["image_id", "c"])
    both = tiles.select("image_id", "c", "ty", "tx", "w", "v").mapInArrow(inside, f"{kinds}, own array<double>, n array<long>")
    both = both.select("image_id", "c", F.posexplode(F.arrays_zip("own", "n")).alias("k", "e")).select("image_id", "c", div(F.col("k"), PERIOD).alias("axis"), (F.col("k") % PERIOD).alias("phase"), "e.own", "e.n")

    wide = side_in(F.col("w"), F.col("tx"), tile)
    high = side_in(F.col("h"), F.col("ty"), tile)
    line = lambda first, step, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: at(F.col("v"), first + k * step))
    zero = F.lit(0)
    # The far edge of a tile goes to the next one, which holds its near edge; an edge is one line of samples.
    edge = lambda axis, far, ty, tx, v: F.struct(F.lit(axis).alias("axis"), F.lit(far).alias("far"), ty.alias("ty"), tx.alias("tx"), v.alias("v"))
    edges = F.array(
        edge(0, True, F.col("ty"), F.col("tx") + 1, line(wide - 1, wide, high)),
        edge(0, False, F.col("ty"), F.col("tx"), line(zero, wide, high)),
        edge(1, True, F.col("ty") + 1, F.col("tx"), line((high - 1) * wide, F.lit(1), wide)),
        edge(1, False, F.col("ty"), F.col("tx"), line(zero, F.lit(1), wide)),
    )
    sent = tiles.select("image_id", "c", F.inline(edges))
    met = sent.groupBy("image_id", "c", "axis", "ty", "tx").agg(F.max(F.when(F.col("far"), F.col("v"))).alias("a"), F.max(F.when(~F.col("far"), F.col("v"))).alias("b")).where("a is not null and b is not null")
    place = F.when(F.col("axis") == 0, F.col("tx")).otherwise(F.col("ty")) * tile
    over = F.aggregate(F.zip_with("a", "b", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, x: s + x)
    return both.unionByName(met.select("image_id", "c", "axis", (place % PERIOD).cast("int").alias("phase"), over.alias("own"), F.size("a").cast("long").alias("n")))


def _best(steps: Column) -> Column:
    """(ratio, phase) of structs (phase, own, n) in the order of phases; see ``descriptors.artifact_stats``."""
    every = F.aggregate(steps, F.lit(0.0), lambda s, x: s + x["own"])
    count = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x["n"])

    def ratio(x: Column) -> Column:
        inner, m = every - x["own"], count - x["n"]
        r = F.when((inner > 0) & (m > 0), (x["own"] / F.greatest(x["n"], F.lit(1))) / (inner / F.greatest(m, F.lit(1)))).when(x["own"] > 0, RATIO_ALONE).otherwise(1.0)
        return F.struct(F.when(x["n"] > 0, r).otherwise(0.0).alias("ratio"), (-x["phase"]).alias("down"))

    best = F.array_max(F.transform(steps, ratio))
    return F.when(best["ratio"] > 1.0, F.struct(best["ratio"].alias("ratio"), (-best["down"]).alias("phase"))).otherwise(F.struct(F.lit(1.0).alias("ratio"), F.lit(0).alias("phase")))


def merged_stats(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, c, lo, hi, stats): range and artifact statistics of whole images, merged from sums and counts of their tiles.

    A tile gives 16 sums to a partial aggregate, its edges one line each to the
    next tile. For byte planes sums are exact, so that the result is that of
    ``descriptors.artifact_stats`` on the whole plane whatever the tiles are.
    """
    small = (F.col("w") < 2) | (F.col("h") < 2)
    ranges = tiles.groupBy("image_id", "c").agg(F.min(F.array_min("v")).alias("lo"), F.max(F.array_max("v")).alias("hi"), F.max(small).alias("small"))
    summed = _steps(tiles, tile).groupBy("image_id", "c", "axis", "phase").agg(F.sum("own").alias("own"), F.sum("n").alias("n"))
    listed = summed.groupBy("image_id", "c").agg(*(F.sort_array(F.collect_list(F.when(F.col("axis") == k, F.struct("phase", "own", "n")))).alias(f"a{k}") for k in (0, 1)))
    best = listed.select("image_id", "c", _best(F.col("a0")).alias("a"), _best(F.col("a1")).alias("b"))
    joined = ranges.join(best, ["image_id", "c"], "left")
    a, b = (F.when(~F.col("small"), F.col(k)) for k in ("a", "b"))
    ratio = [F.coalesce(x["ratio"], F.lit(1.0)) for x in (a, b)]
    most = F.greatest(*ratio)
    stats = F.struct(
        ratio[0].alias("ratio_h"),
        ratio[1].alias("ratio_v"),
        F.coalesce(a["phase"], F.lit(0)).cast("int").alias("phase_x"),
        F.coalesce(b["phase"], F.lit(0)).cast("int").alias("phase_y"),
        (most > RATIO_GATE).alias("present"),
        F.when(most > RATIO_GATE, F.least(F.lit(1.0), most - RATIO_GATE)).otherwise(0.0).alias("strength"),
    )
    return joined.select("image_id", "c", "lo", "hi", stats.alias("stats"))
