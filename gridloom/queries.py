"""Raster queries over the driver's tables and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color
from .functions.arrays import at
from .functions.kernels import Kernel, phases
from .operators import descriptors as desc
from . import sql
from .operators import forward, metrics, mosaic, quantize, regularize, resample, rows, tiling
from .operators.numbering import numbered
from .plans import numeric, tiled
from .plans.rounds import shared_folder
from .plans.stacks import mapped
from .operators.tiling import stitch as stitch_tiles
from .plans.upscale import BURST_CONFIDENCE, DEBLOCK, enlarged, fuse_burst, upscale, upscale_tiled, upscaled_tiles, worst_residual
from .sources import images, rasters


def W() -> Column:  # noqa: N802  columns need a session, which importing must not
    return F.col("w")


def H() -> Column:  # noqa: N802
    return F.col("h")


def V() -> Column:  # noqa: N802
    return F.col("v")


# --- rasters in SQL -------------------------------------------------------

_EMB = """emb as materialized (
  select vec_id as image_id, cast(i // 8 as integer) as y, cast(i % 8 as integer) as x,
         floor(least(greatest((cast(embedding[i + 1] as double) + 1) * 127.5, 0), 255) + 0.5) as v
  from embeddings, range(64) t(i) where len(embedding) = 64
)"""
_EVT = """evt as materialized (
  select t.event_type as image_id, cast(g.i // 24 as integer) as y, cast(g.i % 24 as integer) as x, cast(coalesce(c.n, 0) as double) as v
  from (select distinct event_type from events) t cross join range(720) g(i)
  left join (select event_type, (least(day(ts), 30) - 1) * 24 + hour(ts) as cell, count(*) as n from events group by all) c
    on c.event_type = t.event_type and c.cell = g.i
)"""


def _emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.from_embeddings(rasters.spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


def _evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _pixels(df: DataFrame, value: Column, wide: Column | None = None, digits: int | None = 4) -> DataFrame:
    out = metrics.pixels(df.withColumn("_out", value), "_out", wide, ("image_id",))
    return out.withColumn("v", F.round("v", digits) if digits is not None else F.col("v"))


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


# --- sources --------------------------------------------------------------

def _patterns(spark: SparkSession, sf_dir: str, value: Callable) -> DataFrame:
    """A pattern for each vector, moved down by its label and right by its id."""
    rows = rasters.spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), "label"))
    return rasters.patterned(rows, 16, 16, value, F.col("label"), (F.col("image_id") % 8).cast("int"))


def _chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = [_patterns(spark, sf_dir, f).withColumn("c", F.lit(c)) for c, f in enumerate((rasters.CHROMA_RED, lambda y, x, w, h: F.lit(0.0), rasters.CHROMA_BLUE))]
    return planes[0].unionByName(planes[1]).unionByName(planes[2])


_MOVED = "(select vec_id as image_id, cast(i // 16 as integer) as py, cast(i % 16 as integer) as px, cast(i // 16 + label as integer) as y, cast(i % 16 + vec_id % 8 as integer) as x from embeddings, range(256) t(i))"
_DIAGONAL = "30 + 180.0::double * ({0} + {1}) / 62"
for _name, _value, _sql in (
    ("checker", rasters.CHECKER, "case when (x + y) % 2 = 0 then 0 else 255 end"),
    ("ramp", rasters.RAMP, "least(x * 8.0::double, 255)"),
    ("sine", rasters.SINE, "128.0::double + 60 * sin(2 * pi() * x / 9) + 40 * sin(2 * pi() * y / 13 + 1)"),
    ("blocky", rasters.BLOCKY, f"0.25::double * ({_DIAGONAL.format('x', 'y')}) + 0.75::double * ({_DIAGONAL.format('x // 8 * 8 + 3.5', 'y // 8 * 8 + 3.5')})"),
    ("step", rasters.STEP, "case when x < 8 then 0 else 255 end"),
    ("flat", rasters.FLAT, "128"),
    ("stripes", rasters.STRIPES, "case when (x // 4) % 2 = 1 then 0 else 255 end"),
    ("modular", rasters.MODULAR, "(7 * x + 13 * y) % 251"),
    ("zone", rasters.ZONE, "128 + 100 * sin(pi() * ((x - 8) * (x - 8) + (y - 8) * (y - 8)) / 32)"),
):
    _add(f"synthetic_{_name}", lambda s, d, f=_value: _pixels(_patterns(s, d, f), V()), f"select image_id, py as y, px as x, round(cast({_sql} as double), 4) as v from {_MOVED}")
_add("synthetic_chroma", lambda s, d: metrics.pixels(_chroma(s, d)).withColumn("v", F.round("v", 4)), f"select image_id, c.c, py as y, px as x, round(case c.c when 0 then 128.0::double + 60 * sin(2 * pi() * x / 9) when 1 then 0 else 128.0::double + 60 * sin(2 * pi() * y / 7 + 1) end, 4) as v from {_MOVED}, (values (0), (1), (2)) c(c)")
_add("raster_emb", lambda s, d: _pixels(_emb(s, d), V()), f"with {_EMB} select * from emb")
_add("raster_evt", lambda s, d: _pixels(_evt(s, d), V()), f"with {_EVT} select * from evt")


#: Vectors of a page, across and down, and samples of a side of its tiles.
_ACROSS, _DOWN, _TILE = 8, 4, 24


def _page_tiles(spark: SparkSession, sf_dir: str, across: int = _ACROSS, down: int = _DOWN, tile: int = _TILE) -> DataFrame:
    """All vectors of a label as the patches of its pages, as tiles; a page has the number 100000 * label + its place."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) = 64").select("vec_id", "label")
    placed = numbered(labels, "label", "vec_id")
    planes = _emb(spark, sf_dir).join(placed, F.col("image_id") == F.col("vec_id"))
    place, size = F.col("place"), across * down
    return mosaic.pages(planes, across, down, F.col("label").cast("long") * 100_000 + F.call_function("div", place, F.lit(size)), (place % size).cast("int"), tile)


def _pages_sql(across: int = _ACROSS, down: int = _DOWN, name: str = "pg") -> str:
    return f"""{name}_at as materialized (
  select vec_id, cast(label as bigint) * 100000 + p // {across * down} as page, p % {across * down} as slot
  from (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as p from embeddings where len(embedding) = 64)
), {name} as materialized (
  select q.page as image_id, cast(s.j // {across} * 8 + r.i // 8 as integer) as y, cast(s.j % {across} * 8 + r.i % 8 as integer) as x, coalesce(e.v, 128.0) as v
  from (select distinct page from {name}_at) q cross join range({across * down}) s(j) cross join range(64) r(i)
  left join {name}_at a on a.page = q.page and a.slot = s.j left join emb e on e.image_id = a.vec_id and e.y = r.i // 8 and e.x = r.i % 8
)"""


_PAGES = f"{_EMB}, {_pages_sql()}"
_add("mosaic_tiles", lambda s, d: mosaic.pixels(_page_tiles(s, d), _TILE).drop("c"), f"with {_PAGES} select * from pg")
_add(
    "mosaic_halo",
    lambda s, d: mosaic.padded(_page_tiles(s, d), _TILE, 10).select("image_id", "t.tile_id", "t.px0", "t.py0", "t.pw", "t.ph", F.aggregate(F.transform("v", lambda v, i: v * (i % 1009 + 1)), F.lit(0.0), lambda a, x: a + x).alias("check_sum")),
    f"""with {_PAGES}, t as (select a.i * 3 + b.i as tile_id, greatest(0, b.i * 24 - 10) as px0, greatest(0, a.i * 24 - 10) as py0, least(64, b.i * 24 + 34) as px1, least(32, a.i * 24 + 34) as py1 from range(2) a(i), range(3) b(i))
select image_id, cast(tile_id as integer) as tile_id, cast(px0 as integer) as px0, cast(py0 as integer) as py0, cast(px1 - px0 as integer) as pw, cast(py1 - py0 as integer) as ph, sum(v * (((y - py0) * (px1 - px0) + x - px0) % 1009 + 1)) as check_sum
from pg join t on x >= px0 and x < px1 and y >= py0 and y < py1 group by all""",
)


def _bursts(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """Every vector as a frame: those of one label, by vec_id, in bursts of ``most``; a burst is named after its first vector."""
    from pyspark.sql import Window

    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    placed = labels.withColumn("_at", place).withColumn("frame", (F.col("_at") % most).cast("int"))
    burst = F.first("vec_id").over(Window.partitionBy("label", F.floor(F.col("_at") / most)).orderBy("frame"))
    return _emb(spark, sf_dir).join(placed.withColumn("burst_id", burst), F.col("image_id") == F.col("vec_id")).select("burst_id", "frame", "image_id", "c", "w", "h", "v")


_FRAMES = "placed as (select vec_id, label, row_number() over (partition by label order by vec_id) - 1 as p from embeddings), frames as materialized (select first(vec_id) over (partition by label, p // 3 order by p) as burst_id, cast(p % 3 as integer) as frame, vec_id from placed)"
_add("burst_frames", lambda s, d: _bursts(s, d).select("burst_id", "frame", "image_id"), f"with {_FRAMES} select burst_id, frame, vec_id as image_id from frames")

# --- resampling -----------------------------------------------------------


def _tap_sql(kernel: Kernel, scale: int, axis: str) -> str:
    rows = ", ".join(f"({p}, {off}, {wt!r}::double)" for p, taps in enumerate(phases(kernel, scale)) for off, wt in taps)
    return f"(values {rows}) {axis}(p, off, wt)"


def _mirror_sql(i: str, n: int) -> str:
    return f"greatest(0, least({n - 1}, case when {i} < 0 then -({i}) when {i} >= {n} then {2 * n - 2} - ({i}) else {i} end))"


def _up_cte(source: str, kernel: Kernel, scale: int, w: int, h: int, name: str) -> str:
    """CTEs that enlarge relation ``source`` (image_id, y, x, v); the last is ``name``."""
    return f"""{name}_a as (
  select s.image_id, s.y, o.i as x, sum(t.wt * s.v) as v from range({w * scale}) o(i)
  join {_tap_sql(kernel, scale, "t")} on t.p = o.i % {scale}
  join {source} s on s.x = {_mirror_sql(f"o.i // {scale} + t.off", w)} group by s.image_id, s.y, o.i
), {name} as (
  select s.image_id, cast(o.i as integer) as y, cast(s.x as integer) as x, sum(t.wt * s.v) as v from range({h * scale}) o(i)
  join {_tap_sql(kernel, scale, "t")} on t.p = o.i % {scale}
  join {name}_a s on s.y = {_mirror_sql(f"o.i // {scale} + t.off", h)} group by s.image_id, o.i, s.x
)"""


for _k in Kernel:
    _n = 5 if _k is Kernel.MITCHELL else 4  # digits at which no sample of the tables lies on a boundary
    _add(f"up2_{_k.value}", lambda s, d, k=_k, n=_n: _pixels(mapped(_emb(s, d), lambda p: {"x": numeric.upsample(p, 2, k)}, ["x"]), F.col("x"), W() * 2, n), f"with {_EMB}, {_up_cte('emb', _k, 2, 8, 8, 'u')} select image_id, y, x, round(v, {_n}) as v from u")
_add("up3_lanczos3", lambda s, d: _pixels(mapped(_evt(s, d), lambda p: {"x": numeric.upsample(p, 3, Kernel.LANCZOS3)}, ["x"]), F.col("x"), W() * 3), f"with {_EVT}, {_up_cte('evt', Kernel.LANCZOS3, 3, 24, 30, 'u')} select image_id, y, x, round(v, 4) as v from u")
_add("up2_expression", lambda s, d: _pixels(_emb(s, d), resample.upsample(V(), W(), H(), 2, Kernel.BILINEAR), W() * 2), f"with {_EMB}, {_up_cte('emb', Kernel.BILINEAR, 2, 8, 8, 'u')} select image_id, y, x, round(v, 4) as v from u")
_add("nearest_resize", lambda s, d: _pixels(_emb(s, d), resample.repeat(V(), W(), H(), 4), W() * 4), f"with {_EMB} select image_id, cast(y * 4 + dy as integer) as y, cast(x * 4 + dx as integer) as x, v from emb, range(4) a(dy), range(4) b(dx)")


def _lists(source: str) -> str:
    return f"(select image_id, list(v order by y, x) as l from {source} group by image_id)"


def _bilinear_sql(sy: str, sx: str, w: int, h: int) -> str:
    """Interpolated sample of list ``l`` at the row's places, which lie inside the plane."""

    def part(dy: int, dx: int) -> str:
        place = f"cast(least({h - 1}, floor({sy}) + {dy}) * {w} + least({w - 1}, floor({sx}) + {dx}) + 1 as bigint)"
        fx, fy = (f"({a} - floor({a}))" if d else f"(1 - ({a} - floor({a})))" for a, d in ((sx, dx), (sy, dy)))
        return f"l[{place}] * {fx} * {fy}"

    return " + ".join(part(dy, dx) for dy in (0, 1) for dx in (0, 1))


def _shift_cte(source: str, dx: str, dy: str, w: int, h: int, name: str, fields: str = "") -> str:
    """Moved planes; dx and dy are SQL over rows of ``source``, whose further ``fields`` stay."""
    return f"""{name}_p as materialized (
  select image_id, y, x{fields}, least({w - 1}.0::double, greatest(0.0::double, x - ({dx}))) as sx, least({h - 1}.0::double, greatest(0.0::double, y - ({dy}))) as sy from {source}
), {name} as materialized (select image_id, y, x{fields}, {_bilinear_sql("sy", "sx", w, h)} as v from {name}_p join {_lists(source)} using (image_id))"""


_add("shift_half", lambda s, d: _pixels(_emb(s, d), resample.shift(V(), W(), H(), 0.5, -0.25)), f"with {_EMB}, {_shift_cte('emb', '0.5::double', '-0.25::double', 8, 8, 'm')} select image_id, y, x, round(v, 4) as v from m")
_add("shift_whole", lambda s, d: _pixels(_emb(s, d), resample.shift(V(), W(), H(), 1.0, 2.0)), f"with {_EMB} select image_id, y, x, l[cast(greatest(0, y - 2) * 8 + greatest(0, x - 1) + 1 as bigint)] as v from emb join {_lists('emb')} using (image_id)")


def _lift_cte(source: str, scale: int, w: int, h: int, name: str) -> str:
    # Where a place lies before the first sample both neighbours are that sample.
    place = lambda i, n: f"least({n - 1}.0::double, greatest(0.0::double, (({i}) + 0.5::double) / {scale} - 0.5))"
    return f"{name} as materialized (select image_id, cast(oy.i as integer) as y, cast(ox.i as integer) as x, {_bilinear_sql(place('oy.i', h), place('ox.i', w), w, h)} as v from {_lists(source)} cross join range({w * scale}) ox(i) cross join range({h * scale}) oy(i))"


_add("field_lift", lambda s, d: _pixels(mapped(_emb(s, d), lambda p: {"x": numeric.lift(p, 2)}, ["x"]), F.col("x"), W() * 2), f"with {_EMB}, {_lift_cte('emb', 2, 8, 8, 'l')} select image_id, y, x, round(v, 4) as v from l")

# --- forward model --------------------------------------------------------

for _s in (2, 4):
    _add(f"box_mean_{_s}", lambda s, d, n=_s: _pixels(_emb(s, d), forward.box_mean(V(), W(), H(), n), forward.div(W(), n)), f"with {_EMB} select image_id, cast(y // {_s} as integer) as y, cast(x // {_s} as integer) as x, round(avg(v), 4) as v from emb group by image_id, y // {_s}, x // {_s}")
_add("block_sum", lambda s, d: metrics.pixels(_emb(s, d), keep=("image_id",)).groupBy("image_id", forward.div(F.col("y"), 2).alias("y"), forward.div(F.col("x"), 2).alias("x")).agg(F.sum("v").alias("block_sum"), F.count("*").alias("n")), f"with {_EMB} select image_id, cast(y // 2 as integer) as y, cast(x // 2 as integer) as x, sum(v) as block_sum, count(*) as n from emb group by image_id, y // 2, x // 2")


def _up(df: DataFrame, scale: int = 2, kernel: Kernel = Kernel.BICUBIC) -> DataFrame:
    return mapped(df, lambda p: {"x": numeric.upsample(p, scale, kernel)}, ["x"])


_U = f"{_EMB}, {_up_cte('emb', Kernel.BICUBIC, 2, 8, 8, 'u')}, d as (select image_id, y // 2 as y, x // 2 as x, avg(v) as v from u group by image_id, y // 2, x // 2), r as (select e.image_id, e.y, e.x, e.v - d.v as v from emb e join d using (image_id, y, x))"
_add("residual_lr", lambda s, d: _pixels(_up(_emb(s, d)), forward.residual(F.col("x"), V(), W(), H(), 2)), f"with {_U} select image_id, y, x, round(v, 4) as v from r")
_add("residual_rms", lambda s, d: _up(_emb(s, d)).select("image_id", F.round(forward.rms(forward.residual(F.col("x"), V(), W(), H(), 2)), 4).alias("rms")), f"with {_U} select image_id, round(sqrt(avg(v * v)), 4) as rms from r group by image_id")
_add("project_box", lambda s, d: _pixels(_up(_emb(s, d)), forward.project(F.col("x"), V(), W(), H(), 2), W() * 2), f"with {_U} select u.image_id, u.y, u.x, round(u.v + r.v, 4) as v from u join r on r.image_id = u.image_id and r.y = u.y // 2 and r.x = u.x // 2")
_add("channel_range", lambda s, d: _emb(s, d).select("image_id", forward.value_range(V()).alias("r")).select("image_id", "r.lo", "r.hi"), f"with {_EMB} select image_id, min(v) as lo, max(v) as hi from emb group by image_id")
_add("constant_planes", lambda s, d: _evt(s, d).select("image_id", forward.is_constant(V()).alias("constant")), f"with {_EVT} select image_id, min(v) = max(v) as constant from evt group by image_id")

# --- descriptors ----------------------------------------------------------


def _cells(source: str, w: int, h: int, fields: tuple[str, ...] = ("v",)) -> str:
    """Rows of ``source`` with structs n00 (above, left) to n22 of its fields in the 3 x 3 neighbourhood, borders held."""

    def cell(dy: int, dx: int) -> str:
        i = f"cast(greatest(0, least({h - 1}, s.y + ({dy}))) * {w} + greatest(0, least({w - 1}, s.x + ({dx}))) + 1 as bigint)"
        return f"struct_pack({', '.join(f'{f} := l.l_{f}[{i}]' for f in fields)}) as n{dy + 1}{dx + 1}"

    lists = ", ".join(f"list({f} order by y, x) as l_{f}" for f in fields)
    nine = ", ".join(cell(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return f"from (select s.*, {nine} from {source} s join (select image_id, {lists} from {source} group by image_id) l using (image_id)) a"


_ALL = [f"n{i}{j}.v" for i in range(3) for j in range(3)]
_SUM = " + ".join(_ALL)
_SQ = " + ".join(f"{c} * {c}" for c in _ALL)
_GX = "(n12.v - n10.v) / greatest(1, (least({w} - 1, a.x + 1) - greatest(0, a.x - 1)))"
_GY = "(n21.v - n01.v) / greatest(1, (least({h} - 1, a.y + 1) - greatest(0, a.y - 1)))"


def _local(name: str, value: Callable[[Column, Column, Column], Column], sql: str) -> None:
    for tag, source, cte, w, h in (("emb", _emb, _EMB, 8, 8), ("evt", _evt, _EVT, 24, 30)):
        _add(f"{name}_{tag}", lambda s, d, f=source: _pixels(f(s, d), value(V(), W(), H())), f"with {cte} select a.image_id, a.y, a.x, round({sql.format(w=w, h=h)}, 4) as v {_cells(tag, w, h)}")


_local("gradient_x", desc.gradient_x, _GX)
_local("gradient_y", desc.gradient_y, _GY)
_local("gradient_l1", desc.gradient_l1, "abs(n12.v - n10.v) + abs(n21.v - n01.v)")
_local("laplacian", regularize.laplacian, "4 * n11.v - n10.v - n12.v - n01.v - n21.v")
_local("local_min", desc.local_min, f"least({', '.join(_ALL)})")
_local("local_max", desc.local_max, f"greatest({', '.join(_ALL)})")
_local("local_mean", desc.local_mean, f"({_SUM}) / 9.0::double")
_local("local_variance", desc.local_variance, f"greatest(0, ({_SQ}) / 9.0::double - ({_SUM}) / 9.0::double * (({_SUM}) / 9.0::double))")


def _desc_cte(source: str, w: int, h: int) -> str:
    """CTE ``ds`` (image_id, y, x, edge, alias, lo, hi) of relation ``source``."""
    xx, yy, xy = (" + ".join(f"n{i}{j}.{a} * n{i}{j}.{b}" for i in range(3) for j in range(3)) for a, b in (("gx", "gx"), ("gy", "gy"), ("gx", "gy")))
    return f"""g as (
  select a.image_id, a.y, a.x, a.v, {_GX.format(w=w)} as gx, {_GY.format(h=h)} as gy, ({_SUM}) / 9.0::double as m, ({_SQ}) / 9.0::double as q, least({", ".join(_ALL)}) as lo, greatest({", ".join(_ALL)}) as hi {_cells(source, w, h)}
), ten as (
  select a.*, {xx} as xx, {yy} as yy, {xy} as xy {_cells("g", w, h, ("gx", "gy"))}
), coh as (
  select *, case when xx + yy > 1e-12 then sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy) else 0 end as coh from ten
), ds as (
  select image_id, y, x, coh * least(1.0, sqrt(gx * gx + gy * gy) / 32) as edge, least(1.0, abs(v - m) / 24) * (1 - coh) * least(1.0, greatest(0, q - m * m) / 1600) as alias, lo, hi from coh
)"""


for _tag, _source, _cte, _w, _h in (("emb", _emb, _EMB, 8, 8), ("evt", _evt, _EVT, 24, 30)):
    for _field, _out in (("edge", "edge_confidence"), ("alias", "alias_risk")):
        _add(f"{_out}_{_tag}", lambda s, d, f=_source, k=_field: _pixels(mapped(f(s, d), numeric.descriptors, [k]), F.col(k)), f"with {_cte}, {_desc_cte(_tag, _w, _h)} select image_id, y, x, round({_field}, 4) as v from ds")


def _artifact_sql(cte: str, source: str) -> str:
    def axis(n: str, a: str) -> str:
        other = "x" if a == "y" else "y"
        return f"""{n}_d as (select p.image_id, p.{a} % 8 as phase, abs(p.v - q.v) as dif from {source} p join {source} q on p.image_id = q.image_id and p.{other} = q.{other} and p.{a} = q.{a} + 1
), {n}_s as (select image_id, phase, sum(dif) as own, count(*) as n from {n}_d group by image_id, phase
), {n}_r as (select s.image_id, s.phase, case when t.every - own > 0 and t.m > n then (own / n) / ((t.every - own) / (t.m - n)) when own > 0 then 1000.0 else 1.0 end as ratio
  from {n}_s s join (select image_id, sum(own) as every, sum(n) as m from {n}_s group by image_id) t using (image_id)
), {n} as (select image_id, case when max(ratio) > 1 then max(ratio) else 1.0 end as ratio, case when max(ratio) > 1 then arg_max(phase, [ratio, -phase]) else 0 end as phase from {n}_r group by image_id)"""

    return f"""with {cte}, {axis("ah", "x")}, {axis("av", "y")}{_ARTIFACTS_TAIL}"""


_ARTIFACTS_TAIL = """
select image_id, round(ah.ratio, 4) as ratio_h, round(av.ratio, 4) as ratio_v, cast(ah.phase as integer) as phase_x, cast(av.phase as integer) as phase_y,
       greatest(ah.ratio, av.ratio) > 1.35 as present, round(case when greatest(ah.ratio, av.ratio) > 1.35 then least(1.0, greatest(ah.ratio, av.ratio) - 1.35) else 0 end, 4) as strength
from ah join av using (image_id)"""


def _stats_cte(source: str) -> str:
    """CTE ``st`` (image_id, strength, px, py) of relation ``source``."""
    axes = _artifact_sql("x as (select 1)", source).removeprefix("with x as (select 1), ").removesuffix(_ARTIFACTS_TAIL)
    return f"{axes}, st as materialized (select image_id, case when greatest(ah.ratio, av.ratio) > 1.35 then least(1.0, greatest(ah.ratio, av.ratio) - 1.35) else 0 end as strength, ah.phase as px, av.phase as py from ah join av using (image_id))"


def _artifacts(df: DataFrame) -> DataFrame:
    s = df.select("image_id", desc.artifact_stats(V(), W(), H()).alias("s"))
    return s.select("image_id", F.round("s.ratio_h", 4).alias("ratio_h"), F.round("s.ratio_v", 4).alias("ratio_v"), "s.phase_x", "s.phase_y", "s.present", F.round("s.strength", 4).alias("strength"))


def _page_stats(s: SparkSession, d: str) -> DataFrame:
    st = mosaic.merged_stats(_page_tiles(s, d), _TILE)
    return st.select("image_id", F.round("stats.ratio_h", 4).alias("ratio_h"), F.round("stats.ratio_v", 4).alias("ratio_v"), "stats.phase_x", "stats.phase_y", "stats.present", F.round("stats.strength", 4).alias("strength"))


_add("artifact_stats_evt", lambda s, d: _artifacts(_evt(s, d)), _artifact_sql(_EVT, "evt"))
_add("artifact_stats_grid", _page_stats, _artifact_sql(_PAGES, "pg"))
_add("mosaic_ranges", lambda s, d: mosaic.merged_stats(_page_tiles(s, d), _TILE).select("image_id", "lo", "hi"), f"with {_PAGES} select image_id, min(v) as lo, max(v) as hi from pg group by image_id")


def _boundary(source: str, period: int, phase: str) -> str:
    return f"(({source} - {phase}) % {period} + {period}) % {period} = 0"


_add("boundary_energy", lambda s, d: _evt(s, d).select("image_id", F.round(metrics.boundary_energy(V(), W(), H(), 3, 5), 4).alias("energy")), f"with {_EVT} select image_id, round(sum(e), 4) as energy from (select p.image_id, (p.v - q.v) * (p.v - q.v) as e from evt p join evt q on p.image_id = q.image_id and p.y = q.y and p.x = q.x + 1 where {_boundary('p.x', 8, '3')} union all select p.image_id, (p.v - q.v) * (p.v - q.v) from evt p join evt q on p.image_id = q.image_id and p.x = q.x and p.y = q.y + 1 where {_boundary('p.y', 8, '5')}) group by image_id")



def _stats() -> Column:
    return F.struct(F.lit(1.0).alias("strength"), F.lit(3).alias("phase_x"), F.lit(5).alias("phase_y"))


_DB = " + ".join(f"case when {_boundary(f'a.{ax} + {up}', 8, ph)} and {edge} then {n}.v - n11.v else 0 end" for ax, up, ph, edge, n in (("x", 0, "3", "a.x > 0", "n10"), ("x", 1, "3", "a.x < 23", "n12"), ("y", 0, "5", "a.y > 0", "n01"), ("y", 1, "5", "a.y < 29", "n21")))
_add("deblock_step", lambda s, d: _pixels(_evt(s, d), regularize.deblock(V(), W(), H(), 1, _stats(), DEBLOCK)), f"with {_EVT} select a.image_id, a.y, a.x, round(greatest(-0.5, least(0.5, 0.1 * ({_DB}))), 4) as v {_cells('evt', 24, 30)}")

# --- regularisation and reconstruction ------------------------------------


def _maps_cte(source: str, w: int, h: int, scales: tuple[int, ...]) -> str:
    """Descriptor fields of ``source`` lifted to each scale, m2_edge and so on; edge, lo and hi."""
    fields = [f"f_{k} as (select image_id, y, x, {k} as v from ds), {', '.join(_lift_cte(f'f_{k}', n, w, h, f'm{n}_{k}') for n in scales)}" for k in ("edge", "lo", "hi")]
    return f"{_desc_cte(source, w, h)}, {', '.join(fields)}"


_MAPS = _maps_cte("emb", 8, 8, (2,))
_add("reg_maps", lambda s, d: _pixels(mapped(_emb(s, d), lambda p: numeric.maps(p, 2), ["edge"]), F.col("edge"), W() * 2), f"with {_EMB}, {_MAPS} select image_id, y, x, round(v, 4) as v from m2_edge")
_STEP = "2 * 0.05::double * e.v * (case when {x} > hi.v then {x} - hi.v when {x} < lo.v then {x} - lo.v else 0 end)"


def _join_maps(scale: int) -> str:
    return " ".join(f"join m{scale}_{k} {n} using (image_id, y, x)" for k, n in (("edge", "e"), ("lo", "lo"), ("hi", "hi")))


_X0 = _up_cte("emb", Kernel.LANCZOS3, 2, 8, 8, "x0")
_add("reg_step", lambda s, d: _pixels(mapped(_emb(s, d), lambda p: {"r": numeric.edge_step(numeric.upsample(p, 2, Kernel.LANCZOS3), numeric.maps(p, 2))}, ["r"]), F.col("r"), W() * 2), f"with {_EMB}, {_MAPS}, {_X0} select image_id, y, x, round({_STEP.format(x='u.v')}, 4) as v from x0 u {_join_maps(2)}")
_add("reg_frequency", lambda s, d: _pixels(mapped(_emb(s, d), lambda p: {"r": numeric.frequency_step(p, numeric.descriptors(p)["alias"], 0.01)}, ["r"]), F.col("r")), f"with {_EMB}, {_desc_cte('emb', 8, 8)}, lap as (select a.image_id, a.y, a.x, 4 * n11.v - n10.v - n12.v - n01.v - n21.v as v {_cells('emb', 8, 8)}), wl as (select lap.image_id, lap.y, lap.x, ds.alias * lap.v as v from lap join ds using (image_id, y, x)) select a.image_id, a.y, a.x, round(0.02 * (4 * n11.v - n10.v - n12.v - n01.v - n21.v), 4) as v {_cells('wl', 8, 8)}")


def _box_rest(source: str, planes: str, scale: int, name: str) -> str:
    """Source samples less the box means of ``planes``."""
    return f"{name} as materialized (select e.image_id, e.y, e.x, e.v - d.v as v from {source} e join (select image_id, cast(y // {scale} as integer) as y, cast(x // {scale} as integer) as x, avg(v) as v from {planes} group by all) d using (image_id, y, x))"


def _loop(source: str, w: int, h: int, scale: int, passes: int, start: str, name: str, deblocked: bool) -> str:
    """CTEs of the back-projection loop from planes ``start``; ``name`` followed by the pass are its planes.

    Needs the maps at ``scale``, ranges ``rng`` and, if ``deblocked``, statistics ``st``.
    """
    wide, high = w * scale, h * scale
    edges = (("a.x", 0, "px", "a.x > 0", "n10"), ("a.x", 1, "px", f"a.x < {wide - 1}", "n12"), ("a.y", 0, "py", "a.y > 0", "n01"), ("a.y", 1, "py", f"a.y < {high - 1}", "n21"))
    near = " + ".join(f"case when {_boundary(f'{ax} + {up}', 8 * scale, f'st.{ph} * {scale}')} and {edge} then {n}.v - n11.v else 0 end" for ax, up, ph, edge, n in edges)
    out, before = [], start
    for t in range(1, passes + 1):
        n = f"{name}{t}"
        soft = f"{n}_b as materialized (select a.image_id, a.y, a.x, case when st.strength > 0 then greatest(-0.5, least(0.5, 0.1 * st.strength * ({near}))) else 0 end as b {_cells(f'{n}_c', wide, high)} join st on st.image_id = a.image_id)" if deblocked else f"{n}_b as (select image_id, y, x, 0 as b from {n}_c)"
        out.append(f"""{_box_rest(source, before, scale, f"{n}_r")}, {_up_cte(f"{n}_r", Kernel.BILINEAR, scale, w, h, f"{n}_u")},
{n}_c as materialized (select c.image_id, c.y, c.x, c.v + u.v as v from {before} c join {n}_u u using (image_id, y, x)), {soft},
{n}_h as materialized (select image_id, y, x, greatest(g.lo, least(g.hi, u.v - {_STEP.format(x="u.v")} + k.b)) as v from {n}_c u join {n}_b k using (image_id, y, x) {_join_maps(scale)} join rng g using (image_id)),
{_box_rest(source, f"{n}_h", scale, f"{n}_q")}, {n} as materialized (select h.image_id, h.y, h.x, h.v + q.v as v from {n}_h h join {n}_q q on q.image_id = h.image_id and q.y = h.y // {scale} and q.x = h.x // {scale})""")
        before = n
    return ", ".join(out)


_OWN_RANGE = "rng as materialized (select image_id, min(v) as lo, max(v) as hi from {0} group by image_id)"


def _single_sql(cte: str, source: str, w: int, h: int, scale: int, passes: int = 4, deblocked: bool = True, rng: str = _OWN_RANGE, staged: bool = False) -> str:
    """CTEs of ``upscale``; the last planes are ``done``."""
    stages = [2**k for k in range(1, scale.bit_length())] if staged else [scale]
    parts = [cte, rng.format(source), _maps_cte(source, w, h, tuple(stages)), *([_stats_cte(source)] if deblocked else [])]
    last, size = source, 1
    for n in stages:
        parts += [_up_cte(last, Kernel.LANCZOS3, n // size, w * size, h * size, f"s{n}_0"), _loop(source, w, h, n, passes, f"s{n}_0", f"s{n}_", deblocked)]
        last, size = f"s{n}_{passes}", n
    return ", ".join([*filter(None, parts), f"done as materialized (select * from {last})"])


_ROUNDED = "with {0} select image_id, y, x, round(v, 5) as v from done"
for _t in (1, 4):
    _add(f"ibp_{_t}", lambda s, d, t=_t: _pixels(upscale(_emb(s, d), 2, passes=t, deblocking=None, floats=True), V(), None, 5), _ROUNDED.format(_single_sql(_EMB, "emb", 8, 8, 2, _t, False)))

# --- bytes ----------------------------------------------------------------


def _exact_sql(scale: int, dither: bool, planes: str = "") -> str:
    """Bytes of enlarged planes; of CTEs ``planes``, whose last is ``done``, in place of bicubic ones."""
    table = ", ".join(f"({i}, {(b / 64.0 - 0.5) * quantize.AMPLITUDE!r}::double)" for i, b in enumerate(quantize.bayer()))
    up = planes or f"{_EMB}, {_up_cte('emb', Kernel.BICUBIC, scale, 8, 8, 'done')}"
    value = "u.v + b.t" if dither else "u.v"
    return f"""with {up}, c as (
  select u.image_id, u.y, u.x, u.y // {scale} as cy, u.x // {scale} as cx, (u.y % {scale}) * {scale} + u.x % {scale} as i, greatest(0, least(255, {value})) as c
  from (select image_id, y, x, floor(v * 1048576 + 0.5) / 1048576 as v from done) u join (values {table}) b(k, t) on b.k = (u.y % 8) * 8 + u.x % 8
), q as (select *, floor(c + 0.5) as q from c
), e as (select q.image_id, q.cy, q.cx, floor({scale * scale} * any_value(s.v) + 0.5) - sum(q.q) as e from q join emb s on s.image_id = q.image_id and s.y = q.cy and s.x = q.cx group by q.image_id, q.cy, q.cx
), steps as (
  select q.*, e.e, k from q join e using (image_id, cy, cx), lateral (select unnest(range(0, cast(least(case when e.e > 0 then 255 - q.q else q.q end, abs(e.e)) as bigint))) as k) where e.e <> 0
), ranked as (
  select *, row_number() over (partition by image_id, cy, cx order by k - (case when e > 0 then c - q else q - c end), i) as r from steps
), chosen as (select image_id, y, x, count(*) * sign(any_value(e)) as n from ranked where r <= abs(e) group by image_id, y, x)
select q.image_id, q.y, q.x, cast(q.q + coalesce(n, 0) as integer) as v from q left join chosen using (image_id, y, x)"""


def _grained(x: np.ndarray) -> np.ndarray:
    """Samples rounded to 2**-20, so that equal rests are equal in both engines."""
    return np.floor(x * 1048576 + 0.5) / 1048576


def _bytes(s: SparkSession, d: str, scale: int, mode: quantize.Dither) -> DataFrame:
    def work(p: np.ndarray) -> dict[str, np.ndarray]:
        return {"q": numeric.quantise(_grained(numeric.upsample(p, scale, Kernel.BICUBIC)), p, scale, mode)}

    return _pixels(mapped(_emb(s, d), work, ["q"]), F.transform("q", lambda q: q.cast("int")), W() * scale, None)


for _s, _m in ((2, quantize.Dither.NONE), (3, quantize.Dither.NONE), (2, quantize.Dither.ORDERED)):
    _add(f"{'dither' if _m else 'quantize'}_exact_{_s}", lambda s, d, n=_s, m=_m: _bytes(s, d, n, m), _exact_sql(_s, bool(_m)))


def _floats(source: Callable[[SparkSession, str], DataFrame], scale: int, **options) -> Query:
    """Planes of the whole product path before bytes, sample by sample."""
    return lambda s, d: _pixels(upscale(source(s, d), scale, floats=True, **options), V(), None, 5)


def _whole_range(df: DataFrame) -> DataFrame:
    return df.select("image_id", "c", F.lit(0.0).alias("lo"), F.lit(255.0).alias("hi"))


_add("upscale_2x", _floats(_emb, 2), _ROUNDED.format(_single_sql(_EMB, "emb", 8, 8, 2)))
_add("upscale_3x", _floats(_emb, 3), _ROUNDED.format(_single_sql(_EMB, "emb", 8, 8, 3)))
_add("upscale_4x", _floats(_emb, 4), _ROUNDED.format(_single_sql(_EMB, "emb", 8, 8, 4, staged=True)))
_add("upscale_8x", _floats(_emb, 8, mode="progressive"), _ROUNDED.format(_single_sql(_EMB, "emb", 8, 8, 8, staged=True)))
def _tiled_floats(scale: int, **options) -> Query:
    """Pages of embeddings enlarged as tile relations: patches meet at block edges, tiles at others."""
    return lambda s, d: mosaic.pixels(tiled.enlarged_tiles(_page_tiles(s, d), scale, _TILE, 24, floats=True, **options), _TILE, scale).select("image_id", "y", "x", F.round("v", 5).alias("v"))


_add("upscale_blocky", _tiled_floats(2), _ROUNDED.format(_single_sql(_PAGES, "pg", 64, 32, 2)))
_add("mosaic_upscale_3x", _tiled_floats(3, passes=1), _ROUNDED.format(_single_sql(_PAGES, "pg", 64, 32, 3, 1)))
_add("upscale_ranged", lambda s, d: _pixels(upscale(_emb(s, d), 2, clamp=_whole_range(_emb(s, d)), floats=True), V(), None, 5), _ROUNDED.format(_single_sql(_EMB, "emb", 8, 8, 2, rng="rng as materialized (select distinct image_id, 0.0::double as lo, 255.0::double as hi from {0})")))
_LIGHT = f"{_EMB}, light as materialized (select image_id, y, x, 255 * (case when v <= 0 then 0 when v / 255 <= 0.04045 then v / 255 / 12.92 else pow((v / 255 + 0.055) / 1.055, 2.4) end) as v from emb)"
_add("upscale_linear", _floats(_emb, 2, working_space="linear"), f"with {_single_sql(_LIGHT, 'light', 8, 8, 2)} select image_id, y, x, round(255 * (case when v <= 0 then 0 when v >= 255 then 1 when v / 255 <= 0.0031308 then 12.92 * v / 255 else 1.055 * pow(v / 255, 1 / 2.4::double) - 0.055 end), 5) as v from done")


def _exact(**options) -> Query:
    return lambda s, d: _pixels(upscale(_emb(s, d), 2, grain=20, **options), V(), None, None)


_add("upscale_dithered", _exact(dither=quantize.Dither.ORDERED), _exact_sql(2, True, _single_sql(_EMB, "emb", 8, 8, 2)))
_add("upscale_bytes", _exact(), _exact_sql(2, False, _single_sql(_EMB, "emb", 8, 8, 2)))


def _sums(df: DataFrame, scale: int) -> DataFrame:
    """Bytes in blocks, to be beside what they must add up to."""
    big = metrics.pixels(df, keep=("image_id", "c")).groupBy("image_id", "c", forward.div(F.col("y"), scale).alias("y"), forward.div(F.col("x"), scale).alias("x")).agg(F.sum("v").alias("block_sum"))
    return big.select("image_id", "y", "x", F.col("block_sum").cast("long").alias("block_sum"))


# Where the adaptive loop stops depends on the last bits of residuals near 0; a test compares its planes with as many fixed passes.
_add("upscale_auto", lambda s, d: _sums(upscale(_evt(s, d), 2, iters="auto", peak=quantize.COUNT), 2), f"with {_EVT} select image_id, y, x, cast(4 * v as bigint) as block_sum from evt")
_add("residual_start", lambda s, d: upscale(_emb(s, d), 2, passes=0, floats=True).select("image_id", F.round("residual", 5).alias("residual")), f"with {_single_sql(_EMB, 'emb', 8, 8, 2, 0)}, {_box_rest('emb', 'done', 2, 'rest')} select image_id, round(case when min(emb.v) = max(emb.v) then 0 else sqrt(avg(rest.v * rest.v)) end, 5) as residual from rest join emb using (image_id, y, x) group by image_id")
_add("residual_small", lambda s, d: upscale(_emb(s, d), 2).select("image_id", (F.col("residual") < 1e-5).alias("ok"), "iters"), f"with {_single_sql(_EMB, 'emb', 8, 8, 2)}, {_box_rest('emb', 'done', 2, 'rest')} select image_id, sqrt(avg(rest.v * rest.v)) < 1e-5 as ok, cast(case when min(emb.v) = max(emb.v) then 0 else 4 end as integer) as iters from rest join emb using (image_id, y, x) group by image_id")

# --- bursts, tiles, colour, measures --------------------------------------

_REF = "ref as materialized (select emb.* from emb join frames f on f.vec_id = emb.image_id and f.frame = 0)"
_START = f"{_EMB}, {_FRAMES}, {_REF}, {_up_cte('ref', Kernel.LANCZOS3, 2, 8, 8, 'x0')}, {_OWN_RANGE.format('ref')}"


def _grid_sql(steps: tuple[float, ...], middle_last: bool = False) -> str:
    places = [(dy, dx) for dy in steps for dx in steps if not middle_last or dy or dx] + ([(0.0, 0.0)] if middle_last else [])
    return "(values " + ", ".join(f"({k}, {dy}::double, {dx}::double)" for k, (dy, dx) in enumerate(places)) + ") t(k, dy, dx)"


def _register_sql() -> str:
    """CTE ``found`` (burst_id, frame, image_id, dx, dy, confidence): gradient fields matched on ever finer grids."""
    sample = _bilinear_sql("greatest(0.0::double, least(7.0::double, i // 8 - ty))", "greatest(0.0::double, least(7.0::double, i % 8 - tx))", 8, 8)
    cost = f"list_sum(list_transform(range(64), lambda i: pow(r[i + 1] - ({sample}), 2)))"

    def tried(before: str, grid: str) -> str:
        return f"(select *, {cost} as cost from (select p.burst_id, p.frame, p.image_id, p.r, p.l, t.k, p.tx + t.dx as tx, p.ty + t.dy as ty from {before} p, {grid}))"

    best = "select burst_id, frame, image_id, any_value(r) as r, any_value(l) as l, arg_min(tx, [cost, k]) as tx, arg_min(ty, [cost, k]) as ty from {0} group by burst_id, frame, image_id"
    sure = "b[2].cost > 0 and abs(b[1].tx) <= 1.5 and abs(b[1].ty) <= 1.5"
    return f"""gl as materialized (select a.image_id, a.y, a.x, abs(n12.v - n10.v) + abs(n21.v - n01.v) as v {_cells("emb", 8, 8)}),
p0 as materialized (select f.burst_id, f.frame, f.vec_id as image_id, r.l as r, m.l, 0.0::double as tx, 0.0::double as ty from frames f join {_lists("gl")} r on r.image_id = f.burst_id join {_lists("gl")} m on m.image_id = f.vec_id where f.frame > 0),
p1 as materialized ({best.format(tried("p0", _grid_sql((-1.0, -0.5, 0.0, 0.5, 1.0))))}), p2 as materialized ({best.format(tried("p1", _grid_sql((-0.5, 0.0, 0.5))))}),
p3 as materialized (select burst_id, frame, image_id, list_sort(list(struct_pack(cost := cost, k := k, tx := tx, ty := ty))) as b from {tried("p2", _grid_sql((-0.25, 0.0, 0.25), True))} group by burst_id, frame, image_id),
found as materialized (select burst_id, frame, image_id, 0.0::double - b[1].tx as dx, 0.0::double - b[1].ty as dy, case when {sure} then 1 - b[1].cost / b[2].cost else 0 end as confidence from p3
  union all select burst_id, frame, vec_id, 0, 0, 1 from frames where frame = 0)"""


def _gates_sql() -> str:
    """CTE ``used`` (found with kept) and ``using_`` (burst_id, image_id, dx, dy, wt) of registered frames."""
    moved = "select f.image_id, x0.y, x0.x, x0.v, 2 * f.dx as dx, 2 * f.dy as dy from found f join x0 on x0.image_id = f.burst_id where f.frame > 0"
    return f"""sure as materialized (select *, confidence >= {BURST_CONFIDENCE} as ok from found),
apart as materialized (select f.burst_id, avg(abs(m.v - r.v)) as apart from frames f join emb m on m.image_id = f.vec_id join emb r on r.image_id = f.burst_id and r.y = m.y and r.x = m.x where f.frame > 0 group by f.burst_id),
e1 as materialized ({moved}), {_shift_cte("e1", "dx", "dy", 16, 16, "e2")}, {_box_rest("emb", "e2", 2, "e3")}, {_box_rest("emb", "e1", 2, "e4")},
errors as materialized (select a.image_id, a.e, b.e as still from (select image_id, avg(v * v) as e from e3 group by image_id) a join (select image_id, avg(v * v) as e from e4 group by image_id) b using (image_id)),
gate as materialized (select s.burst_id, count(*) filter (ok) > 1 and not (max(abs(dx) + abs(dy)) filter (ok) < 0.25 and any_value(apart) > 0.5) and sum(e) filter (ok) < sum(still) filter (ok) as more
  from sure s left join apart using (burst_id) left join errors using (image_id) group by s.burst_id),
used as materialized (select s.*, s.frame = 0 or (s.ok and coalesce(g.more, false)) as kept from sure s join gate g using (burst_id)),
w1 as materialized (select u.image_id, r.y, r.x, r.v, u.dx, u.dy from used u join ref r on r.image_id = u.burst_id where u.frame > 0 and u.kept), {_shift_cte("w1", "dx", "dy", 8, 8, "w2")},
off as materialized (select w2.image_id, sqrt(avg(pow(w2.v - emb.v, 2))) as off from w2 join emb using (image_id, y, x) group by w2.image_id),
middle as materialized (select burst_id, greatest(list_sort(list(off))[cast(count(*) // 2 + 1 as bigint)], 1e-6) as middle from off join used using (image_id) group by burst_id),
raw as materialized (select u.*, case when u.frame = 0 then 1 else least(1.0, greatest(0.1, confidence)) * exp(-0.5 * pow(off / middle, 2)) end as wt from used u left join off using (image_id) left join middle using (burst_id) where u.kept),
using_ as materialized (select burst_id, image_id, dx, dy, wt / sum(wt) over (partition by burst_id) as wt from raw)"""


def _fused_sql(passes: int = 4) -> str:
    """CTEs of the burst loop over ``using_``; ``done`` has the planes."""
    out, before = [], "x0"
    for t in range(1, passes + 1):
        n = f"z{t}"
        out.append(f"""{n}_x as materialized (select u.image_id, p.y, p.x, p.v, 2 * u.dx as dx, 2 * u.dy as dy from {before} p join using_ u on u.burst_id = p.image_id),
{_shift_cte(f"{n}_x", "dx", "dy", 16, 16, f"{n}_m")}, {_box_rest("emb", f"{n}_m", 2, f"{n}_r")}, {_up_cte(f"{n}_r", Kernel.BILINEAR, 2, 8, 8, f"{n}_u")},
{n}_b as materialized (select b.*, -2 * u.dx as dx, -2 * u.dy as dy from {n}_u b join using_ u using (image_id)), {_shift_cte(f"{n}_b", "dx", "dy", 16, 16, f"{n}_w")},
{n}_f as materialized (select u.burst_id as image_id, w.y, w.x, sum(w.v * u.wt) as v from {n}_w w join using_ u using (image_id) group by u.burst_id, w.y, w.x),
{n}_h as materialized (select image_id, y, x, greatest(g.lo, least(g.hi, p.v + f.v)) as v from {before} p join {n}_f f using (image_id, y, x) join rng g using (image_id)),
{_box_rest("ref", f"{n}_h", 2, f"{n}_q")}, {n} as materialized (select h.image_id, h.y, h.x, h.v + q.v as v from {n}_h h join {n}_q q on q.image_id = h.image_id and q.y = h.y // 2 and q.x = h.x // 2)""")
        before = n
    return ", ".join([*out, f"done as materialized (select * from {before})"])


_REGISTERED = f"{_START}, {_register_sql()}, {_gates_sql()}"
_add("burst_fuse_2x", lambda s, d: _pixels(fuse_burst(_bursts(s, d), 2, floats=True).withColumnRenamed("burst_id", "image_id"), V(), None, 5), _ROUNDED.format(f"{_REGISTERED}, {_fused_sql()}"))
_add("burst_shifts", lambda s, d: fuse_burst(_bursts(s, d), 2).select("burst_id", F.explode("shifts").alias("s")).select("burst_id", "s.frame", (F.col("s.dx") + 0.0).alias("dx"), (F.col("s.dy") + 0.0).alias("dy"), F.round("s.confidence", 6).alias("confidence"), "s.kept"), f"with {_REGISTERED} select burst_id, frame, dx + 0.0::double as dx, dy + 0.0::double as dy, round(confidence, 6) as confidence, kept from used")
_add("burst_gate", lambda s, d: QUERIES["burst_shifts"](s, d).groupBy("burst_id").agg(F.count("*").alias("n_frames"), F.count_if("kept").alias("n_kept"), F.max(F.when(F.col("frame") == 0, F.col("kept"))).alias("reference_kept")), f"with {_REGISTERED} select burst_id, count(*) as n_frames, count(*) filter (kept) as n_kept, bool_or(kept and frame = 0) as reference_kept from used group by burst_id")


def _known(s: SparkSession, d: str) -> DataFrame:
    frames = _bursts(s, d)
    return fuse_burst(frames, 2, shifts=frames.select("burst_id", "frame", F.lit(0.5).alias("dx"), F.lit(0.0).alias("dy")).distinct(), floats=True)


_GIVEN = "using_ as materialized (select burst_id, vec_id as image_id, case when frame = 0 then 0.0::double else 0.5::double end as dx, 0.0::double as dy, 1.0::double / count(*) over (partition by burst_id) as wt from frames)"
_add("burst_known_shifts", lambda s, d: _pixels(_known(s, d).withColumnRenamed("burst_id", "image_id"), V(), None, 5), _ROUNDED.format(f"{_START}, {_GIVEN}, {_fused_sql()}"))
_add("burst_ssd", lambda s, d: _bursts(s, d).alias("m").join(_bursts(s, d).where("frame = 0").select("burst_id", F.col("v").alias("ref")), "burst_id").select("burst_id", "frame", (metrics.mse(F.col("ref"), V()) * F.size(V())).alias("ssd")), f"with {_EMB}, {_FRAMES}, p as (select f.burst_id, f.frame, e.y, e.x, e.v from frames f join emb e on e.image_id = f.vec_id) select m.burst_id, m.frame, sum((m.v - r.v) * (m.v - r.v)) as ssd from p m join p r on r.burst_id = m.burst_id and r.frame = 0 and r.y = m.y and r.x = m.x group by m.burst_id, m.frame")
_BOX = ("vx0", "vy0", "vx1", "vy1", "px0", "py0", "pw", "ph")
_SIZED = "(select doc_id, cast(coalesce(len(text), 0) % 3000 + 1 as integer) as w, cast(doc_id % 1500 + 1 as integer) as h, cast(doc_id % 11 as integer) as n from documents)"


def _sized(s: SparkSession, d: str) -> DataFrame:
    """Sizes of images and bursts that documents give: lengths of texts and ids."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) % 3000 + 1).cast("int").alias("w"), (F.col("doc_id") % 1500 + 1).cast("int").alias("h"), (F.col("doc_id") % 11).cast("int").alias("n"))


_add("tile_assign", lambda s, d: _sized(s, d).select("doc_id", "w", "h", F.explode(tiling.tile_ids(W(), H(), 512, 16)).alias("t")).select("doc_id", "w", "h", "t.tile_id", *(f"t.{b}" for b in _BOX)), f"""
with t as (
  select doc_id, w, h, a.i as tx, b.i as ty from {_SIZED}, range(8) a(i), range(8) b(i) where a.i * 512 < w and b.i * 512 < h
), v as (select *, tx * 512 as vx0, ty * 512 as vy0, least(w, tx * 512 + 512) as vx1, least(h, ty * 512 + 512) as vy1 from t)
select doc_id, w, h, cast(ty * ((w + 511) // 512) + tx as integer) as tile_id, cast(vx0 as integer) as vx0, cast(vy0 as integer) as vy0, cast(vx1 as integer) as vx1, cast(vy1 as integer) as vy1,
  cast(greatest(0, vx0 - 16) as integer) as px0, cast(greatest(0, vy0 - 16) as integer) as py0, cast(least(w, vx1 + 16) - greatest(0, vx0 - 16) as integer) as pw, cast(least(h, vy1 + 16) - greatest(0, vy0 - 16) as integer) as ph from v""")
_add("tile_stitch", lambda s, d: tiling.stitch(tiling.split(_evt(s, d), 16, 8), 1, ("image_id",)), f"with {_EVT} select * from evt")


def _agree(s: SparkSession, d: str) -> DataFrame:
    whole = metrics.pixels(upscale(_evt(s, d), 2, peak=quantize.COUNT)).select("image_id", "y", "x", F.col("v").alias("a"))
    tiled = upscale_tiled(_evt(s, d), 2, 8, 24, peak=quantize.COUNT).select("image_id", "y", "x", F.col("v").alias("b"))
    return whole.join(tiled, ["image_id", "y", "x"], "full").groupBy("image_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"), F.count("*").alias("n"), F.count("b").alias("matched"))


_add("tile_agreement", _agree, f"with {_EVT} select image_id, cast(0 as integer) as worst, count(*) * 4 as n, count(*) * 4 as matched from evt group by image_id")
_WIDE = f"{_EMB}, {_pages_sql(66, 1, 'wide')}"


def _dispatched(s: SparkSession, d: str) -> DataFrame:
    """Pages of 528 x 8 samples, which are cut, beside planes of 8 x 8, which are not."""
    wide = _page_tiles(s, d, 66, 1, 528).select(F.concat(F.lit("page "), F.col("image_id").cast("string")).alias("image_id"), "c", "w", "h", "v")
    small = _emb(s, d).withColumn("image_id", F.col("image_id").cast("string"))
    return stitch_tiles(enlarged(wide.unionByName(small), 2, floats=True), 2).select("image_id", "y", "x", F.round("v", 5).alias("v"))


_add("upscale_dispatch", _dispatched, f"with {_single_sql(_WIDE, 'wide', 528, 8, 2).replace('done as', 'wide_done as')}, small as ({_ROUNDED.format(_single_sql(_EMB, 'emb', 8, 8, 2))}) select 'page ' || image_id as image_id, y, x, round(v, 5) as v from wide_done union all select cast(image_id as varchar), y, x, v from small")
_add("tile_auto", lambda s, d: _auto_agree(s, d), f"with {_PAGES} select image_id, 0.0::double as worst, count(*) * 4 as n, count(*) * 4 as matched, true as passes_equal from pg group by image_id")


def _auto_agree(s: SparkSession, d: str) -> DataFrame:
    """The adaptive loop over tiles beside that over whole pages: samples that differ most, and whether passes agree."""
    tiles = _page_tiles(s, d)
    parts = tiled.adaptive(tiles, 2, _TILE, floats=True)
    whole = upscale(_page_tiles(s, d, tile=64).select("image_id", "c", "w", "h", "v"), 2, iters="auto", floats=True)
    a = metrics.pixels(whole, keep=("image_id", "iters")).select("image_id", "y", "x", F.col("v").alias("a"), "iters")
    b = mosaic.pixels(parts, _TILE, 2).select("image_id", "y", "x", F.col("v").alias("b"))
    used = parts.groupBy("image_id").agg(F.max("iters").alias("passes"), F.min("iters").alias("least"))
    met = a.join(b, ["image_id", "y", "x"], "full").groupBy("image_id").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"), F.count("*").alias("n"), F.count("b").alias("matched"), F.max("iters").alias("iters"))
    return met.join(used, "image_id").select("image_id", "worst", "n", "matched", ((F.col("iters") == F.col("passes")) & (F.col("passes") == F.col("least"))).alias("passes_equal"))


_add("tile_residual", lambda s, d: worst_residual(upscaled_tiles(_evt(s, d), 2, 8, 24)).select("image_id", (F.col("residual") < 1e-5).alias("ok")), f"with {_single_sql(_EVT, 'evt', 24, 30, 2)}, {_box_rest('evt', 'done', 2, 'rest')} select image_id, sqrt(avg(v * v)) < 1e-5 as ok from rest group by image_id")
def _admission(s: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    return _sized(s, d).select("doc_id", "w", "h", "n", tiling.needs_tiling(W(), H(), 2).alias("tiled"), tiling.admitted(W(), H(), 2).alias("admitted"), tiling.admitted(W(), H(), 8).alias("admitted_8"), tiling.burst_admitted(W(), H(), 2, n).alias("burst"), F.round(tiling.job_budget_ms(W(), H(), 2, n), 4).alias("budget_ms"))


_add("admission", _admission, f"select doc_id, w, h, n, w > 512 or h > 512 or w::bigint * h * 136 > 268435456 as tiled, w::bigint * h * 136 <= 805306368 as admitted, w::bigint * h * 2056 <= 805306368 and greatest(w, h) <= 512 as admitted_8, n between 2 and 8 and greatest(w, h) <= 1024 and w::bigint * h * 208 + n * w::bigint * h * 8 <= 805306368 as burst, round(30000 + (w::bigint * h * 4.0::double + 2 * w::bigint * h * n) / 1000 * 12, 4) as budget_ms from {_SIZED}")
_add("srgb_round_trip", lambda s, d: _pixels(_emb(s, d).withColumn("v", F.transform("v", lambda a: a / 255.0)), F.transform("v", lambda a: color.linear_to_srgb(color.srgb_to_linear(a)) * 255.0)), f"with {_EMB} select * from emb")
_add("srgb_linear", lambda s, d: _pixels(_emb(s, d), F.transform("v", lambda a: color.srgb_to_linear(a / 255.0))), f"with {_EMB} select image_id, y, x, round(case when v <= 0 then 0 when v / 255 <= 0.04045 then v / 255 / 12.92 else pow((v / 255 + 0.055) / 1.055, 2.4) end, 4) as v from emb")


def _ycocg(s: SparkSession, d: str) -> DataFrame:
    """Every sample with the two after it as red, green and blue."""
    px = _emb(s, d).select("image_id", F.posexplode("v").alias("i", "r"), "v")
    r, g, b = F.col("r"), at(V(), (F.col("i") + 1) % 64), at(V(), (F.col("i") + 2) % 64)
    y, co, cg = color.to_ycocg(r, g, b)
    back = color.from_ycocg(y, co, cg)
    return px.select("image_id", "i", y.alias("luma"), co.alias("co"), cg.alias("cg"), back[0].alias("red"), back[1].alias("green"), back[2].alias("blue"))


_add("ycocg", _ycocg, f"with {_EMB}, p as (select image_id, cast(y * 8 + x as integer) as i, v as r, l[cast((y * 8 + x + 1) % 64 + 1 as bigint)] as g, l[cast((y * 8 + x + 2) % 64 + 1 as bigint)] as b from emb join {_lists('emb')} using (image_id)) select image_id, i, 0.25::double * r + 0.5::double * g + 0.25::double * b as luma, 0.5::double * r - 0.5::double * b as co, -0.25::double * r + 0.5::double * g - 0.25::double * b as cg, r as red, g as green, b as blue from p")
_add("psnr_truth", lambda s, d: mapped(_emb(s, d), lambda p: {"x": numeric.upsample(numeric.box_mean(p, 2), 2, Kernel.BILINEAR)}, ["x"]).select("image_id", F.round(metrics.psnr(F.col("x"), V()), 4).alias("psnr")), f"with {_EMB}, half as materialized (select image_id, cast(y // 2 as integer) as y, cast(x // 2 as integer) as x, avg(v) as v from emb group by all), {_up_cte('half', Kernel.BILINEAR, 2, 4, 4, 'u')}, m as (select image_id, avg(pow(u.v - emb.v, 2)) as e from u join emb using (image_id, y, x) group by image_id) select image_id, round(case when e = 0 then 1e9 else 10 * log10(65025.0 / e) end, 4) as psnr from m")
_add("psnr_round_trip", lambda s, d: _up(_emb(s, d)).select("image_id", F.round(metrics.psnr(forward.box_mean(F.col("x"), W() * 2, H() * 2, 2), V()), 4).alias("psnr")), f"with {_U}, m as (select image_id, avg(v * v) as e from r group by image_id) select image_id, round(case when e = 0 then 1e9 else 10 * log10(65025.0 / e) end, 4) as psnr from m")
_add("max_difference", lambda s, d: _emb(s, d).select("image_id", metrics.max_difference(V(), resample.shift(V(), W(), H(), 1.0, 0.0)).alias("worst")), f"with {_EMB} select a.image_id, max(abs(a.v - b.v)) as worst from emb a join emb b on a.image_id = b.image_id and a.y = b.y and b.x = greatest(0, a.x - 1) group by a.image_id")
def _broken(s: SparkSession, d: str) -> DataFrame:
    """The audit of output bytes of which every seventh image has one sample changed: those blocks and no others are found."""
    out = metrics.pixels(upscale(_emb(s, d), 2)).withColumn("v", F.col("v") + F.when((F.col("image_id") % 7 == 0) & (F.col("y") == 5) & (F.col("x") == F.col("image_id") % 16), 1).otherwise(0))
    return metrics.block_audit(out, metrics.pixels(_emb(s, d)), 2).select("image_id", "y", "x", F.col("block_sum").cast("long").alias("block_sum"), F.col("src").cast("double").alias("src"))


_add("block_audit", _broken, f"with {_EMB} select image_id, y, x, cast(4 * v + 1 as bigint) as block_sum, v as src from emb where image_id % 7 = 0 and y = 2 and x = image_id % 16 // 2")
_add("alpha_used", lambda s, d: _emb(s, d).select("image_id", metrics.alpha_used(V()).alias("alpha")), f"with {_EMB} select image_id, bool_or(v < 255) as alpha from emb group by image_id")


def _heat(s: SparkSession, d: str) -> DataFrame:
    df = _up(_emb(s, d)).withColumn("near", resample.repeat(V(), W(), H(), 2))
    level = F.zip_with("x", "near", lambda a, b: color.difference_level([a - b] * 3))
    return _pixels(df, level, W() * 2)


_add("heatmap", _heat, f"with {_EMB}, {_up_cte('emb', Kernel.BICUBIC, 2, 8, 8, 'u')} select u.image_id, u.y, u.x, round(least(255.0, 8 * 3 * abs(u.v - e.v) / 3), 4) as v from u join emb e on e.image_id = u.image_id and e.y = u.y // 2 and e.x = u.x // 2")


def _heat_colors(s: SparkSession, d: str) -> DataFrame:
    """Colours of the differences that ``heatmap`` has."""
    red, green, blue = color.heat(F.floor("v").cast("int"))
    return _heat(s, d).select("image_id", "y", "x", red.alias("red"), green.alias("green"), blue.alias("blue"))


_add("heat_colors", _heat_colors, f"with {_EMB}, {_up_cte('emb', Kernel.BICUBIC, 2, 8, 8, 'u')}, l as (select u.image_id, u.y, u.x, cast(floor(round(least(255.0, 8 * 3 * abs(u.v - e.v) / 3), 4)) as integer) as level from u join emb e on e.image_id = u.image_id and e.y = u.y // 2 and e.x = u.x // 2) select image_id, y, x, cast(case when level < 64 then 0 when level < 128 then (level - 64) * 4 else 255 end as integer) as red, cast(case when level < 64 then level * 4 when level < 128 then 255 else greatest(0, 255 - (level - 128) * 2) end as integer) as green, cast(case when level < 64 then 128 + level * 2 when level < 128 then 255 - (level - 64) * 4 else 0 end as integer) as blue from l")
_add("alpha_over_white", lambda s, d: _pixels(_emb(s, d), F.transform("v", lambda v, i: color.over_white(v, (i * 4).cast("double")))), f"with {_EMB} select image_id, y, x, round(v * ((y * 8 + x) * 4.0::double) / 255 + 255 * (1 - ((y * 8 + x) * 4.0::double) / 255), 4) as v from emb")


# --- files, SQL text, rows


def _written(df: DataFrame, form: str) -> str:
    """The folder of image files of planes, in the folder that executors share."""
    folder = f"{shared_folder(df.sparkSession)}/{form}-{uuid.uuid4()}"
    images.write(df, folder, form)
    return folder


def _file_id() -> Column:
    return F.regexp_extract("image_id", r"([^/]*)\.\w+$", 1).cast("long").alias("image_id")


def _ppm(s: SparkSession, d: str) -> DataFrame:
    """Pages of embeddings as three-channel files, written and read back by lines of tiles."""
    grey = _page_tiles(s, d, tile=64).select("image_id", F.explode(F.array(*map(F.lit, range(3)))).alias("c"), "w", "h", "v")
    folder = _written(grey.withColumn("v", F.transform("v", lambda x: F.greatest(F.lit(0.0), x - F.col("c")))), "ppm")
    tiles = s.read.format("ppm").option("tile", _TILE).load(folder)
    return mosaic.pixels(tiles, _TILE).select(_file_id(), "c", "y", "x", "v")


def _rgba(s: SparkSession, d: str) -> DataFrame:
    """Four vectors in a row as the channels of a picture with alpha, written as PNG files and read back."""
    four = _emb(s, d).select(F.call_function("div", F.col("image_id"), F.lit(4)).alias("image_id"), (F.col("image_id") % 4).cast("int").alias("c"), "w", "h", "v")
    full = four.groupBy("image_id").count().where("count = 4").select("image_id")
    folder = _written(four.join(full, "image_id"), "png")
    return s.read.format("png").load(folder).select(_file_id(), "c", "w", "h", "v")


_RGBA = f"{_EMB}, rgba as materialized (select image_id // 4 as image_id, cast(image_id % 4 as integer) as c, y, x, v from emb where image_id // 4 in (select vec_id // 4 from embeddings where len(embedding) = 64 group by 1 having count(*) = 4))"


def _white(s: SparkSession, d: str) -> DataFrame:
    rgba = _rgba(s, d)
    alpha = rgba.where("c = 3").select("image_id", F.col("v").alias("a"))
    over = rgba.where("c < 3").join(alpha, "image_id").withColumn("v", F.zip_with("v", "a", color.over_white))
    return metrics.pixels(over).withColumn("v", F.round("v", 4))


_add("ppm_tiles", _ppm, f"with {_PAGES} select image_id, cast(c as integer) as c, y, x, greatest(0.0, v - c) as v from pg, range(3) z(c)")
_add("png_rgba", lambda s, d: metrics.pixels(_rgba(s, d)), f"with {_RGBA} select * from rgba")
_add("rgba_over_white", _white, f"with {_RGBA} select p.image_id, p.c, p.y, p.x, round(p.v * a.v / 255 + 255 * (1 - a.v / 255), 4) as v from rgba p join rgba a using (image_id, y, x) where p.c < 3 and a.c = 3")
_add("rgba_alpha", lambda s, d: _rgba(s, d).where("c = 3").select("image_id", metrics.alpha_used(V()).alias("alpha")), f"with {_RGBA} select image_id, bool_or(v < 255) as alpha from rgba where c = 3 group by image_id")
_add("rgba_linear", lambda s, d: metrics.pixels(upscale(_rgba(s, d), 2, working_space="linear", passes=1, floats=True)).withColumn("v", F.round("v", 5)), f"with {_single_sql(_RGBA + ', flat as materialized (select image_id * 4 + c as image_id, y, x, 255 * (case when v <= 0 then 0 when v / 255 <= 0.04045 then v / 255 / 12.92 else pow((v / 255 + 0.055) / 1.055, 2.4) end) as v from rgba)', 'flat', 8, 8, 2, 1)} select image_id // 4 as image_id, cast(image_id % 4 as integer) as c, y, x, round(255 * (case when v <= 0 then 0 when v >= 255 then 1 when v / 255 <= 0.0031308 then 12.92 * v / 255 else 1.055 * pow(v / 255, 1 / 2.4::double) - 0.055 end), 5) as v from done")


def _by_text(s: SparkSession, d: str) -> DataFrame:
    sql.register(s)
    _emb(s, d).createOrReplaceTempView("gridloom_planes")
    return s.sql("""
        WITH big AS (SELECT * FROM gridloom_upscale_floats(TABLE(SELECT CAST(image_id AS STRING) AS image_id, c, w, h, v FROM gridloom_planes), 2))
        SELECT CAST(image_id AS BIGINT) AS image_id, CAST(p.pos DIV w AS INT) AS y, CAST(p.pos % w AS INT) AS x, ROUND(p.col, 5) AS v FROM big, LATERAL posexplode(v) AS p""")


def _measured_by_text(s: SparkSession, d: str) -> DataFrame:
    sql.register(s)
    _up(_emb(s, d)).createOrReplaceTempView("gridloom_big")
    return s.sql("SELECT image_id, ROUND(gridloom_psnr(gridloom_box_mean(x, w * 2, h * 2, 2), v), 4) AS psnr, ROUND(gridloom_max_difference(gridloom_box_mean(x, w * 2, h * 2, 2), v), 4) AS worst FROM gridloom_big")


_add("sql_upscale", _by_text, SQL["upscale_2x"])
_add("sql_measures", _measured_by_text, f"with {_U}, m as (select image_id, avg(v * v) as e, max(abs(v)) as worst from r group by image_id) select image_id, round(case when e = 0 then 1e9 else 10 * log10(65025.0 / e) end, 4) as psnr, round(worst, 4) as worst from m")


def _regression(s: SparkSession, d: str) -> DataFrame:
    """Images that one kernel brings back worse than another by over 0.1 dB."""
    def measured(kernel: Kernel) -> DataFrame:
        return mapped(_emb(s, d), lambda p: {"x": numeric.upsample(numeric.box_mean(p, 2), 2, kernel)}, ["x"]).select("image_id", metrics.psnr(F.col("x"), V()).alias("psnr"))

    return metrics.regressed(measured(Kernel.BILINEAR), measured(Kernel.LANCZOS3)).select("image_id", F.round("psnr", 4).alias("psnr"), F.round("before", 4).alias("before"))


def _psnr_cte(kernel: Kernel, name: str) -> str:
    return f"{_up_cte('half', kernel, 2, 4, 4, f'u{name}')}, {name} as (select image_id, 10 * log10(65025.0 / avg(pow(u{name}.v - emb.v, 2))) as psnr from u{name} join emb using (image_id, y, x) group by image_id)"


_add("regression_gate", _regression, f"with {_EMB}, half as materialized (select image_id, cast(y // 2 as integer) as y, cast(x // 2 as integer) as x, avg(v) as v from emb group by all), {_psnr_cte(Kernel.BILINEAR, 'm')}, {_psnr_cte(Kernel.LANCZOS3, 'b')} select image_id, round(m.psnr, 4) as psnr, round(b.psnr, 4) as before from m join b using (image_id) where m.psnr < b.psnr - 0.1")

_TILED_ROWS = ("image_id", "c", "t")


def _row_passes(s: SparkSession, d: str) -> DataFrame:
    """Four stencils in a chain on rows of padded tiles: mean, Laplacian, mean, L1 gradient."""
    r = rows.rows_of(mosaic.padded(_page_tiles(s, d), _TILE, 8), _TILED_ROWS)
    for work in (rows.mean, rows.laplacian, rows.mean, rows.gradient_l1):
        r = work(r, _TILED_ROWS)
    return rows.valid(r).select("image_id", "y", "x", F.round("v", 4).alias("v"))


def _chain_sql(source: str, w: int, h: int) -> str:
    mean = f"({_SUM}) / 9.0::double"
    steps = [mean, "4 * n11.v - n10.v - n12.v - n01.v - n21.v", mean, "abs(n12.v - n10.v) + abs(n21.v - n01.v)"]
    out, before = [], source
    for k, step in enumerate(steps):
        out.append(f"k{k} as materialized (select a.image_id, a.y, a.x, {step} as v {_cells(before, w, h)})")
        before = f"k{k}"
    return ", ".join(out)


_add("rows_chain", _row_passes, f"with {_PAGES}, {_chain_sql('pg', 64, 32)} select image_id, y, x, round(v, 4) as v from k3")
for _name, _work, _expr in (("min", lambda r, k: rows.extreme(r, k, False), f"least({', '.join(_ALL)})"), ("max", lambda r, k: rows.extreme(r, k, True), f"greatest({', '.join(_ALL)})")):
    _add(f"rows_{_name}", lambda s, d, f=_work: rows.valid(f(rows.rows_of(mosaic.padded(_page_tiles(s, d), _TILE, 8), _TILED_ROWS), _TILED_ROWS)).select("image_id", "y", "x", "v"), f"with {_PAGES} select a.image_id, a.y, a.x, {_expr} as v {_cells('pg', 64, 32)}")
_add("rows_box_mean", lambda s, d: rows.shrunk(rows.rows_of(_evt(s, d)), ("image_id", "c"), 2).select("image_id", "y", F.posexplode("row").alias("x", "v")).withColumn("v", F.round("v", 4)), f"with {_EVT} select image_id, cast(y // 2 as integer) as y, cast(x // 2 as integer) as x, round(avg(v), 4) as v from evt group by image_id, y // 2, x // 2")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding rasters at twice their size: bytes with exact block sums, and the loop's residual."""
    return upscale(_emb(spark, sf_dir), 2).select("image_id", "w", "h", "v", "residual", "iters")
