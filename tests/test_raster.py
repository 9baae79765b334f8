"""Contracts of the raster operators: exact sums, residuals, fixed points, tiles, bursts, both paths."""

import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.kernels import Kernel, phases
from gridloom.operators import descriptors, forward, metrics, mosaic, quantize, regularize, resample, rows
from gridloom import sql
from gridloom.plans import jobs, numeric, reconstruct, tiled
from gridloom.plans.bursts import estimate_shift
from gridloom.operators.tiling import stitch
from gridloom.plans.upscale import enlarged, fuse_burst, upscale, upscale_tiled, worst_residual
from gridloom.sources import datasource, images, rasters

W, H = "w", "h"


def step(n: int, edge: int) -> np.ndarray:
    return np.where(np.arange(n)[None, :] < edge, 0.0, 255.0).repeat(n, 0)[None]


def texture(n: int = 32) -> np.ndarray:
    y, x = np.mgrid[:n, :n]
    return (100 + 50 * np.sin(2 * np.pi * x / 16) + 30 * np.sin(2 * np.pi * x / 7 + 1) + 40 * np.sin(2 * np.pi * y / 24) + np.where(x < n / 2, 0, 30))[None]


def frame(spark, *planes, ids=None):
    rows = [(i if ids is None else ids[i], 0, p.shape[1], p.shape[0], p.reshape(-1).tolist()) for i, p in enumerate(planes)]
    return spark.createDataFrame(rows, "image_id long, c int, w int, h int, v array<double>")


def plane(row, name="v"):
    return np.array(row[name], float)


@pytest.mark.parametrize("kernel", list(Kernel))
def test_kernels_keep_constants(kernel):
    for scale in (2, 3, 4, 8):
        assert all(abs(sum(w for _, w in taps) - 1) < 1e-12 for taps in phases(kernel, scale))
        assert np.abs(numeric.upsample(np.full((1, 5, 3), 77.0), scale, kernel) - 77).max() < 1e-9


def test_overshoot():
    x = step(8, 4)[:, :4]
    assert 0 <= numeric.upsample(x, 2, Kernel.BILINEAR).min() and numeric.upsample(x, 2, Kernel.BILINEAR).max() <= 255
    assert numeric.upsample(x, 2, Kernel.LANCZOS3).max() > 255 and numeric.upsample(x, 2, Kernel.LANCZOS3).min() < 0


def test_step_edge_psnr_and_monotone_residuals():
    truth = step(32, 16)
    y = numeric.box_mean(truth, 2)
    x, history, _ = numeric.reconstruct(y, 2, 4, y.min((1, 2)), y.max((1, 2)))
    psnr = 10 * np.log10(65025 / ((x - truth) ** 2).mean())
    assert abs(psnr - 47.62) < 0.15
    assert all(b <= a + 1e-9 for a, b in zip(history, history[1:])) and history[-1] < 1e-5


@pytest.mark.parametrize("scale", [2, 3, 4])
def test_expressions_match_stacks(spark, scale):
    p = (np.random.default_rng(scale).random((6, 5)) * 255).round()
    row = (
        frame(spark, p)
        .withColumn("up", resample.upsample(F.col("v"), F.col(W), F.col(H), scale, Kernel.LANCZOS3))
        .withColumn("d", descriptors.descriptors(F.col("v"), F.col(W), F.col(H)))
        .withColumn("s", resample.shift(F.col("v"), F.col(W), F.col(H), 0.3, -0.6))
        .withColumn("q", quantize.exact(F.col("up"), F.col("v"), F.col(W), F.col(H), scale))
        .withColumn("o", quantize.exact(F.col("up"), F.col("v"), F.col(W), F.col(H), scale, quantize.Dither.ORDERED))
        .first()
    )
    up = numeric.upsample(p[None], scale, Kernel.LANCZOS3)
    assert np.abs(plane(row, "up") - up.reshape(-1)).max() < 1e-9
    for k, v in numeric.descriptors(p[None]).items():
        assert np.abs(np.array(row["d"][k]) - v.reshape(-1)).max() < 1e-9
    assert np.abs(plane(row, "s") - numeric.shift(p[None], 0.3, -0.6).reshape(-1)).max() < 1e-9
    assert row["q"] == numeric.quantise(up, p[None], scale)[0].reshape(-1).tolist()
    assert row["o"] == numeric.quantise(up, p[None], scale, 1)[0].reshape(-1).tolist()


def test_declared_loop_matches_stacks(spark):
    p = numeric.box_mean(texture(16), 2)[0].round()
    got = reconstruct.reconstruct(frame(spark, p), 2, 2).first()
    x, history, _ = numeric.reconstruct(p[None], 2, 2, p[None].min((1, 2)), p[None].max((1, 2)))
    assert np.abs(plane(got, "x") - x.reshape(-1)).max() < 1e-9
    assert np.allclose(got["residuals"], [h[0] for h in history], atol=1e-9)


@pytest.mark.parametrize("options", [{"scale": 2}, {"scale": 3}, {"scale": 4}, {"scale": 8, "mode": "progressive"}, {"scale": 2, "iters": "auto"}, {"scale": 4, "working_space": "linear"}, {"scale": 2, "dither": 1}])
def test_block_sums_are_exact(spark, options):
    planes = frame(spark, numeric.box_mean(texture(16), 2)[0].round(), np.full((8, 8), 77.0), step(8, 3)[0])
    out = upscale(planes, **options)
    assert metrics.block_audit(metrics.pixels(out), metrics.pixels(planes), options["scale"]).count() == 0
    assert out.where("residual >= 1e-5").count() == 0 and out.count() == 3


@pytest.mark.parametrize("options", [{}, {"iters": "auto"}])
def test_block_sums_of_counts_above_bytes_are_exact(spark, options):
    counts = np.floor(20 * texture(16))[0]
    assert counts.max() > 255
    out = upscale(frame(spark, counts), 2, peak=quantize.COUNT, **options).first()
    got = plane(out).reshape(16, 2, 16, 2).sum((1, 3))
    assert (got == 4 * counts).all() and plane(out).min() >= 0
    tiles = upscale_tiled(frame(spark, counts), 2, 8, 24, peak=quantize.COUNT, **options).collect()
    assert all(r["v"] == plane(out).reshape(32, 32)[r["y"], r["x"]] for r in tiles)


def test_same_bytes_twice_and_in_any_batch(spark):
    a, b = texture(12)[0].round(), step(12, 5)[0]
    both = {r["image_id"]: r["v"] for r in upscale(frame(spark, a, b), 2).collect()}
    assert upscale(frame(spark, a), 2).first()["v"] == both[0]


def test_gated_features_change_nothing():
    x = texture(16)
    assert not numeric.deblock(x, 2, [{"strength": 0.0, "phase_x": 0, "phase_y": 0}], regularize.Deblock()).any()
    assert (numeric.quantise(x, numeric.box_mean(x, 2), 2) == numeric.quantise(x, numeric.box_mean(x, 2), 2, 0)).all()
    assert np.abs(numeric.deblock(x, 1, [{"strength": 1.0, "phase_x": 0, "phase_y": 0}], regularize.Deblock(10.0))).max() <= 0.5


def test_artifact_phase(spark):
    row = rasters.generated(spark, 24, 24, rasters.OFFSET_GRID).select(descriptors.artifact_stats(F.col("v"), F.col(W), F.col(H)).alias("s")).first()["s"]
    assert (row["phase_x"], row["phase_y"], row["present"]) == (3, 5, True)
    y, x = np.mgrid[:32, :32]
    assert numeric.artifact_stats(30 + 180 * (x + y) / 62)["strength"] == 0


def test_exact_sums_of_squares_add_up_in_any_order():
    rng = np.random.default_rng(1)
    r = rng.normal(0, 1, 1000) * 10.0 ** rng.integers(-20, 3, 1000)
    r[:3] = 0.0
    want = sum(Fraction(float(v * v)) for v in r)
    parts = [numeric.limbs(numeric.square_sum(p)) for p in np.split(rng.permutation(r), [10, 11, 700])]
    added = [sum(x) for x in zip(*parts)]
    assert abs(numeric.root_mean(added, 1000) - float(want / 1000) ** 0.5) < 1e-12 and numeric.root_mean(added, 1000) == numeric.exact_rms(r.reshape(1, 10, 100))[0]
    assert numeric.square_sum(np.zeros((2, 2))) == 0 and numeric.square_sum(np.zeros(0)) == 0


def test_statistics_of_tiles_are_those_of_the_whole(spark):
    rng = np.random.default_rng(8)
    y, x = np.mgrid[:40, :56]
    shapes = [np.clip(np.rint(np.floor(x / 8) * 9 + np.floor((y + 3) / 8) * 7 + (x * y) % 5), 0, 255), rng.integers(0, 256, (33, 50)).astype(float), np.full((24, 24), 7.0), rng.integers(0, 9, (1, 40)).astype(float), rng.integers(0, 9, (2, 2)).astype(float), step(32, 16)[0]]
    planes = frame(spark, *shapes)
    want = {r["image_id"]: (r["lo"], r["hi"], r["s"]) for r in planes.select("image_id", F.array_min("v").alias("lo"), F.array_max("v").alias("hi"), descriptors.artifact_stats(F.col("v"), F.col(W), F.col(H)).alias("s")).collect()}
    for tile in (1, 5, 16, 64):
        tiles = mosaic.cut(planes, tile)
        assert {r["image_id"]: (r["lo"], r["hi"], r["stats"]) for r in mosaic.merged_stats(tiles, tile).collect()} == want
    back = {(r["image_id"], r["y"], r["x"]): r["v"] for r in mosaic.pixels(mosaic.cut(planes, 7), 7).collect()}
    assert back == {(r["image_id"], r["y"], r["x"]): r["v"] for r in metrics.pixels(planes).collect()}
    sized = metrics.pixels(planes, keep=("image_id", "c", "w", "h"))
    assert sorted(mosaic.gathered(sized, 7).select(*mosaic.KEYS, "v").collect()) == sorted(mosaic.cut(planes, 7).select(*mosaic.KEYS, "v").collect())


@pytest.mark.parametrize("tile, halo", [(16, 8), (8, 24), (5, 7), (16, 0)])
def test_halos_are_what_lies_around(spark, tile, halo):
    p = np.arange(33 * 21, dtype=float).reshape(33, 21)
    rows = mosaic.padded(mosaic.cut(frame(spark, p), tile), tile, halo).collect()
    assert len(rows) == -(-33 // tile) * -(-21 // tile)
    for r in rows:
        t = r["t"]
        x0, y0, x1, y1 = max(0, t["vx0"] - halo), max(0, t["vy0"] - halo), min(21, t["vx1"] + halo), min(33, t["vy1"] + halo)
        assert (t["px0"], t["py0"], t["pw"], t["ph"]) == (x0, y0, x1 - x0, y1 - y0) == (t["px0"], t["py0"], r["w"], r["h"])
        assert (np.array(r["v"]).reshape(r["h"], r["w"]) == p[y0:y1, x0:x1]).all()


def test_an_image_that_no_row_holds_is_enlarged(spark):
    """Tiles are made, padded, enlarged and audited as tiles: no row of any stage has more samples than a tile with its halo."""
    w, h, tile = 1500, 1100, 128
    tiles = mosaic.generated(spark, w, h, lambda y, x, w, h: (x * 7 + y * 13 + F.floor(x / 40) * F.floor(y / 56)) % 251, tile)
    assert tiles.agg(F.max(F.size("v"))).first()[0] == tile * tile
    assert mosaic.padded(tiles, tile, 24).agg(F.max(F.size("v"))).first()[0] == (tile + 48) ** 2
    out = tiled.enlarged_tiles(tiles, 2, tile).cache()
    assert out.agg(F.max(F.size("v")), F.sum(F.size("v"))).first()[:] == (4 * tile * tile, 4 * w * h)
    big = out.select(*mosaic.KEYS, (F.least(F.lit(w) - F.col("tx") * tile, F.lit(tile)) * 2).alias("s"), F.posexplode("v").alias("i", "v"))
    sums = big.groupBy(*mosaic.KEYS, F.expr("i div s div 2 * (s div 2) + i % s div 2").alias("i")).agg(F.sum("v").alias("n"))
    source = tiles.select(*mosaic.KEYS, F.posexplode("v").alias("i", "v"))
    assert sums.join(source, [*mosaic.KEYS, "i"]).where(F.col("n") == 4 * F.col("v")).count() == w * h


def test_tiles_equal_the_whole(spark):
    y, x = np.mgrid[:40, :56]
    blocky = np.floor(x / 8) * 9 + np.floor((y + 3) / 8) * 7 + (x * y) % 5
    planes = frame(spark, blocky, texture(40)[0].round())
    whole = metrics.pixels(upscale(planes, 2)).collect()
    tiled = upscale_tiled(planes, 2, 16, 24).collect()
    key = lambda r: (r["image_id"], r["y"], r["x"])
    assert {key(r): r["v"] for r in whole} == {key(r): r["v"] for r in tiled}


@pytest.mark.parametrize("options", [{}, {"working_space": "linear"}, {"dither": 1}, {"passes": 1}, {"deblocking": None}])
def test_tiles_equal_the_whole_for_every_option(spark, options):
    y, x = np.mgrid[:40, :56]
    p = np.clip(np.rint(texture(56)[0, :40, :56] + 40 * ((x // 8 + y // 8) % 2)), 0, 255)[None]
    whole = plane(upscale(frame(spark, *p), 2, **options).first()).reshape(80, 112)
    tiled = np.full((80, 112), -1.0)
    for r in upscale_tiled(frame(spark, *p), 2, 16, 24, **options).collect():
        tiled[r["y"], r["x"]] = r["v"]
    assert (whole == tiled).all()


@pytest.mark.parametrize("scale", [2, 3])
def test_adaptive_tiles_stop_where_the_whole_image_does(spark, scale):
    y, x = np.mgrid[:40, :56]
    planes = frame(spark, np.clip(np.rint(texture(56)[0, :40, :56]), 0, 255), np.full((24, 24), 77.0), step(32, 16)[0], ((x * 7 + y * 13) % 251).astype(float))
    for floats in (True, False):
        want = {r["image_id"]: r for r in upscale(planes, scale, iters="auto", floats=floats).collect()}
        out = tiled.adaptive(mosaic.cut(planes, 16), scale, 16, floats=floats)
        got = {i: np.full((r["h"], r["w"]), -1.0) for i, r in want.items()}
        for r in mosaic.pixels(out, 16, scale).collect():
            got[r["image_id"]][r["y"], r["x"]] = r["v"]
        assert all((got[i].reshape(-1) == plane(r)).all() for i, r in want.items())
        assert {(r[0], r[1], r[2]) for r in out.select("image_id", "iters", "residual").collect()} == {(i, r["iters"], r["residual"]) for i, r in want.items()}
    assert {r["iters"] for r in want.values()} > {2}
    whole = {(r["image_id"], r["y"], r["x"]): r["v"] for r in metrics.pixels(upscale(planes, scale, iters="auto")).collect()}
    assert {(r["image_id"], r["y"], r["x"]): r["v"] for r in upscale_tiled(planes, scale, 16, 24, iters="auto").collect()} == whole
    assert tiled.adaptive(mosaic.cut(planes.limit(0), 16), scale, 16).count() == 0


def test_adaptive_planes_are_those_of_as_many_passes(spark):
    df = frame(spark, *texture(), *step(32, 16))
    got = {r["image_id"]: r for r in upscale(df, 2, iters="auto", floats=True).collect()}
    assert all(2 <= r["iters"] <= 8 and r["residual"] < 1e-5 for r in got.values())
    for i, r in got.items():
        fixed = upscale(df.where(f"image_id = {i}"), 2, passes=r["iters"], deblocking=None, floats=True).first()
        assert np.abs(plane(fixed) - plane(r)).max() < 1e-9


def test_given_ranges_are_in_bytes_for_light_too(spark):
    df = frame(spark, *np.rint(texture()))
    own = df.select("image_id", "c", F.array_min("v").alias("lo"), F.array_max("v").alias("hi"))
    assert plane(upscale(df, 2, working_space="linear").first()).tolist() == plane(upscale(df, 2, clamp=own, working_space="linear").first()).tolist()


def test_large_planes_are_tiled_and_others_not(spark):
    small, large = np.rint(texture()), np.tile(step(16, 9)[0], (1, 33))[None]
    df = frame(spark, *small, *large)
    out = enlarged(df, 2)
    assert {r["image_id"]: r["n"] for r in out.groupBy("image_id").agg(F.count("*").alias("n")).collect()} == {0: 1, 1: 2}
    assert {r["image_id"]: r["residual"] < 1e-5 for r in worst_residual(out).collect()} == {0: True, 1: True}
    for i, p in enumerate((small, large)):
        h, w = p.shape[1] * 2, p.shape[2] * 2
        got = np.zeros((h, w))
        for r in stitch(out.where(F.col("image_id") == i), 2).collect():
            got[r["y"], r["x"]] = r["v"]
        assert (got == plane(upscale(df.where(F.col("image_id") == i), 2).first()).reshape(h, w)).all()


def test_golden_step(spark):
    truth = step(32, 16)
    low = numeric.box_mean(truth, 2)
    x, *_ = numeric.reconstruct(low, 2, 4, low.min((1, 2)), low.max((1, 2)))
    psnr = 10 * np.log10(65025 / ((x - truth) ** 2).mean())
    assert abs(psnr - 47.62) < 0.15
    x, *_ = numeric.reconstruct(low, 2, 7, low.min((1, 2)), low.max((1, 2)))  # what an automatic step may take
    psnr = 10 * np.log10(65025 / ((x - truth) ** 2).mean())
    assert abs(psnr - 65.68) < 0.15


def test_a_burst_has_its_reference_once_and_a_bounded_side(spark):
    rows = [(1, f, 0, 8, 8, texture()[0, :8, :8].reshape(-1).tolist()) for f in (1, 2)]
    with pytest.raises(Exception, match="frame 0"):
        fuse_burst(spark.createDataFrame(rows, "burst_id long, frame int, c int, w int, h int, v array<double>"), 2).collect()
    long = [(1, f, 0, 1025, 1, [1.0] * 1025) for f in (0, 1)]
    with pytest.raises(Exception, match="1024"):
        fuse_burst(spark.createDataFrame(long, "burst_id long, frame int, c int, w int, h int, v array<double>"), 2).collect()


def test_shift_is_found():
    a = texture(32)
    dx, dy, sure = estimate_shift(a[0], numeric.shift(a, 0.5, 0.0)[0])
    assert abs(dx - 0.5) < 1e-9 and abs(dy) < 1e-9 and sure > 0


def test_burst_contracts(spark):
    p = step(4, 2)[0]
    rows = [(1, k, 0, 4, 4, p.reshape(-1).tolist()) for k in range(2)]
    frames = spark.createDataFrame(rows, "burst_id long, frame int, c int, w int, h int, v array<double>")
    assert fuse_burst(frames, 2).first()["v"] == upscale(frame(spark, p), 2, deblocking=None).first()["v"]
    stripes = np.where((np.arange(64) >> 2) & 1, 0.0, 255.0)[None].repeat(64, 0)
    near = np.stack([stripes, np.roll(stripes, 1, 1)])
    low = numeric.box_mean(near, 2)
    got = fuse_burst(spark.createDataFrame([(2, k, 0, 32, 32, p.reshape(-1).tolist()) for k, p in enumerate(low)], frames.schema), 2).first()
    assert [t["kept"] for t in got["shifts"]] == [True, False] and got["residual"] < 1e-5
    with pytest.raises(Exception, match="not finite"):
        fuse_burst(frames, 2, shifts=spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, float("nan"), 0.0)], "burst_id long, frame int, dx double, dy double")).collect()


def test_bursts_are_relations_of_frames(spark):
    rng = np.random.default_rng(4)
    base = numeric.upsample(rng.integers(0, 256, (1, 6, 7)).astype(float), 2, Kernel.LANCZOS3)
    rows = []
    for b, (h, w) in enumerate(((12, 14), (12, 14), (9, 11))):
        for k in range(1 + b):
            p = numeric.shift(base[:, :h, :w], 0.5 * k, -0.25 * k)[0]
            rows += [(b if b else None, k, c, w, h, np.clip(np.rint(p + c), 0, 255).reshape(-1).tolist()) for c in range(2)]
    frames = spark.createDataFrame(rows, "burst_id long, frame int, c int, w int, h int, v array<double>").repartition(3)
    out = fuse_burst(frames, 2, floats=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "CoGroup" not in plan
    got = {(r["burst_id"], r["c"]): r for r in out.collect()}
    assert set(got) == {(b, c) for b in (None, 1, 2) for c in range(2)}
    ref = np.array(rows[0][5]).reshape(1, 12, 14)
    x = numeric.upsample(ref, 2, Kernel.LANCZOS3)
    for _ in range(4):
        x = np.clip(x + numeric.upsample(ref - numeric.box_mean(x, 2), 2, Kernel.BILINEAR), ref.min(), ref.max())
        x = x + numeric.blocks(ref - numeric.box_mean(x, 2), 2)
    assert np.abs(plane(got[None, 0]) - x.reshape(-1)).max() < 1e-9
    assert all(len(r["shifts"]) == (b or 0) + 1 and r["residual"] < 1e-5 and r["shifts"][0]["kept"] for (b, c), r in got.items())
    x, dx, dy = rng.random((5, 7, 6)), rng.uniform(-2, 2, 5), rng.uniform(-2, 2, 5)
    assert np.abs(numeric.shift_each(x, dx, dy) - np.concatenate([numeric.shift(x[k : k + 1], dx[k], dy[k]) for k in range(5)])).max() < 1e-12
    large = spark.createDataFrame([(1, k, 0, 1024, 1, [1.0] * 1024) for k in range(9)], frames.schema)
    with pytest.raises(Exception, match="too many"):
        fuse_burst(large, 2).collect()
    assert fuse_burst(frames.limit(0), 2).count() == 0


def test_bad_arguments(spark):
    planes = frame(spark, step(4, 2)[0])
    for bad in ({"scale": 5}, {"scale": 8}, {"scale": 2, "passes": -1}, {"scale": 2, "dither": 99}, {"scale": 2, "mode": "other"}, {"scale": 4, "iters": "auto"}):
        with pytest.raises(ValueError):
            upscale(planes, **bad)
    with pytest.raises(Exception, match="clamp range"):
        upscale(planes, 2, clamp=spark.createDataFrame([(0, 0, 5.0, 1.0)], "image_id long, c int, lo double, hi double")).collect()
    with pytest.raises(Exception, match="null or not finite"):
        upscale(planes.withColumn("v", F.transform("v", lambda x: F.lit(float("nan")))), 2).collect()
    with pytest.raises(Exception, match="does not divide"):
        planes.select(forward.box_mean(F.col("v"), F.col(W), F.col(H), 3)).collect()
    assert upscale(planes.limit(0), 2).count() == 0


def test_clamp_has_one_range_a_plane(spark):
    planes = frame(spark, texture(8)[0], texture(9)[0])
    ranges = [(0, 0, 90.0, 110.0), (1, 0, 0.0, 255.0)]
    table = lambda rows: spark.createDataFrame(rows, "image_id long, c int, lo double, hi double")
    assert sorted(r[0] for r in upscale(planes, 2, clamp=table(ranges)).select("image_id").collect()) == [0, 1]
    with pytest.raises(Exception, match="no clamp range"):
        upscale(planes, 2, clamp=table(ranges[:1])).collect()
    with pytest.raises(Exception, match="several clamp ranges"):
        upscale(planes, 2, clamp=table([*ranges, ranges[0]])).collect()


def test_image_files(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (5, 7, 3), np.uint8)
    assert (images.decode_ppm(images.encode_ppm(image)) == image).all() and (images.decode_bmp(images.encode_bmp(image)) == image).all()
    with pytest.raises(ValueError):
        images.decode_ppm(b"P6\n# note\n2 2\n65535\n" + bytes(24))
    (tmp_path / "a.ppm").write_bytes(images.encode_ppm(image))
    planes = images.read(spark, str(tmp_path))
    back = np.stack([plane(r) for r in planes.orderBy("c").collect()], 1).reshape(5, 7, 3)
    assert (back == image).all()
    images.write(planes.withColumn("v", F.transform("v", lambda x: x.cast("int"))), str(tmp_path / "out"), "bmp")
    assert (images.decode_bmp((tmp_path / "out" / "a.bmp").read_bytes()) == image).all()
    assert images.deinterleaved(images.interleaved(planes), 3).orderBy("c").select("v").collect() == planes.orderBy("c").select("v").collect()


def test_png_is_lossless():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:23, :31]
    smooth = np.stack([(x * 8) % 256, (y * 11) % 256, (x + y) * 4 % 256, 255 - x], 2).astype(np.uint8)
    for n in (1, 2, 3, 4):
        for image in (smooth[:, :, :n], rng.integers(0, 256, (9, 14, n), np.uint8), np.zeros((1, 1, n), np.uint8), np.full((5, 3, n), 200, np.uint8)):
            assert (images.decode_png(images.encode_png(image)) == image).all()
    raw = images.encode_png(smooth)
    assert len(raw) < len(smooth.tobytes()) / 4
    used = {zlib.decompress(raw[raw.index(b"IDAT") + 4 : raw.index(b"IEND") - 8])[k * (31 * 4 + 1)] for k in range(23)}
    assert len(used) > 1  # rows choose their filters
    for way in range(5):  # every filter is undone, whatever encoders choose
        rows, up = smooth[:, :, :3], np.zeros((31, 3), np.uint8)
        for row in rows:
            left = np.concatenate([np.zeros((1, 3), np.uint8), row[:-1]])
            corner = np.concatenate([np.zeros((1, 3), np.uint8), up[:-1]])
            guess = [0, left, up, ((left.astype(int) + up) // 2).astype(np.uint8), images._paeth(left, up, corner)][way]
            assert (images._unfiltered(way, row - np.uint8(0) if way == 0 else row - guess, up, 3) == row).all()
            up = row
    palette = images._SIGNATURE + images._chunk(b"IHDR", bytes((0, 0, 0, 2, 0, 0, 0, 1, 8, 3, 0, 0, 0))) + images._chunk(b"PLTE", bytes((1, 2, 3, 4, 5, 6))) + images._chunk(b"tRNS", bytes((9,))) + images._chunk(b"IDAT", zlib.compress(bytes((0, 1, 0)))) + images._chunk(b"IEND", b"")
    assert images.decode_png(palette).tolist() == [[[4, 5, 6, 255], [1, 2, 3, 9]]]
    for bad in (raw[:-20], raw[:60] + b"x" + raw[61:], b"P6", raw.replace(b"\x08\x06", b"\x10\x06", 1)):
        with pytest.raises((ValueError, KeyError)):
            images.decode_png(bad)
    assert images.over_white(np.array([[[10, 20, 30, 0], [10, 20, 30, 255]]], np.uint8)).tolist() == [[[255] * 3, [10, 20, 30]]]


def test_data_sources(spark, tmp_path):
    datasource.register(spark)
    rng = np.random.default_rng(6)
    rows = [(f"i{k}", c, 5 + k, 7, rng.integers(0, 256, 7 * (5 + k)).astype(float).tolist()) for k in range(6) for c in range(4 if k % 2 else 3)]
    planes = spark.createDataFrame(rows, datasource.PLANES).repartition(4)
    want = sorted((i, c, v) for i, c, _, _, v in rows)
    images.write(planes, str(tmp_path / "png"), "png")
    name = F.regexp_extract("image_id", r"([^/]*)\.\w+$", 1).alias("i")
    back = spark.read.format("png").load(str(tmp_path / "png")).select(name, "c", "v").collect()
    assert sorted((r[0], r[1], r[2]) for r in back) == want
    assert sorted((r[0], r[1], r[2]) for r in images.read(spark, str(tmp_path / "png")).select(name, "c", "v").collect()) == want
    opaque = planes.where("image_id in ('i0', 'i2', 'i4')")
    images.write(opaque, f"file://{tmp_path}/ppm", "ppm")
    images.write(planes, str(tmp_path / "bmp"), "bmp")
    ppm = spark.read.format("ppm").load(str(tmp_path / "ppm"))
    assert sorted((r[0], r[1], r[2]) for r in ppm.select(name, "c", "v").collect()) == [w for w in want if w[0] in ("i0", "i2", "i4")]
    white = [r["v"] for r in spark.read.format("bmp").load(str(tmp_path / "bmp")).where("image_id like '%i1.bmp' and c = 0").collect()][0]
    a, v = (np.array(next(r[4] for r in rows if r[0] == "i1" and r[1] == c)) for c in (3, 0))
    assert white == np.floor(v * a / 255 + 255 * (1 - a / 255) + 0.5).tolist()
    # Tiles come line by line of tiles, from only the bytes that they need.
    tiles = spark.read.format("ppm").option("tile", 4).load(str(tmp_path / "ppm"))
    assert tiles.rdd.getNumPartitions() == 3 * 2 and tiles.columns == [*mosaic.KEYS, "w", "h", "v"]
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in mosaic.pixels(tiles, 4).collect()) == sorted((r[0], r[1], r[2], r[3], r[4]) for r in metrics.pixels(ppm).collect())
    # A task that fails leaves no file, nor the others of its job.
    bad = opaque.unionByName(planes.where("image_id = 'i1' and c < 3").withColumn("v", F.transform("v", lambda x: x + 999)))
    with pytest.raises(Exception, match="no bytes"):
        images.write(bad, str(tmp_path / "none"), "ppm")
    assert not (tmp_path / "none").exists() or not [p for p in (tmp_path / "none").rglob("*")]
    with pytest.raises(Exception, match="channels"):
        images.write(planes.where("c < 2"), str(tmp_path / "two"), "png")
    with pytest.raises(Exception, match="ends early|no 8-bit"):
        (tmp_path / "short.ppm").write_bytes(b"P6 9 9 255\n123")
        spark.read.format("ppm").option("tile", 4).load(str(tmp_path / "short.ppm")).collect()


def test_light_of_four_channels(spark, tmp_path):
    """A picture with alpha goes from a PNG file through linear light and back, each channel as a plane of its own, alpha too."""
    y, x = np.mgrid[:12, :16]
    image = np.stack([x * 15, y * 20, (x + y) * 8, 255 - x * 10], 2).astype(np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.encode_png(image))
    planes = images.read(spark, str(tmp_path / "in"))
    out = upscale(planes, 2, working_space="linear")
    images.write(out.select("image_id", "c", "w", "h", "v"), str(tmp_path / "out"), "png")
    big = images.decode_png((tmp_path / "out" / "a.png").read_bytes()).astype(int)
    assert big.shape == (24, 32, 4) and (big.reshape(12, 2, 16, 2, 4).sum((1, 3)) == 4 * image.astype(int)).all()
    assert (big[:, :, 3].reshape(-1) == upscale(planes.where("c = 3"), 2, working_space="linear").first()["v"]).all()


def test_large_image_files_stay_whole(spark, tmp_path):
    from gridloom import cli

    image = np.random.default_rng(2).integers(0, 256, (6, 2100, 3), np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "wide.ppm").write_bytes(images.encode_ppm(image))
    (tmp_path / "in" / "small.ppm").write_bytes(images.encode_ppm(image[:, :9]))
    assert {(r[0], r[1]) for r in images.read(spark, str(tmp_path / "in")).select("w", "h").collect()} == {(2100, 6), (9, 6)}
    assert images.read(spark, str(tmp_path / "in"), side=images.DECODE_SIDE).agg(F.max("w")).first()[0] == images.DECODE_SIDE
    assert cli.main(["upscale", str(tmp_path / "in"), "2", str(tmp_path / "out")]) == 0
    for name, source in (("wide", image), ("small", image[:, :9])):
        got = images.decode_ppm((tmp_path / "out" / f"{name}-2x.ppm").read_bytes()).astype(int)
        h, w, _ = source.shape
        assert got.shape == (2 * h, 2 * w, 3)
        assert (got.reshape(h, 2, w, 2, 3).sum((1, 3)) == 4 * source.astype(int)).all()


def test_pixels_and_planes(spark):
    planes = frame(spark, texture(6)[0])
    assert metrics.planes(metrics.pixels(planes)).select("v").first() == planes.select("v").first()
    with pytest.raises(Exception, match="null or not finite"):
        metrics.planes(metrics.pixels(planes).withColumn("v", F.lit(None).cast("double"))).collect()


def test_stencils_do_not_shuffle(spark):
    planes = frame(spark, texture(6)[0]).withColumn("e", descriptors.gradient_l1(F.col("v"), F.col(W), F.col(H)))
    assert "Exchange" not in planes._jdf.queryExecution().executedPlan().toString()


def test_row_stencils_take_one_exchange(spark):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 256, (2, 11, 9)).astype(float)
    keys = ("image_id", "c")
    r = rows.rows_of(frame(spark, *p))
    for work in (rows.mean, rows.laplacian, rows.mean, rows.laplacian):
        r = work(r, keys)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and len(re.findall(r"\bSort \[", plan)) == 1 and plan.count("+- Window") + plan.count("Window [") >= 4
    cells = lambda x: sum(numeric._cells(x)) / 9.0
    want = numeric.laplacian(cells(numeric.laplacian(cells(p))))
    for row in r.collect():
        assert np.abs(np.array(row["row"]) - want[row["image_id"], row["y"]]).max() < 1e-9
    one = rows.rows_of(frame(spark, np.array([[3.0, 5.0]])))
    assert rows.extreme(one, keys, True).first()["row"] == [5.0, 5.0] and rows.gradient_l1(one, keys).first()["row"] == [2.0, 2.0]


def test_large_planes_are_refused_unless_tiled(spark):
    wide = spark.createDataFrame([(1, 0, 513, 2, [1.0] * 1026)], "image_id long, c int, w int, h int, v array<double>")
    with pytest.raises(Exception, match="admission"):
        upscale(wide, 8, mode="progressive").collect()
    with pytest.raises(Exception, match="admission"):
        enlarged(wide, 8).collect()
    assert upscale(wide, 8, mode="progressive", limits=False).count() == 1 and enlarged(wide, 2).count() == 2
    huge = wide.select("image_id", "c", F.lit(4000).alias("w"), F.lit(1500).alias("h"), F.expr("transform(sequence(1, 6000000), x -> 0D)").alias("v"))
    with pytest.raises(Exception, match="admission"):
        upscale(huge, 2).select("w").collect()


def test_sql_text(spark):
    sql.register(spark)
    planes = frame(spark, np.rint(texture(12))[0], step(12, 5)[0], np.full((3, 4), 9.0))
    planes.createOrReplaceTempView("some_planes")
    for scale, mode in ((2, "direct"), (3, "direct"), (8, "progressive")):
        got = spark.sql(f"SELECT * FROM gridloom_upscale(TABLE(SELECT CAST(image_id AS STRING) AS image_id, c, w, h, v FROM some_planes), {scale})").collect()
        want = upscale(planes, scale, mode=mode).collect()
        assert sorted((r["image_id"], r["w"], r["v"], r["residual"], r["iters"]) for r in got) == sorted((str(r["image_id"]), r["w"], r["v"], r["residual"], r["iters"]) for r in want)
    for bad in ("TABLE(SELECT 'a' AS image_id, 0 AS c, 2 AS w, 2 AS h, array(1D) AS v), 2", "TABLE(SELECT 'a' AS image_id, 0 AS c, 1 AS w, 1 AS h, array(double('NaN')) AS v), 2", "TABLE(SELECT 'a' AS image_id, 0 AS c, 1 AS w, 1 AS h, array(1D) AS v), 5"):
        with pytest.raises(Exception, match="finite|scale"):
            spark.sql(f"SELECT * FROM gridloom_upscale({bad})").collect()
    one = spark.sql("SELECT gridloom_psnr(array(1D, 2D), array(1D, 2D)) AS a, gridloom_psnr(array(0D), array(255D)) AS b, gridloom_to_srgb(gridloom_to_linear(0.5D)) AS c, gridloom_over_white(10D, 0D) AS d").first()
    assert one["a"] == 1e9 and abs(one["b"]) < 1e-9 and abs(one["c"] - 0.5) < 1e-9 and one["d"] == 255


def test_work_is_called_off(spark):
    import threading
    import time

    told = []

    def work():
        with jobs.tagged(spark, "gridloom-test"):
            try:
                spark.range(4).repartition(2).mapInArrow(lambda batches: (time.sleep(30) or b for b in batches), "id long").collect()
            except Exception as e:
                told.append(type(e).__name__)

    thread = threading.Thread(target=work)
    thread.start()
    began = time.time()
    while thread.is_alive() and time.time() - began < 25:
        jobs.cancel(spark, "gridloom-test")
        time.sleep(0.3)
    thread.join(20)
    assert told and time.time() - began < 28 and spark.range(3).count() == 3


def test_burst_command(spark, tmp_path):
    from gridloom import cli

    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (10, 12, 3), np.uint8)
    frames = [tmp_path / f"f{k}.ppm" for k in range(3)]
    for f in frames:
        f.write_bytes(images.encode_ppm(image))
    assert cli.main(["burst", str(tmp_path / "out" / "fused.ppm"), "2", *map(str, frames)]) == 0
    got = images.decode_ppm((tmp_path / "out" / "fused-2x.ppm").read_bytes()).astype(int)
    assert got.shape == (20, 24, 3) and (got.reshape(10, 2, 12, 2, 3).sum((1, 3)) == 4 * image.astype(int)).all()
    assert cli.main(["burst"]) == 2
    frames[2].write_bytes(images.encode_ppm(image[:9]))
    with pytest.raises(Exception, match="differ in size"):
        cli.main(["burst", str(tmp_path / "out" / "other.ppm"), "2", *map(str, frames)])


def test_regression_gate():
    assert metrics.regressions({"a": 40.0, "b": 30.0, "new": 1.0}, {"a": 40.05, "b": 30.2}) == ["b"]


def test_regression_gate_of_tables(spark):
    table = lambda data: spark.createDataFrame(list(data.items()), "image_id string, psnr double")
    assert metrics.regressed(table({"a": 40.0, "b": 30.0, "new": 1.0}), table({"a": 40.05, "b": 30.2, "gone": 9.0})).collect() == [("b", 30.0, 30.2)]


def test_stream(spark, tmp_path):
    from gridloom.streaming.images import arriving, enlarged

    planes = frame(spark, step(4, 2)[0])
    planes.write.parquet(str(tmp_path / "in"))
    query = enlarged(arriving(spark, str(tmp_path / "in"), planes.schema), 2).writeStream.format("memory").queryName("enlarged").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("enlarged").first()["v"] == upscale(planes, 2).first()["v"]


def test_bursts_from_a_stream(spark, tmp_path):
    """Frames of three bursts in four runs from one checkpoint: bursts close when complete or after their time, late and doubled frames are told."""
    import time

    from gridloom.streaming import bursts

    rng = np.random.default_rng(1)
    rows = [(f"b{b}", k, c, 6, 6, rng.integers(0, 256, 36).astype(float).tolist(), 3) for b in range(3) for k in range(3) for c in range(2)]
    schema = "burst_id string, frame int, c int, w int, h int, v array<double>, n_frames int"
    add = lambda some: spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(wait_ms):
        # Timers keep a query going, so that it is stopped once it has read what is there.
        stream = bursts.collected(bursts.arriving(spark, str(tmp_path / "in")), wait_ms)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start(str(tmp_path / "out"))
        began = time.time()
        while time.time() - began < 60 and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.5)
        query.stop()

    collected = lambda: spark.read.parquet(str(tmp_path / "out"))
    told = lambda late: sorted((r["burst_id"], r["c"], r["frame"]) for r in collected().where(F.col("late") == late).collect())
    out = lambda: {(r["burst_id"], r["c"]): r["v"] for r in fuse_burst(collected().where("not late"), 2).collect()}
    add([r for r in rows if r[1] < 2] + [rows[0]])
    run(600_000)
    assert not told(False) and told(True) == [("b0", 0, 0)]
    add([r for r in rows if r[1] == 2 and r[0] != "b2"])
    run(600_000)  # state comes back from the checkpoint
    want = {(r["burst_id"], r["c"]): r["v"] for r in fuse_burst(spark.createDataFrame(rows, schema).drop("n_frames"), 2).collect()}
    assert out() == {k: v for k, v in want.items() if k[0] != "b2"}
    add([rows[2]])
    run(600_000)
    assert told(True) == [("b0", 0, 0), ("b0", 0, 1)] and len(out()) == 4
    add([rows[0]])
    run(1)
    add([(f"x{k}", 0, 0, 2, 2, [1.0, 2.0, 3.0, 4.0], 2) for k in range(2)])
    run(1)  # their second frames never come
    add([("y", 0, 0, 2, 2, [1.0, 2.0, 3.0, 4.0], 1)])
    run(1)
    assert {("x0", 0, 0), ("x1", 0, 0), ("y", 0, 0)} < set(told(False))


@pytest.mark.parametrize("options", [{}, {"tile": "8"}])
def test_small_files_share_partitions(tmp_path, options):
    image = np.random.default_rng(4).integers(0, 256, (12, 9, 3)).astype(np.uint8)
    for k in range(1000):
        (tmp_path / f"{k}.ppm").write_bytes(images.encode_ppm(image + np.uint8(k % 5)))
    reader = datasource.Reader("ppm", {"path": str(tmp_path)} | options)
    parts = reader.partitions()
    assert len(parts) < 100 and sorted(n for p in parts for n in p.names) == sorted(str(tmp_path / f"{k}.ppm") for k in range(1000))
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 3 * 1000 * (4 if options else 1)
    assert all(sum(r["v"]) == (image + np.uint8(int(re.search(r"(\d+)\.ppm", r["image_id"])[1]) % 5))[8 * r.get("ty", 0) :, 8 * r.get("tx", 0) :, r["c"]][: 8 if options else None, : 8 if options else None].astype(float).sum() for r in rows)


def test_stacks_and_partitions_are_bounded(spark):
    import pyarrow as pa

    from gridloom.plans.stacks import STACK_SAMPLES
    from gridloom.plans.upscale import sliced

    whole = pa.RecordBatch.from_pydict({"w": pa.array([64] * 1000, pa.int32()), "h": pa.array([32] * 1000, pa.int32())})
    parts = list(sliced(whole, 3))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) * 64 * 32 * 9 <= STACK_SAMPLES
    assert rasters.spread(spark.range(50_000)).rdd.getNumPartitions() >= 50_000 // rasters.ROWS
