"""Terrain operators against numpy versions of the same definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.model import Grid
from lodestar.operators import raster, terrain


def frame(spark, z):
    rows = [(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i, j in np.ndindex(z.shape)]
    return spark.createDataFrame(rows, "row long, col long, value double")


def grid_of(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", value).collect():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return out


def dinf(z):
    """Flow in shares, cell by cell in order of height."""
    h, w = z.shape
    flow = np.where(np.isnan(z), np.nan, 1.0)
    for i, j in sorted(((i, j) for i, j in np.ndindex(h, w) if not np.isnan(z[i, j])), key=lambda c: -z[c]):
        best = (0.0, None, None, 0.0)
        for straight, diagonal in terrain.FACETS:
            a, b = (i + straight[0], j + straight[1]), (i + diagonal[0], j + diagonal[1])
            za, zb = (z[c] if 0 <= c[0] < h and 0 <= c[1] < w and not np.isnan(z[c]) else None for c in (a, b))
            if za is None and zb is None:
                continue
            if za is None:
                fall, part = (z[i, j] - zb) / math.sqrt(2), 1.0
            elif zb is None:
                fall, part = z[i, j] - za, 0.0
            else:
                angle = math.atan2(za - zb, z[i, j] - za)
                fall = z[i, j] - za if angle <= 0 else (z[i, j] - zb) / math.sqrt(2) if angle >= math.pi / 4 else math.hypot(z[i, j] - za, za - zb)
                part = min(max(angle / (math.pi / 4), 0), 1)
            if fall > best[0]:
                best = (fall, a, b, part)
        if best[1]:
            for to, share in ((best[1], 1 - best[3]), (best[2], best[3])):
                if share > 0:
                    flow[to] += share * flow[i, j]
    return flow


@pytest.fixture(scope="module")
def hills():
    rng = np.random.default_rng(3)
    y, x = np.mgrid[:100, :100]
    return 50 * np.sin(x / 17) + 40 * np.cos(y / 23) + 0.9 * y + 0.4 * x + rng.random((100, 100))  # long ways over many tiles


def test_dinf_on_ten_thousand_cells(spark, hills):
    want = dinf(hills)
    got = grid_of(terrain.dinf_accumulation(frame(spark, hills), 16), "flow", hills.shape)
    assert np.allclose(got, want, rtol=1e-9)
    assert want.max() > 500  # water from over two tiles' cells meets


def test_dinf_tile_size_and_missing_cells(spark):
    rng = np.random.default_rng(4)
    z = rng.random((13, 9))
    z[rng.random(z.shape) < 0.15] = np.nan
    want = dinf(z)
    for size in (2, 5, 64):
        got = grid_of(terrain.dinf_accumulation(frame(spark, z), size), "flow", z.shape)
        assert np.allclose(got, want, equal_nan=True), size
    flat = np.ones((3, 3))
    assert np.array_equal(grid_of(terrain.dinf_accumulation(frame(spark, flat)), "flow", (3, 3)), flat)
    assert terrain.dinf_accumulation(frame(spark, np.zeros((0, 0)))).count() == 0


def test_nearest_source_with_ties_and_holes(spark):
    rng = np.random.default_rng(5)
    cells = [(i, j) for i, j in np.ndindex(14, 11) if rng.random() < 0.8]
    value = {c: float(rng.integers(100)) for c in cells}
    source = {c for c in cells if rng.random() < 0.08}
    df = spark.createDataFrame([(*c, value[c], c in source) for c in cells], "row long, col long, value double, s boolean")
    got = {(r.row, r.col): (r.d2, r.src_row, r.src_col, r.src_value) for r in terrain.nearest_source(df, F.col("s")).collect()}
    assert got == {c: min(((c[0] - s[0]) ** 2 + (c[1] - s[1]) ** 2, *s, value[s]) for s in source) for c in cells}
    none = terrain.nearest_source(df, F.lit(False)).collect()
    assert len(none) == len(cells) and all(r.src_row is None and r.d2 is None for r in none)
    assert terrain.nearest_source(df.limit(0), F.col("s")).count() == 0


def test_relative_elevation_falls_back(spark):
    z = np.arange(12.0).reshape(3, 4)
    dem = frame(spark, z)
    mask = lambda *cells: spark.createDataFrame(list(cells), "row long, col long")
    off = mask((9, 9))
    rem = lambda sources: grid_of(terrain.relative_elevation(dem, sources), "rem", z.shape)
    assert np.array_equal(rem([None, off, mask((0, 0)), mask((2, 3))]), z[0, 0] - z)
    assert np.isnan(rem([None, off])).all()


def test_line_cells_touch(spark):
    rng = np.random.default_rng(6)
    grid = Grid(-3.0, 2.0, 1.0, 9, 12)
    for _ in range(4):
        pts = [(float(rng.uniform(-3, 9)), float(rng.uniform(2, 11))) for _ in range(3)]
        lines = spark.createDataFrame([([{"x": x, "y": y} for x, y in pts],)], "pts array<struct<x:double,y:double>>")
        got = {tuple(r) for r in terrain.line_cells(lines, grid).collect()}
        walked = {(int(math.floor(b - 2)), int(math.floor(a + 3))) for (x1, y1), (x2, y2) in zip(pts, pts[1:]) for t in np.linspace(0, 1, 20001) for a, b in [(x1 + t * (x2 - x1), y1 + t * (y2 - y1))]}
        assert walked <= got and len(got - walked) <= 1  # a corner cut by less than a step


def forms(z, radius, cell, flat=1.0):
    out = np.full(z.shape, np.nan)
    for i, j in np.ndindex(z.shape):
        if np.isnan(z[i, j]):
            continue
        higher = lower = 0
        for di, dj in ((0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)):
            at = [(k, z[i + k * di, j + k * dj]) for k in range(1, radius + 1) if 0 <= i + k * di < z.shape[0] and 0 <= j + k * dj < z.shape[1]]
            rise = [(v - z[i, j]) / (k * math.hypot(di, dj) * cell) for k, v in at if not np.isnan(v)]
            angle = math.degrees(math.atan(max([0, *rise]))) - math.degrees(math.atan(max([0, *(-x for x in rise)])))
            higher, lower = higher + (angle > flat), lower + (angle < -flat)
        out[i, j] = terrain.FORMS[lower][higher]
    return out


def test_landforms(spark, hills):
    z = hills[:30, :40].copy()
    z[np.random.default_rng(7).random(z.shape) < 0.1] = np.nan
    df = terrain.landforms(frame(spark, z), 4, 10.0)
    want = forms(z, 4, 10.0)
    assert np.array_equal(grid_of(df, "form", z.shape), want, equal_nan=True)
    assert np.array_equal(grid_of(df, "terrace", z.shape), np.where(np.isnan(want), np.nan, np.isin(want, terrain.TERRACES)), equal_nan=True)
    assert len(np.unique(want[~np.isnan(want)])) >= 5
    peak = np.zeros((5, 5))
    peak[2, 2] = 9
    assert grid_of(terrain.landforms(frame(spark, peak), 2, 1.0), "form", (5, 5))[2, 2] == 2
    assert grid_of(terrain.landforms(frame(spark, -peak), 2, 1.0), "form", (5, 5))[2, 2] == 10


@pytest.mark.parametrize("shape,block", [((256, 256), 1 << 12), ((37, 20), 1 << 21)])
def test_vertical_derivative_equals_one_transform(spark, shape, block):
    rng = np.random.default_rng(8)
    z = rng.normal(size=shape).cumsum(0)
    z[rng.random(shape) < 0.02] = np.nan
    g = np.where(np.isnan(z), np.nanmean(z), z)
    g = (g - g.mean()) * np.hanning(shape[0])[:, None] * np.hanning(shape[1])
    k = np.hypot(*np.meshgrid(np.fft.fftfreq(shape[0], d=50) * 2 * np.pi, np.fft.fftfreq(shape[1], d=50) * 2 * np.pi, indexing="ij"))
    want = np.where(np.isnan(z), np.nan, np.fft.ifft2(np.fft.fft2(g) * k).real)
    got = grid_of(terrain.vertical_derivative(frame(spark, z), 50.0, block=block), "vd", shape)
    assert np.allclose(got, want, rtol=0, atol=1e-9, equal_nan=True)


def test_vertical_derivative_of_nothing(spark):
    assert terrain.vertical_derivative(frame(spark, np.zeros((0, 0))), 1.0).count() == 0
    assert np.isnan(grid_of(terrain.vertical_derivative(frame(spark, np.full((2, 2), np.nan)), 1.0), "vd", (2, 2))).all()
    # a lost row and ids that don't start at 0
    z = np.random.default_rng(9).normal(size=(6, 5))
    df = frame(spark, z).where("row <> 3").select((F.col("row") + 100).alias("row"), (F.col("col") - 7).alias("col"), "value")
    filled = z.copy()
    filled[3] = np.delete(z, 3, 0).mean()
    whole = grid_of(terrain.vertical_derivative(frame(spark, filled), 1.0, block=8), "vd", z.shape)
    for r in terrain.vertical_derivative(df, 1.0, block=8).collect():
        assert abs(r.vd - whole[r.row - 100, r.col + 7]) < 1e-9


def test_smoothed_equals_tiles(spark, hills):
    z = hills[:40, :30]
    df = terrain.smoothed(frame(spark, z), 1.5)
    tiled = raster.tiles(frame(spark, z), 32, 16, lambda g: raster.gaussian(g, 1.5), "t")
    assert np.allclose(grid_of(df, "smooth", z.shape), grid_of(tiled, "t", z.shape), atol=1e-9)
    assert np.allclose(grid_of(df, "smooth", z.shape), raster.gaussian(z, 1.5), atol=1e-9)
    assert abs(np.nanmax(grid_of(terrain.smoothed(frame(spark, z), 1.5, 0.25), "smooth", z.shape)) - 0.25) < 1e-12
    assert np.array_equal(grid_of(terrain.smoothed(frame(spark, np.zeros((3, 3))), 1.0, 0.25), "smooth", (3, 3)), np.zeros((3, 3)))


def test_paleochannel_composite(spark, hills):
    z = hills[:24, :20]
    flow = dinf(z)
    dem = frame(spark, z)
    water = frame(spark, flow).withColumnRenamed("value", "flow")
    channels = spark.createDataFrame([(i, 10) for i in range(24)], "row long, col long")
    got = grid_of(terrain.paleochannel(dem, water, [channels], 10.0), "likelihood", z.shape)

    def scaled(a):
        lo, hi = np.percentile(a, [1, 99])
        return (np.clip(a, lo, hi) - lo) / (hi - lo) if hi > lo else np.zeros_like(a)

    def around(f, a, r):
        return np.array([[f(a[max(0, i - r) : i + r + 1, max(0, j - r) : j + r + 1]) for j in range(a.shape[1])] for i in range(a.shape[0])])

    rem = z[:, [10]] - z
    lrm = z - around(np.mean, z, 2)
    hat = around(np.min, around(np.max, z, 2), 2) - z
    above = z - around(lambda a: np.percentile(a, 10), z, 2)
    terrace = np.isin(forms(z, 3, 10.0), terrain.TERRACES).astype(float)
    gmi = np.mean([scaled(a) for a in (terrace, hat, above, np.log1p(flow))], 0)
    want = scaled(0.45 * scaled(rem) + 0.20 * scaled(lrm) + 0.35 * scaled(gmi))
    assert np.allclose(got, want, atol=1e-9)
