"""Overlay of shapes: areas, points and rings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import overlay

KIND = f"id long, rings {overlay.RINGS}"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def star(cx, cy, r, n, rng):
    a = np.sort(rng.random(n)) * 2 * math.pi
    d = r * (0.4 + 0.6 * rng.random(n))
    return ring(*[(cx + d[i] * math.cos(a[i]), cy + d[i] * math.sin(a[i])) for i in range(n)])


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for r in rings:
        for p, q in zip(r, r[1:]):
            hit = (p["y"] > y) != (q["y"] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= hit & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
    return odd


def shoelace(r):
    return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(r, r[1:])) / 2


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(11)
    made = [[star(*rng.uniform(0, 10, 2), rng.uniform(1, 4), 9, rng), star(*rng.uniform(0, 10, 2), 1.0, 6, rng)] for _ in range(7)]
    made.append([ring((1, 1), (9, 1), (9, 9), (1, 9)), ring((3, 3), (7, 3), (7, 7), (3, 7)), ring((4, 4), (6, 4), (6, 6), (4, 6))])  # a hole with an island
    return made


def area_of(rings):
    x, y = np.random.default_rng(0).uniform(-5, 15, (2, 200_000))
    return inside(rings, x, y).mean() * 400


def sides(spark, shapes, size=1.0):
    df = spark.createDataFrame(list(enumerate(shapes)), KIND)
    return df, overlay.cut(df, size)


def test_cut_keeps_area_and_points(spark, shapes):
    df, pieces = sides(spark, shapes)
    by = {r[0]: r[1] for r in pieces.groupBy("id").agg(F.sum(overlay.piece_area(1.0))).collect()}
    assert abs(by[7] - (64 - 16 + 4)) < 1e-9
    for i, s in enumerate(shapes):
        assert abs(by[i] - area_of(s)) < 1.5  # the estimate is good to 0.3
    for size in (0.37, 2.5, 40.0):
        again = {r[0]: r[1] for r in overlay.cut(df, size).groupBy("id").agg(F.sum(overlay.piece_area(size))).collect()}
        assert all(abs(again[i] - by[i]) < 1e-9 for i in by), size


def test_union_clip_difference(spark, shapes):
    first, second = shapes[:4], shapes[4:]
    a = overlay.cut(spark.createDataFrame(list(enumerate(first)), KIND), 1.0)
    b = overlay.cut(spark.createDataFrame(list(enumerate(second)), KIND), 1.0)
    mask = overlay.union(b, 1.0, together=2)
    x, y = np.random.default_rng(1).uniform(-2, 12, (2, 4000))
    points = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "n long, x double, y double")
    got = {r.n: r.covered for r in overlay.covered(points, mask, 1.0).collect()}
    want = np.any([inside(s, x, y) for s in second], 0)
    assert [got[i] for i in range(len(x))] == want.tolist()
    total = lambda df: df.agg(F.sum(overlay.piece_area(1.0))).first()[0]
    assert abs(total(mask) - total(overlay.union(b, 1.0))) < 1e-9
    within, without = overlay.clip(a, mask, 1.0), overlay.clip(a, mask, 1.0, inside=False)
    for i, s in enumerate(first):
        own = inside(s, x, y)
        for part, expected in ((within, own & want), (without, own & ~want)):
            seen = {r.n: r.covered for r in overlay.covered(points, part.where(F.col("id") == i), 1.0).collect()}
            assert [seen[k] for k in range(len(x))] == expected.tolist()
    assert abs(total(within) + total(without) - total(a)) < 1e-9


def test_dissolve_gives_rings_back(spark, shapes):
    _, pieces = sides(spark, shapes)
    x, y = np.random.default_rng(2).uniform(-2, 12, (2, 3000))
    got = {r.id: r.rings for r in overlay.dissolve(pieces, 1.0).collect()}
    for i, s in enumerate(shapes):
        rings = [[p.asDict() for p in r] for r in got[i]]
        assert np.array_equal(inside(rings, x, y), inside(s, x, y)), i
    frame = [[p.asDict() for p in r] for r in got[7]]
    assert sorted(round(abs(shoelace(r)), 9) for r in frame) == [4, 16, 64] and sorted(map(len, frame)) == [5, 5, 5]


def test_buffer_of_a_square_and_odd_shapes(spark):
    square = spark.createDataFrame([(1, [ring((0, 0), (4, 0), (4, 4), (0, 4))])], KIND)
    pieces = overlay.cut(overlay.buffer(square, 1.0, corners=256), 0.5)
    got = overlay.union(pieces, 0.5).agg(F.sum(overlay.piece_area(0.5))).first()[0]
    assert abs(got - (16 + 16 + math.pi)) < 0.01
    odd = spark.createDataFrame([(1, None), (2, []), (3, [[]]), (4, [ring((1, 1), (2, 2))]), (5, [[{"x": 0.0, "y": 0.0}]])], KIND)
    assert overlay.cut(odd, 1.0).count() == 0
    empty = overlay.cut(square.limit(0), 1.0)
    assert overlay.union(empty, 1.0).count() == 0 and overlay.clip(pieces, overlay.union(empty, 0.5), 0.5).count() == 0
    unclosed = spark.createDataFrame([(1, [ring((0, 0), (1, 0), (1, 1))[:-1]])], KIND)
    assert abs(overlay.cut(unclosed, 0.3).agg(F.sum(overlay.piece_area(0.3))).first()[0] - 0.5) < 1e-12


def test_many_copies_and_many_shapes_in_a_cell(spark):
    rows = [(i, [ring((0.1, 0.1), (0.4 + 0.001 * (i % 40), 0.1), (0.4, 0.5 + 0.001 * (i % 40)))]) for i in range(400)]
    mask = overlay.union(overlay.cut(spark.createDataFrame(rows, KIND), 1.0), 1.0, together=8)
    assert mask.count() == 1
    got = mask.select(overlay.piece_area(1.0)).first()[0]
    x, y = np.random.default_rng(3).uniform(0, 1, (2, 300_000))
    want = np.any([inside(rows[i][1], x, y) for i in range(40)], 0).mean()
    assert abs(got - want) < 2e-3
