"""Projections against published examples, round trips, mixed systems and warped rasters."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.projection import KNOWN, Crs, crs, reproject, reproject_mixed
from lodestar.model import Grid
from lodestar.operators.raster import warp
from lodestar.sources.adapters import get_adapter

GEO66 = Crs("geographic", "CLARKE66")


def at(spark, lon, lat):
    return spark.createDataFrame([(float(lon), float(lat))], "x double, y double")


def test_published_examples(spark):
    cone = Crs("albers", "CLARKE66", -96.0, 23.0, 29.5, 45.5)
    x, y = reproject(at(spark, -75, 35), GEO66, cone).first()
    assert abs(x - 1885472.7) < 0.06 and abs(y - 1535925.0) < 0.06
    x, y = reproject(at(spark, -73.5, 40.5), GEO66, replace(crs(26718), shift=None)).first()
    assert abs(x - 500000 - 127106.5) < 0.06 and abs(y - 4484124.4) < 0.06
    x, y = reproject(at(spark, 180, 0), crs(4326), crs(3857)).first()
    assert abs(abs(x) - 20037508.342789) < 1e-5 and abs(y) < 1e-6


@pytest.mark.parametrize("number", [*KNOWN, 26910, 32733, 26711])
def test_round_trip_to_a_millimetre(spark, number):
    system = crs(number)
    rng = np.random.default_rng(number)
    lon = system.lon0 + rng.uniform(-3, 3, 300) if system.kind == "transverse" else (system.lon0 or -100) + rng.uniform(-12, 12, 300)
    lat = rng.uniform(-60, -5, 300) if number == 32733 else rng.uniform(25, 68, 300)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))], "i long, x double, y double")
    there = reproject(df, crs(4326), system)
    back = {r.i: (r.x, r.y) for r in reproject(there, system, crs(4326)).collect()}
    for i in range(300):
        metres = math.hypot((back[i][0] - lon[i]) * 111320 * math.cos(math.radians(lat[i])), (back[i][1] - lat[i]) * 111320)
        assert metres < 1e-3


def test_datum_shift_is_about_a_hundred_metres(spark):
    x, y = reproject(at(spark, -120.0, 39.0), crs(4267), crs(4326)).first()
    east, north = (x + 120) * 111320 * math.cos(math.radians(39)), (y - 39) * 111320
    assert -110 < east < -70 and abs(north) < 40  # the world datum lies west of the old one there


def test_mixed_and_odd_rows(spark):
    rows = [(1, 4326, -120.0, 38.0), (2, 3310, None, 1.0), (3, 99, 5.0, 5.0), (4, None, 5.0, 5.0), (5, 3857, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, srid int, x double, y double")
    got = {r.id: (r.x, r.y) for r in reproject_mixed(df, crs(4326)).collect()}
    assert got[1] == (-120.0, 38.0) and got[2] == got[3] == got[4] == (None, None) and max(map(abs, got[5])) < 1e-12
    assert reproject_mixed(df.limit(0), crs(4326)).count() == 0
    with pytest.raises(KeyError):
        crs(99)


def test_warp_of_a_plane_stays_a_plane(spark):
    source = Grid(-13_500_000.0, 4_500_000.0, 1000.0, 40, 50)
    z = spark.createDataFrame([(i, j, 2.0 * j + 3.0 * i) for i, j in np.ndindex(40, 50)], "row long, col long, value double")
    same = warp(z, source, crs(3857), source, crs(3857))
    assert same.join(z.withColumnRenamed("value", "v"), ["row", "col"]).where("abs(value - v) > 1e-6 or value is null").count() == 0
    low = reproject(at(spark, source.x0, source.y0), crs(3857), crs(4326)).first()
    target = Grid(low.x, low.y, 0.005, 50, 60)
    got = warp(z, source, crs(3857), target, crs(4326)).collect()
    assert len(got) == 3000
    here = reproject(target.cells(spark), crs(4326), crs(3857)).select("row", "col", "x", "y").collect()
    want = {(r.row, r.col): (2 * ((r.x - source.x0) / 1000 - 0.5) + 3 * ((r.y - source.y0) / 1000 - 0.5)) for r in here}
    inside = [r for r in got if r.value is not None]
    assert len(inside) > 1000
    middle = [r for r in inside if 2 < r.row < 40 and 2 < r.col < 50]
    assert all(abs(r.value - want[r.row, r.col]) < 1e-6 for r in middle)
    nearest = warp(z, source, crs(3857), target, crs(4326), "nearest").where(F.col("value").isNotNull()).collect()
    assert all(r.value == int(r.value) for r in nearest)


def test_nure_units_and_datum(spark):
    raw = spark.createDataFrame([("a", -120.0, 39.0, -1.0, 500.0, 2.0, 0.5), ("b", None, 39.0, 1.0, 1.0, 1.0, 1.0)], "lab_id string, x double, y double, Au_sq_ppm double, Au_ppb double, Fe_pct double, Cu_ppm double")
    load = get_adapter("geochem", "nure_iicpms")
    row = load(raw).first()
    assert load(raw).count() == 1 and row.Au_ppm is None and row.Au_ppb == 500.0 and row.Fe_pct == 2.0 and -120.0015 < row.x < -120.0008
    row = load(raw, ["Au", "Fe"], in_ppm=True, datum=None).first()
    assert row.asDict() == {"x": -120.0, "y": 39.0, "sample_id": "a", "source": "NURE", "Au_ppm": 0.5, "Fe_ppm": 20000.0}
