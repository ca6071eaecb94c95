"""Coordinate systems over the suppliers' places, and a raster moved to another one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projection import crs, reproject, reproject_mixed
from ..model import Grid
from ..operators import raster
from .registry import ANCHORS_SQL, CELL, CELLS_SQL, COLUMNS, anchors, cells, grid, query, rounded


def _places(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d)
    return a.select("anchor_id", (-124 + F.col("x") / 12500 * 8).alias("x"), (34 + F.col("y") / 10000 * 6).alias("y"))


PLACES_SQL = f"{ANCHORS_SQL}, places AS (SELECT anchor_id, -124 + x / 12500 * 8 AS lon, 34 + y / 10000 * 6 AS lat FROM anchors)"

_F = "(1 / 298.257222101::DOUBLE)"
_E2 = f"({_F} * (2 - {_F}))"
_q = lambda s: f"((1 - {_E2}) * ({s} / (1 - {_E2} * {s} * {s}) - ln((1 - sqrt({_E2}) * {s}) / (1 + sqrt({_E2}) * {s})) / (2 * sqrt({_E2}))))"
_m2 = lambda a: f"(pow(cos(radians({a})), 2) / (1 - {_E2} * pow(sin(radians({a})), 2)))"


@query(f"""WITH {PLACES_SQL}, k AS (SELECT ({_m2('34')} - {_m2('40.5')}) / ({_q('sin(radians(40.5))')} - {_q('sin(radians(34))')}) AS n), c AS (SELECT n, {_m2('34')} + n * {_q('sin(radians(34))')} AS c FROM k),
r AS (SELECT anchor_id, n * radians(lon + 120) AS t, 6378137 * sqrt(c - n * {_q('sin(radians(lat))')}) / n AS r, 6378137 * sqrt(c) / n AS top FROM places, c) SELECT anchor_id, round(r * sin(t), 3) + 0.0 AS x, round(top - r * cos(t) - 4000000, 3) + 0.0 AS y FROM r""")
def albers_points(spark: SparkSession, d: str) -> DataFrame:
    """Places on the equal-area cone of a state, to the millimetre."""
    return rounded(reproject(_places(spark, d), crs(4326), crs(3310)), 3)


@query(f"""WITH {PLACES_SQL}, k AS (SELECT {_F} / (2 - {_F}) AS n), t AS (SELECT anchor_id, n, radians(lon + 123) AS d, sinh(atanh(sin(radians(lat))) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(radians(lat)))) AS t FROM places, k),
u AS (SELECT *, atan2(t, cos(d)) AS u, atanh(sin(d) / sqrt(1 + t * t)) AS v, 0.9996 * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM t)
SELECT anchor_id, round(500000 + a * (v + a1 * cos(2 * u) * sinh(2 * v) + a2 * cos(4 * u) * sinh(4 * v) + a3 * cos(6 * u) * sinh(6 * v)), 3) AS x, round(a * (u + a1 * sin(2 * u) * cosh(2 * v) + a2 * sin(4 * u) * cosh(4 * v) + a3 * sin(6 * u) * cosh(6 * v)), 3) AS y FROM u""")
def transverse_points(spark: SparkSession, d: str) -> DataFrame:
    """Places in a zone of the universal transverse Mercator system, to the millimetre."""
    return rounded(reproject(_places(spark, d), crs(4326), crs(26910)), 3)


def shifted_sql(lon: str, lat: str, of: str, keep: str) -> str:
    """Rows of ``of`` with longitude and latitude moved from the older North American datum to the world one."""
    e = "(1 / 294.978698214::DOUBLE * (2 - 1 / 294.978698214::DOUBLE))"
    t = "(1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE))"
    b = "(6378137 * (1 - 1 / 298.257223563::DOUBLE))"
    return f"""(SELECT {keep}, degrees(atan2(y3, x3)) AS lon, degrees(atan2(z3 + {t} / (1 - {t}) * {b} * pow(sin(th), 3), p - {t} * 6378137 * pow(cos(th), 3))) AS lat FROM (SELECT *, sqrt(x3 * x3 + y3 * y3) AS p, atan2(z3 * 6378137, sqrt(x3 * x3 + y3 * y3) * {b}) AS th FROM
  (SELECT *, n * cos(radians({lat})) * cos(radians({lon})) - 8 AS x3, n * cos(radians({lat})) * sin(radians({lon})) + 160 AS y3, n * (1 - {e}) * sin(radians({lat})) + 176 AS z3 FROM (SELECT *, 6378206.4 / sqrt(1 - {e} * pow(sin(radians({lat})), 2)) AS n FROM {of}))))"""


@query(f"WITH {PLACES_SQL} SELECT anchor_id, round(lon, 8) AS x, round(lat, 8) AS y FROM {shifted_sql('lon', 'lat', 'places', 'anchor_id')}")
def datum_shift(spark: SparkSession, d: str) -> DataFrame:
    """Places moved from the older North American datum to the world one."""
    return rounded(reproject(_places(spark, d), crs(4267), crs(4326)), 8)


SYSTEMS = (4326, 3857, 3310, 26910, 26710, 5070)


@query(f"WITH {PLACES_SQL} SELECT anchor_id, CASE WHEN anchor_id % 7 < 6 THEN round(lon, 8) END AS x, CASE WHEN anchor_id % 7 < 6 THEN round(lat, 8) END AS y FROM places")
def mixed_systems(spark: SparkSession, d: str) -> DataFrame:
    """Places that come in six systems, moved back to one; those of an unknown system have none."""
    places = _places(spark, d)
    pick = F.col("anchor_id") % (len(SYSTEMS) + 1)
    mixed = places.where(pick == len(SYSTEMS)).withColumn("srid", F.lit(1))
    for k, number in enumerate(SYSTEMS):
        mixed = mixed.unionByName(reproject(places.where(pick == k), crs(4326), crs(number)).withColumn("srid", F.lit(number)))
    return rounded(reproject_mixed(mixed, crs(4326)).drop("srid"), 8)


DEGREES = 0.002


@query(f"""WITH {CELLS_SQL}, h AS (SELECT max(p_partkey) // 50 + 1 AS rows FROM part), n AS (SELECT ceil(50 * 250 / 111319.49 / {DEGREES})::BIGINT AS cols, ceil(rows * 250 / 111319.49 / {DEGREES})::BIGINT AS high, rows FROM h),
t AS (SELECT r AS row, c AS col, radians((c + 0.5) * {DEGREES}) * 6378137 AS x, ln(tan(pi() / 4 + radians((r + 0.5) * {DEGREES}) / 2)) * 6378137 AS y, rows FROM n CROSS JOIN LATERAL range(high) a(r) CROSS JOIN LATERAL range(cols) b(c)),
q AS (SELECT row, col, floor(x / 250 - 0.5) AS c, floor(y / 250 - 0.5) AS w, x / 250 - 0.5 - floor(x / 250 - 0.5) AS fx, y / 250 - 0.5 - floor(y / 250 - 0.5) AS fy FROM t WHERE x BETWEEN 0 AND 12500 AND y BETWEEN 0 AND rows * 250),
k AS (SELECT q.row, q.col, w + i AS r, c + j AS s, (CASE i WHEN 1 THEN fy ELSE 1 - fy END) * (CASE j WHEN 1 THEN fx ELSE 1 - fx END) AS wt FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
v AS (SELECT k.row, k.col, sum(wt * elevation) / sum(wt) AS value FROM k JOIN cells ON cells.row = k.r AND cells.col = k.s GROUP BY k.row, k.col) SELECT t.row, t.col, round(v.value, 5) AS value FROM t LEFT JOIN v ON v.row = t.row AND v.col = t.col""")
def warped_raster(spark: SparkSession, d: str) -> DataFrame:
    """The raster of parts, taken as spherical Mercator metres, on a grid of degrees."""
    source = grid(spark, d)
    metres = 111319.49
    high, wide = (-int(-n * CELL / metres // DEGREES) for n in (source.n_rows, COLUMNS))
    target = Grid(0.0, 0.0, DEGREES, high, wide, "EPSG:4326")
    dem = cells(spark, d).select("row", "col", F.col("elevation").alias("value"))
    return rounded(raster.warp(dem, source, crs(3857), target, crs(4326)), 5)
