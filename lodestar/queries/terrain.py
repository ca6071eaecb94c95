"""Flow in shares, relative elevation, landforms, Fourier derivatives and smoothing over the raster of parts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terrain
from ..plans.storage import materialize
from .registry import CELLS_SQL, POLYGONS_SQL, cells, grid, polygons, query, rounded

FACETS_SQL = "facets AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (a, b) in enumerate(terrain.FACETS)) + ") t(k, dr1, dc1, dr2, dc2))"


def _raster(spark: SparkSession, d: str, value: str = "elevation") -> DataFrame:
    return cells(spark, d).select("row", "col", F.col(value).alias("value"))


DINF_SQL = f"""{CELLS_SQL}, r AS (SELECT row, col, elevation AS value FROM cells), {FACETS_SQL},
f AS (SELECT r.row, r.col, k, {{'r': x.row, 'c': x.col}} AS t1, {{'r': y.row, 'c': y.col}} AS t2, x.value IS NULL AS n1, y.value IS NULL AS n2, r.value - x.value AS s1, x.value - y.value AS s2, (r.value - y.value) / sqrt(2) AS across
  FROM r CROSS JOIN facets LEFT JOIN r x ON x.row = r.row + dr1 AND x.col = r.col + dc1 LEFT JOIN r y ON y.row = r.row + dr2 AND y.col = r.col + dc2),
g AS (SELECT *, CASE WHEN n1 THEN across WHEN n2 THEN s1 WHEN atan2(s2, s1) <= 0 THEN s1 WHEN atan2(s2, s1) >= pi() / 4 THEN across ELSE sqrt(s1 * s1 + s2 * s2) END AS fall,
  CASE WHEN n1 THEN 1 WHEN n2 THEN 0 ELSE least(greatest(atan2(s2, s1) / (pi() / 4), 0), 1) END AS part FROM f),
b AS (SELECT row, col, arg_max({{'t1': t1, 't2': t2, 'part': part}}, (fall, -k)) AS b FROM g WHERE fall > 0 GROUP BY row, col),
e AS (SELECT row, col, b.t1.r AS tr, b.t1.c AS tc, 1 - b.part AS share FROM b WHERE b.part < 1 UNION ALL SELECT row, col, b.t2.r, b.t2.c, b.part FROM b WHERE b.part > 0),
w AS (SELECT row, col, 1.0::DOUBLE AS water FROM r UNION ALL SELECT e.tr, e.tc, sum(water * share) FROM w JOIN e USING (row, col) GROUP BY e.tr, e.tc),
dinf AS (SELECT row, col, sum(water) AS flow FROM w GROUP BY row, col)"""


@query(f"WITH RECURSIVE {DINF_SQL} SELECT row, col, round(flow, 5) AS flow FROM dinf")
def dinf_flow(spark: SparkSession, d: str) -> DataFrame:
    """Area that drains through each cell, shared between two receivers."""
    return rounded(terrain.dinf_accumulation(_raster(spark, d)), 5)


CHANNELS_SQL = f"""{POLYGONS_SQL}, h AS (SELECT max(p_partkey) // 50 AS top FROM part),
o AS (SELECT x0, x1, unnest([y0, y1]) AS y, NULL AS x FROM boxes), v AS (SELECT y0, y1, unnest([x0, x1]) AS x FROM boxes),
a AS (SELECT floor(y / 250)::BIGINT AS row, unnest(range(floor(x0 / 250)::BIGINT, floor(x1 / 250)::BIGINT + 1)) AS col FROM o UNION SELECT unnest(range(floor(y0 / 250)::BIGINT, floor(y1 / 250)::BIGINT + 1)), floor(x / 250)::BIGINT FROM v),
channels AS (SELECT DISTINCT least(row, top) AS row, least(col, 49) AS col FROM a, h WHERE row <= top + (row * 250 <= (top + 1) * 250)::INT AND row <= top)"""


@query(f"WITH {CHANNELS_SQL} SELECT row, col FROM channels WHERE col < 50")
def channel_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the grid that the outlines of the boxes touch."""
    return terrain.line_cells(polygons(spark, d), grid(spark, d), "ring")


@query(f"""WITH {CELLS_SQL}, {CHANNELS_SQL}, c AS (SELECT row, col, elevation AS v FROM cells JOIN channels USING (row, col)),
n AS (SELECT a.row, a.col, a.elevation AS value, arg_min(c.v, ((a.row - c.row) * (a.row - c.row) + (a.col - c.col) * (a.col - c.col), c.row, c.col)) AS v FROM cells a CROSS JOIN c GROUP BY ALL) SELECT row, col, round(v - value, 6) AS rem FROM n""")
def relative_elevation(spark: SparkSession, d: str) -> DataFrame:
    """Elevation of the nearest channel cell less the cell's own; the first source has no cells, so the second is used."""
    none = spark.createDataFrame([], "row long, col long")
    return rounded(terrain.relative_elevation(_raster(spark, d), [None, none, channel_cells(spark, d)]).select("row", "col", "rem"))


@query(f"""WITH RECURSIVE {DINF_SQL}, q AS (SELECT quantile_cont(ln(1 + flow), 0.95) AS q FROM dinf), c AS (SELECT row, col, r.value AS v FROM dinf JOIN r USING (row, col), q WHERE round(ln(1 + flow), 5) >= round(q, 5)),
n AS (SELECT a.row, a.col, a.value, arg_min(c.v, ((a.row - c.row) * (a.row - c.row) + (a.col - c.col) * (a.col - c.col), c.row, c.col)) AS v FROM r a CROSS JOIN c GROUP BY ALL) SELECT row, col, round(v - value, 6) AS rem FROM n""")
def drainage_elevation(spark: SparkSession, d: str) -> DataFrame:
    """Relative elevation where there are no mapped channels: the raster's own flow, its top twentieth."""
    dem = _raster(spark, d)
    flow = materialize(rounded(terrain.dinf_accumulation(dem), 5))  # read by every pass for the percentile
    return rounded(terrain.relative_elevation(dem, [None, terrain.flow_channels(flow)]).select("row", "col", "rem"))


@query(f"""WITH {CELLS_SQL}, v AS (SELECT row, col, CASE WHEN cell_id % 11 > 0 THEN flow END AS value FROM cells), dirs AS (SELECT * FROM (VALUES (0, 0, 1, 1.0), (1, -1, 1, sqrt(2)), (2, -1, 0, 1.0), (3, -1, -1, sqrt(2)), (4, 0, -1, 1.0), (5, 1, -1, sqrt(2)), (6, 1, 0, 1.0), (7, 1, 1, sqrt(2))) t(k, dr, dc, len)),
s AS (SELECT a.row, a.col, a.value, k, greatest(coalesce(max((b.value - a.value) / (i * len * 250)), 0), 0) AS up, greatest(coalesce(max((a.value - b.value) / (i * len * 250)), 0), 0) AS down
  FROM v a CROSS JOIN dirs CROSS JOIN range(1, 4) t(i) LEFT JOIN v b ON b.row = a.row + dr * i AND b.col = a.col + dc * i GROUP BY ALL),
c AS (SELECT row, col, value, count(*) FILTER (degrees(atan(up)) - degrees(atan(down)) > 1) AS higher, count(*) FILTER (degrees(atan(up)) - degrees(atan(down)) < -1) AS lower FROM s GROUP BY ALL)
SELECT row, col, CASE WHEN value IS NOT NULL THEN ({[list(r) for r in terrain.FORMS]})[lower + 1][higher + 1] END::INT AS form, CASE WHEN value IS NOT NULL THEN (({[list(r) for r in terrain.FORMS]})[lower + 1][higher + 1] IN (1, 7, 8))::INT::DOUBLE END AS terrace FROM c""")
def landforms(spark: SparkSession, d: str) -> DataFrame:
    """Landform by horizons in eight directions, some cells missing."""
    v = cells(spark, d).select("row", "col", F.when(F.col("cell_id") % 11 > 0, F.col("flow")).alias("value"))
    return terrain.landforms(v, 3, 250.0).select("row", "col", "form", "terrace")


FOURIER_SQL = f"""{CELLS_SQL}, e AS (SELECT max(row) AS m, max(row) + 1 AS ny, avg(elevation) AS g FROM cells),
z AS (SELECT a.y, b.x, (coalesce(elevation, g) - g) * (0.5 - 0.5 * cos(2 * pi() * a.y / (ny - 1))) * (0.5 - 0.5 * cos(2 * pi() * b.x / 49)) AS z, ny FROM e CROSS JOIN LATERAL range(ny) a(y) CROSS JOIN range(50) b(x) LEFT JOIN cells ON row = a.y AND col = b.x),
f1 AS (SELECT y, k, ny, sum(z * cos(2 * pi() * k * x / 50)) AS re, -sum(z * sin(2 * pi() * k * x / 50)) AS im FROM z CROSS JOIN range(50) t(k) GROUP BY ALL),
f2 AS (SELECT l, k, ny, sum(re * cos(2 * pi() * l * y / ny) + im * sin(2 * pi() * l * y / ny)) AS re, sum(im * cos(2 * pi() * l * y / ny) - re * sin(2 * pi() * l * y / ny)) AS im FROM f1 CROSS JOIN LATERAL range(ny) t(l) GROUP BY ALL),
f3 AS (SELECT l, k, ny, re * w AS re, im * w AS im FROM (SELECT *, 2 * pi() / 250 * sqrt(pow((CASE WHEN l <= (ny - 1) // 2 THEN l ELSE l - ny END) / ny, 2) + pow((CASE WHEN k <= 24 THEN k ELSE k - 50 END) / 50, 2)) AS w FROM f2)),
f4 AS (SELECT y, k, sum(re * cos(2 * pi() * l * y / ny) - im * sin(2 * pi() * l * y / ny)) / any_value(ny) AS re, sum(im * cos(2 * pi() * l * y / ny) + re * sin(2 * pi() * l * y / ny)) / any_value(ny) AS im FROM f3 CROSS JOIN LATERAL range(ny) t(y) GROUP BY ALL),
vd AS (SELECT y AS row, x AS col, sum(re * cos(2 * pi() * k * x / 50) - im * sin(2 * pi() * k * x / 50)) / 50 AS vd FROM f4 CROSS JOIN range(50) t(x) GROUP BY ALL)"""


@query(f"""WITH {FOURIER_SQL}, s AS (SELECT a.row, a.col, a.elevation AS v, coalesce(n.elevation, a.elevation) AS n, coalesce(s.elevation, a.elevation) AS s, coalesce(w.elevation, a.elevation) AS w, coalesce(e.elevation, a.elevation) AS e
  FROM cells a LEFT JOIN cells n ON n.row = a.row - 1 AND n.col = a.col LEFT JOIN cells s ON s.row = a.row + 1 AND s.col = a.col LEFT JOIN cells w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN cells e ON e.row = a.row AND e.col = a.col + 1),
t AS (SELECT row, col, n + 2 * v + s AS y, w + 2 * v + e AS x FROM s),
h AS (SELECT a.row, a.col, sqrt(pow((coalesce(e.y, a.y) - coalesce(w.y, a.y)) / 2000, 2) + pow((coalesce(s.x, a.x) - coalesce(n.x, a.x)) / 2000, 2)) AS hgm
  FROM t a LEFT JOIN t n ON n.row = a.row - 1 AND n.col = a.col LEFT JOIN t s ON s.row = a.row + 1 AND s.col = a.col LEFT JOIN t w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN t e ON e.row = a.row AND e.col = a.col + 1)
SELECT row, col, round(vd, 6) + 0.0 AS vd, round(hgm, 6) AS hgm, round(sqrt(hgm * hgm + vd * vd), 6) AS asa, round(atan2(vd, hgm + 1e-12), 5) + 0.0 AS tilt FROM h JOIN vd USING (row, col)""")
def fourier_derivatives(spark: SparkSession, d: str) -> DataFrame:
    """Vertical derivative by the Fourier transform, horizontal gradient, analytic signal and tilt."""
    out = terrain.fourier_derivatives(_raster(spark, d), 250.0).select("row", "col", "vd", "hgm", "asa", "tilt")
    return rounded(out.withColumn("tilt", F.round("tilt", 5)))


@query(f"""WITH {CELLS_SQL}, v AS (SELECT row, col, coalesce(CASE WHEN cell_id % 13 > 0 THEN flow END, (SELECT avg(flow) FROM cells WHERE cell_id % 13 > 0)) AS v FROM cells),
k AS (SELECT i, exp(-0.5 * i * i / 4) / (SELECT sum(exp(-0.5 * n * n / 4)) FROM range(-8, 9) t(n)) AS w FROM range(-8, 9) t(i)), a AS (SELECT row, min(col) AS lo, max(col) AS hi FROM v GROUP BY row), b AS (SELECT col, min(row) AS lo, max(row) AS hi FROM v GROUP BY col),
x AS (SELECT v.row, v.col, sum(w * n.v) AS v FROM v JOIN a USING (row) CROSS JOIN k JOIN v n ON n.row = v.row AND n.col = least(greatest(v.col + i, lo), hi) GROUP BY v.row, v.col),
y AS (SELECT x.row, x.col, sum(w * n.v) AS v FROM x JOIN b USING (col) CROSS JOIN k JOIN x n ON n.col = x.col AND n.row = least(greatest(x.row + i, lo), hi) GROUP BY x.row, x.col)
SELECT row, col, round(v / (SELECT max(v) FROM y) * 0.3, 6) AS smooth FROM y""")
def smoothed_surface(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian smoothing over two cells, the peak scaled to 0.3, some cells missing."""
    v = cells(spark, d).select("row", "col", F.when(F.col("cell_id") % 13 > 0, F.col("flow")).alias("value"))
    return rounded(terrain.smoothed(v, 2.0, 0.3).select("row", "col", "smooth"))


@query()
def paleochannel_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Composite of relative elevation, local relief and the geomorphic index (tests hold it against numpy)."""
    dem = _raster(spark, d)
    flow = materialize(rounded(terrain.dinf_accumulation(dem), 5))

    def sources() -> Iterator[DataFrame]:
        yield channel_cells(spark, d)
        yield terrain.flow_channels(flow)  # asked for only where the first has no cells

    return rounded(terrain.paleochannel(dem, flow, sources(), 250.0))
