"""Rasters, scalar terrain expressions, normalisers and the weighted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..model import FeatureWeight
from ..operators import raster
from ..plans import index
from .registry import ANCHORS_SQL, CELLS_SQL, anchors, cells, grid, query, rounded, table


def _raster(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("row", "col", F.col("elevation").alias("value"))


R = f"WITH {CELLS_SQL}, r AS (SELECT row, col, elevation AS value FROM cells)"


@query(f"""{R}, m AS (SELECT a.row, a.col, a.value, avg(b.value) AS box FROM r a JOIN r b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL) SELECT row, col, round(box, 5) AS box FROM m""")
def focal_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.box(_raster(spark, d), 2).select("row", "col", "box"), 5)


@query(f"""{R}, v AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 5 > 0 THEN value END AS value FROM r) SELECT a.row, a.col, round(avg(b.value), 5) AS box FROM v a JOIN v b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL""")
def focal_mean_null(spark: SparkSession, d: str) -> DataFrame:
    """Box mean over what isn't missing."""
    v = _raster(spark, d).withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 3) % 5 > 0, F.col("value")))
    return rounded(raster.box(v, 1).select("row", "col", "box"), 5)


FULL = "f AS (SELECT row, col, value FROM r), z AS (SELECT max(row) AS m FROM r)"


@query(f"""{R}, {FULL}, o AS (SELECT unnest(range(-2, 3)) AS k), n AS (SELECT a.row, a.col, a.value, CASE WHEN a.row + i.k < 0 THEN -1 - (a.row + i.k) WHEN a.row + i.k > m THEN 2 * m + 1 - (a.row + i.k) ELSE a.row + i.k END AS r2,
  CASE WHEN a.col + j.k < 0 THEN -1 - (a.col + j.k) ELSE CASE WHEN a.col + j.k > 49 THEN 99 - (a.col + j.k) ELSE a.col + j.k END END AS c2 FROM f a, z, o i, o j)
SELECT n.row, n.col, CASE WHEN round(n.value - avg(b.value), 5) = 0 THEN 0 ELSE round(n.value - avg(b.value), 5) END AS tpi FROM n JOIN f b ON b.row = n.r2 AND b.col = n.c2 GROUP BY n.row, n.col, n.value""")
def box_mean_tpi(spark: SparkSession, d: str) -> DataFrame:
    """Value less the box mean with mirrored edges."""
    return rounded(raster.tpi(_raster(spark, d), 2, grid(spark, d).n_rows, 50).select("row", "col", "tpi"), 5)


@query(f"""{R}, x AS (SELECT a.row, a.col, a.value, max(b.value) AS d FROM r a JOIN r b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL)
SELECT a.row, a.col, round(min(b.d) - a.value, 5) AS top_hat FROM x a JOIN x b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col, a.value""")
def top_hat(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.top_hat(_raster(spark, d), 2).select("row", "col", "top_hat"), 5)


@query(f"""{R}, s AS (SELECT a.row, a.col, avg(b.value) FILTER (abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1) - avg(b.value) AS lrm FROM r a JOIN r b ON abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY ALL) SELECT row, col, round(lrm, 5) AS lrm FROM s""")
def local_relief(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.local_relief(_raster(spark, d), 1, 3).select("row", "col", "lrm"), 5)


@query(f"""{R}, {FULL}, o AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dr, dc)),
t AS (SELECT a.row, a.col, sum(abs(b.value - a.value)) / 8 AS tri FROM f a CROSS JOIN z CROSS JOIN o JOIN f b ON b.row = least(greatest(a.row + dr, 0), m) AND b.col = least(greatest(a.col + dc, 0), 49) GROUP BY a.row, a.col),
g AS (SELECT a.row, a.col, CASE WHEN w.value IS NULL THEN (e.value - a.value) / 250 WHEN e.value IS NULL THEN (a.value - w.value) / 250 ELSE (e.value - w.value) / 500 END AS gx,
  CASE WHEN n.value IS NULL THEN (s.value - a.value) / 250 WHEN s.value IS NULL THEN (a.value - n.value) / 250 ELSE (s.value - n.value) / 500 END AS gy
  FROM f a LEFT JOIN f w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN f e ON e.row = a.row AND e.col = a.col + 1 LEFT JOIN f n ON n.row = a.row - 1 AND n.col = a.col LEFT JOIN f s ON s.row = a.row + 1 AND s.col = a.col)
SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 5) AS slope, round(tri, 5) AS tri FROM g JOIN t USING (row, col)""")
def slope_tri(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.slope_tri(_raster(spark, d), 250.0).select("row", "col", "slope", "tri"), 5)


@query(f"{R} SELECT CAST(floor(row / 4) AS BIGINT) AS row, CAST(floor(col / 4) AS BIGINT) AS col, round(avg(value), 5) AS value, count(value) AS n FROM r GROUP BY 1, 2")
def decimate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.decimate(_raster(spark, d), 4), 5)


@query(f"{R} SELECT a.row, a.col, round(quantile_cont(b.value, 0.1), 5) AS low FROM r a JOIN r b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY a.row, a.col")
def focal_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.elevation_percentile(_raster(spark, d), 2).select("row", "col", "low"), 5)


@query(f"""{R}, {ANCHORS_SQL}, q AS (SELECT DISTINCT x, y, floor(x / 250 - 0.5) AS c, floor(y / 250 - 0.5) AS w, x / 250 - 0.5 - floor(x / 250 - 0.5) AS fx, y / 250 - 0.5 - floor(y / 250 - 0.5) AS fy FROM anchors),
k AS (SELECT x, y, w + i AS row, c + j AS col, (CASE i WHEN 1 THEN fy ELSE 1 - fy END) * (CASE j WHEN 1 THEN fx ELSE 1 - fx END) AS wt FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
s AS (SELECT x, y, sum(wt * value) / sum(wt) AS sampled FROM k JOIN r USING (row, col) GROUP BY x, y) SELECT anchor_id, round(sampled, 5) AS sampled FROM anchors LEFT JOIN s USING (x, y)""")
def raster_bilinear(spark: SparkSession, d: str) -> DataFrame:
    out = raster.bilinear(_raster(spark, d), anchors(spark, d), 0.0, 0.0, 250.0).select("anchor_id", F.nanvl("sampled", F.lit(None)).alias("sampled"))
    return rounded(out, 5)


@query(f"{R}, {ANCHORS_SQL} SELECT anchor_id, r.value AS sampled FROM anchors LEFT JOIN r ON r.row = floor(y / 250) AND r.col = floor(x / 250)")
def raster_nearest(spark: SparkSession, d: str) -> DataFrame:
    return raster.nearest_pixel(_raster(spark, d), anchors(spark, d), 0.0, 0.0, 250.0).select("anchor_id", "sampled")


@query(f"""WITH RECURSIVE {CELLS_SQL}, r AS (SELECT row, col, elevation AS value FROM cells), f AS (SELECT a.row, a.col, b.row AS r2, b.col AS c2, (a.value - b.value) / sqrt(((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))::DOUBLE) AS fall
  FROM r a JOIN r b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE a.value > b.value), rc AS (SELECT row, col, arg_max({{'r': r2, 'c': c2}}, (fall, -r2, -c2)) AS t FROM f GROUP BY row, col),
p AS (SELECT row, col FROM r UNION ALL SELECT rc.t.r, rc.t.c FROM p JOIN rc ON rc.row = p.row AND rc.col = p.col) SELECT row, col, count(*) AS flow FROM p GROUP BY row, col""")
def flow_accumulation(spark: SparkSession, d: str) -> DataFrame:
    """Cells that drain through each cell of the raster."""
    return raster.flow_accumulation(_raster(spark, d))


def _gradient_sql(name: str, of: str, axis: str) -> str:
    """A table with the gradient ``g`` of column ``g`` of another one: central differences, one-sided at the edges."""
    other = {"row": "col", "col": "row"}[axis]
    near = lambda t, k: f"LEFT JOIN {of} {t} ON {t}.{axis} = a.{axis} {k} AND {t}.{other} = a.{other}"
    return f"{name} AS (SELECT a.row, a.col, CASE WHEN w.g IS NULL THEN (e.g - a.g) / 250 WHEN e.g IS NULL THEN (a.g - w.g) / 250 ELSE (e.g - w.g) / 500 END AS g FROM {of} a {near('w', '- 1')} {near('e', '+ 1')})"


CURVATURE_SQL = f"""{R}, k AS (SELECT i, exp(-0.5 * i * i) / (SELECT sum(exp(-0.5 * n * n)) FROM range(-4, 5) t(n)) AS w FROM range(-4, 5) t(i)), e AS (SELECT max(row) AS m FROM r),
s AS (SELECT r.row, r.col, sum(k.w * b.value) AS g FROM r CROSS JOIN e CROSS JOIN k JOIN r b ON b.col = r.col AND b.row = least(greatest(r.row + i, 0), m) GROUP BY r.row, r.col),
z AS (SELECT s.row, s.col, sum(k.w * b.g) AS g FROM s CROSS JOIN k JOIN s b ON b.row = s.row AND b.col = least(greatest(s.col + i, 0), 49) GROUP BY s.row, s.col),
{_gradient_sql('zy', 'z', 'row')}, {_gradient_sql('zx', 'z', 'col')}, {_gradient_sql('zyy', 'zy', 'row')}, {_gradient_sql('zxy', 'zx', 'row')}, {_gradient_sql('zxx', 'zx', 'col')},
j AS (SELECT row, col, zx.g AS x, zy.g AS y, zxx.g AS xx, zxy.g AS xy, zyy.g AS yy, zx.g * zx.g + zy.g * zy.g AS p FROM zx JOIN zy USING (row, col) JOIN zxx USING (row, col) JOIN zxy USING (row, col) JOIN zyy USING (row, col))"""


@query(f"{CURVATURE_SQL} SELECT row, col, round(CASE WHEN p > 1e-12 THEN (xx * y * y - 2 * xy * x * y + yy * x * x) / pow(p, 1.5) ELSE 0 END, 6) + 0.0 AS plan_curvature FROM j")
def tile_curvature(spark: SparkSession, d: str) -> DataFrame:
    """Plan curvature of the smoothed surface, tile by tile with a halo."""
    return rounded(raster.tiles(_raster(spark, d), 16, 8, raster.curvature("plan", 1.0, 250.0), "plan_curvature").select("row", "col", "plan_curvature"))


@query(f"{CURVATURE_SQL} SELECT row, col, round(CASE WHEN p > 1e-12 THEN (xx * x * x + 2 * xy * x * y + yy * y * y) / (p * pow(1 + p, 1.5)) ELSE 0 END * 1e6, 4) + 0.0 AS profile_curvature FROM j")
def profile_curvature(spark: SparkSession, d: str) -> DataFrame:
    """Profile curvature of the smoothed surface, in millionths."""
    out = raster.tiles(_raster(spark, d), 16, 8, raster.curvature("profile", 1.0, 250.0), "profile_curvature")
    return rounded(out.select("row", "col", (F.col("profile_curvature") * 1e6).alias("profile_curvature")), 4)


@query(f"""{R}, q AS (SELECT row, col, CAST(floor(least(greatest((value - 900) / 100 * 16, 0), 15)) AS INT) AS q FROM r), d AS (SELECT a.row, a.col, (b.q - a.q) * (b.q - a.q) AS d FROM q a JOIN q b ON b.row = a.row AND b.col = a.col + 1), e AS (SELECT max(row) AS m FROM q)
SELECT q.row, q.col, round(avg(d.d), 6) AS contrast FROM q CROSS JOIN e CROSS JOIN range(-2, 3) i(i) CROSS JOIN range(-2, 2) j(j) JOIN d ON d.row = least(greatest(q.row + i, 0), m) AND d.col = least(greatest(q.col + j, 0), 48) GROUP BY q.row, q.col""")
def texture_contrast(spark: SparkSession, d: str) -> DataFrame:
    v = _raster(spark, d).withColumn("value", (F.col("value") - 900) / 100)
    return rounded(raster.tiles(v, 16, 3, raster.glcm_contrast(), "contrast").select("row", "col", "contrast"))


@query(f"""{R}, g AS (SELECT a.row, a.col, a.value, coalesce(w.value, a.value) AS w, coalesce(e.value, a.value) AS e, coalesce(n.value, a.value) AS n, coalesce(s.value, a.value) AS s
  FROM r a LEFT JOIN r w ON w.row = a.row AND w.col = (SELECT max(col) FROM r z WHERE z.row = a.row AND z.col < a.col) LEFT JOIN r e ON e.row = a.row AND e.col = (SELECT min(col) FROM r z WHERE z.row = a.row AND z.col > a.col)
  LEFT JOIN r n ON n.col = a.col AND n.row = (SELECT max(row) FROM r z WHERE z.col = a.col AND z.row < a.row) LEFT JOIN r s ON s.col = a.col AND s.row = (SELECT min(row) FROM r z WHERE z.col = a.col AND z.row > a.row)),
h AS (SELECT row, col, (e - w) / 500 AS gx, (s - n) / 500 AS gy, (4 * value - w - e - n - s) / 1000 AS gz FROM g)
SELECT row, col, round(sqrt(gx * gx + gy * gy), 6) AS hgm, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS asa, round(atan2(gz, sqrt(gx * gx + gy * gy)), 6) AS tilt FROM h""")
def magnetic_derivatives(spark: SparkSession, d: str) -> DataFrame:
    return rounded(raster.magnetic_derivatives(_raster(spark, d), 250.0).select("row", "col", "hgm", "asa", "tilt"))


@query(f"WITH {CELLS_SQL}, s AS (SELECT cell_id, CASE WHEN flow > 0 AND tan(radians(slope)) > 0 THEN ln(flow * tan(radians(slope))) END AS s FROM cells) SELECT cell_id, round(CASE WHEN s IS NULL THEN NULL WHEN s >= 2.5 AND s < 3 THEN (s - 2.5) / 0.5 WHEN s >= 3 AND s <= 6 THEN 1 WHEN s > 6 AND s <= 6.5 THEN (6.5 - s) / 0.5 ELSE 0 END, 6) AS spi FROM s")
def spi_band(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cells(spark, d).select("cell_id", scalar.stream_power_band(F.col("flow"), F.col("slope")).alias("spi")))


@query(f"WITH {CELLS_SQL} SELECT cell_id, round(CASE WHEN flow > 0 AND tan(radians(slope)) > 0 THEN ln(flow / tan(radians(slope))) END, 6) AS twi FROM cells")
def twi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cells(spark, d).select("cell_id", scalar.wetness_index(F.col("flow"), F.col("slope")).alias("twi")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN l_discount / l_tax END AS ratio, CASE WHEN l_discount + l_tax > 0 THEN (l_discount - l_tax) / (l_discount + l_tax) END AS nd FROM lineitem")
def spectral_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratio and normalised difference, null where the denominator isn't positive."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.safe_ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio"), scalar.normalized_difference(F.col("l_discount"), F.col("l_tax")).alias("nd"))


def _norm(spec: FeatureWeight, column: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        c = cells(spark, d)
        return rounded(c.select("cell_id", index.normalized(c, column, spec).alias("v")))

    return run


Q = "q AS (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM cells)"


@query(f"WITH {CELLS_SQL}, {Q.format(c='elevation')} SELECT cell_id, round((least(greatest(elevation, lo), hi) - lo) / (hi - lo), 6) AS v FROM cells, q")
def normalise_direct(spark: SparkSession, d: str) -> DataFrame:
    return _norm(FeatureWeight(1.0, "direct"), "elevation")(spark, d)


@query(f"WITH {CELLS_SQL}, {Q.format(c='least(flow, 600)')} SELECT cell_id, round(1 - (least(greatest(least(flow, 600), lo), hi) - lo) / (hi - lo), 6) AS v FROM cells, q")
def normalise_inverse(spark: SparkSession, d: str) -> DataFrame:
    return _norm(FeatureWeight(1.0, "inverse", cap=600.0), "flow")(spark, d)


@query(f"WITH {CELLS_SQL} SELECT cell_id, (slope <> 1)::INT::DOUBLE AS v FROM cells")
def normalise_boolean(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("slope", F.col("slope") - 1)
    return c.select("cell_id", index.normalized(c, "slope", FeatureWeight(1.0, "boolean")).alias("v"))


@query(f"WITH {CELLS_SQL} SELECT cell_id, least(greatest(slope / 25, 0), 1)::DOUBLE AS v FROM cells")
def normalise_bandpass(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("slope", F.col("slope") / 25)
    return c.select("cell_id", index.normalized(c, "slope", FeatureWeight(1.0, "bandpass")).alias("v"))


@query(f"WITH {CELLS_SQL} SELECT cell_id, round(coalesce(exp(-(flow * flow) / (2 * 300.0::DOUBLE * 300)), 0), 6) AS v FROM cells")
def normalise_gaussian(spark: SparkSession, d: str) -> DataFrame:
    return _norm(FeatureWeight(1.0, "gaussian", sigma=300.0), "flow")(spark, d)


@query(f"""WITH {CELLS_SQL}, f AS (SELECT *, CASE WHEN cell_id % 7 > 0 THEN flow * 20 END AS lode FROM cells), q AS (SELECT quantile_cont(CASE WHEN lode IS NOT NULL THEN least(lode, 15000) END, 0.01) AS l1, quantile_cont(CASE WHEN lode IS NOT NULL THEN least(lode, 15000) END, 0.99) AS h1, quantile_cont(elevation, 0.01) AS l2, quantile_cont(elevation, 0.99) AS h2, quantile_cont(slope, 0.01) AS l3, quantile_cont(slope, 0.99) AS h3 FROM f),
w AS (SELECT cell_id, (CASE WHEN lode IS NULL THEN 0 ELSE 1 - (least(greatest(least(lode, 15000), l1), h1) - l1) / (h1 - l1) END * 0.20 + (least(greatest(elevation, l2), h2) - l2) / (h2 - l2) * 0.13 + (slope > 25)::INT * 0.05 + (1 - (least(greatest(slope, l3), h3) - l3) / (h3 - l3)) * 0.01) / (0.20 + 0.13 + 0.05 + 0.01) AS raw FROM f, q),
z AS (SELECT quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM w) SELECT cell_id, round((least(greatest(raw, lo), hi) - lo) / (hi - lo), 6) AS index FROM w, z""")
def weighted_index(spark: SparkSession, d: str) -> DataFrame:
    """The default index over the features there are; weights are renewed, a missing distance adds nothing."""
    c = cells(spark, d)
    f = c.select(
        "cell_id", F.when(F.col("cell_id") % 7 > 0, F.col("flow") * 20).alias("distance_to_lode_m"), F.col("elevation").alias("catchment_au_hawkes"), (F.col("slope") > 25).cast("int").alias("is_quaternary_alluvium"), "slope",
    )
    return rounded(index.weighted_index(f).select("cell_id", "index"))


@query(f"""WITH {CELLS_SQL}, q AS (SELECT quantile_cont(elevation, 0.5) AS lo, quantile_cont(elevation, 0.99) AS hi FROM cells)
SELECT cell_id, round(cbrt(((least(greatest(elevation, lo), hi) - lo) / (hi - lo) + 1e-6) * (least(greatest(1 - slope / 30.0, 0), 1) + 1e-6) * (CASE WHEN lithology = 'SMALL' THEN 0 ELSE 1 END + 1e-6)), 6) AS terrace FROM cells, q""")
def terrace_composite(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("alluvium", F.col("lithology") == "SMALL")
    return rounded(index.terrace_likelihood(c, "elevation", "slope", "alluvium", cap=30.0).select("cell_id", "terrace"))


@query(f"""{R}, m AS (SELECT * FROM r), g AS (SELECT a.row, a.col, CASE WHEN w.value IS NULL THEN (e.value - a.value) WHEN e.value IS NULL THEN (a.value - w.value) ELSE (e.value - w.value) / 2 END AS gx,
  CASE WHEN n.value IS NULL THEN (s.value - a.value) WHEN s.value IS NULL THEN (a.value - n.value) ELSE (s.value - n.value) / 2 END AS gy, pow((a.row * 50 + a.col) * 37 % 1000 + 1, 0.45) AS p
  FROM m a LEFT JOIN m w ON w.row = a.row AND w.col = a.col - 1 LEFT JOIN m e ON e.row = a.row AND e.col = a.col + 1 LEFT JOIN m n ON n.row = a.row - 1 AND n.col = a.col LEFT JOIN m s ON s.row = a.row + 1 AND s.col = a.col),
k AS (SELECT row, col, sqrt(gx * gx + gy * gy) * p AS k FROM g) SELECT row, col, round((k - (SELECT min(k) FROM k)) / ((SELECT max(k) FROM k) - (SELECT min(k) FROM k)), 6) AS ksn FROM k""")
def channel_steepness(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).select("row", "col", F.col("elevation").alias("value"), "flow")
    return rounded(raster.channel_steepness(raster.slope_tri(c, 1.0)).select("row", "col", "ksn"))


FEATURES_SQL = {
    "distance_to_lode_m": "CASE WHEN cell_id % 7 > 0 THEN flow * 20 END", "tertiary_terrace_likelihood": "slope / 50", "paleochannel_likelihood": "(elevation - 900) / 100", "hydraulic_pit_proximity_m_buffered": "flow * 7",
    "catchment_au_hawkes": "elevation", "is_quaternary_alluvium": "CAST(slope > 25 AS INT)", "distance_to_lithological_contact_m": "slope * 100", "twi": "flow / 100", "slope": "slope",
    "distance_downstream_from_lode_m": "CASE WHEN cell_id % 5 > 0 THEN flow * 30 END", "spi_band": "slope / 25", "ksn": "flow * 3", "flow_acc": "flow * 2", "catchment_as_hawkes": "elevation / 2", "catchment_sb_hawkes": "slope * 2",
}


def _index_sql(weights: dict[str, FeatureWeight]) -> str:
    def part(name: str, w: FeatureWeight) -> str:
        scaled = f"(least(greatest({name}, lo_{name}), hi_{name}) - lo_{name}) / (hi_{name} - lo_{name})"
        return {
            "direct": scaled, "inverse": f"(1 - {scaled})", "boolean": f"({name} <> 0)::INT", "bandpass": f"least(greatest({name}, 0), 1)", "gaussian": f"exp(-{name} * {name} / (2 * {w.sigma or 1}::DOUBLE * {w.sigma or 1}))",
        }[w.direction]

    ends = ", ".join(f"quantile_cont({n}, {q}) AS {p}_{n}" for n in weights for p, q in (("lo", 0.01), ("hi", 0.99)))
    total = " + ".join(f"coalesce({part(n, w)}, 0) * {w.weight}::DOUBLE" for n, w in weights.items())
    return f"""WITH {CELLS_SQL}, f AS (SELECT cell_id, {', '.join(f'{FEATURES_SQL[n]} AS {n}' for n in weights)} FROM cells), q AS (SELECT {ends} FROM f), w AS (SELECT cell_id, ({total}) / {sum(w.weight for w in weights.values())}::DOUBLE AS raw FROM f, q),
z AS (SELECT quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM w) SELECT cell_id, round((least(greatest(raw, lo), hi) - lo) / (hi - lo), 6) AS index FROM w, z"""


def _population(spark: SparkSession, d: str, weights: dict[str, FeatureWeight]) -> DataFrame:
    f = cells(spark, d).selectExpr("cell_id", *(f"{FEATURES_SQL[n]} AS {n}" for n in weights))
    return rounded(index.weighted_index(f, weights).select("cell_id", "index"))


@query(_index_sql(index.TERTIARY))
def tertiary_index(spark: SparkSession, d: str) -> DataFrame:
    """The index with the weights for older gravels."""
    return _population(spark, d, index.TERTIARY)


@query(_index_sql(index.QUATERNARY))
def quaternary_index(spark: SparkSession, d: str) -> DataFrame:
    """The index with the weights for modern channels."""
    return _population(spark, d, index.QUATERNARY)
