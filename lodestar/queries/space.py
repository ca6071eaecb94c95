"""Spatial joins, grids, networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters, network, spatial
from .registry import ANCHORS_SQL, CELLS_SQL, POLYGONS_SQL, SAMPLES_SQL, anchors, cells, grid, polygons, query, rounded, samples, table

GRID_SQL = "g AS (SELECT max(p_partkey) // 50 + 1 AS n FROM part)"


@query(f"WITH {CELLS_SQL} SELECT cell_id, row, col, x, y FROM cells")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d)
    return g.cells(spark).join(cells(spark, d).select("cell_id"), "cell_id", "left_semi")


@query(f"WITH {SAMPLES_SQL}, {GRID_SQL} SELECT sample_id, CAST(floor(y / 250) AS BIGINT) AS row, CAST(floor(x / 250) AS BIGINT) AS col FROM samples, g WHERE floor(x / 250) BETWEEN 0 AND 49 AND floor(y / 250) BETWEEN 0 AND n - 1")
def assign_cells(spark: SparkSession, d: str) -> DataFrame:
    return spatial.assign_cells(samples(spark, d), grid(spark, d)).select("sample_id", "row", "col")


@query(f"WITH {SAMPLES_SQL} SELECT sample_id, x, y FROM samples WHERE x BETWEEN 2000 AND 6000 AND y BETWEEN 1000 AND 4000")
def bbox_clip(spark: SparkSession, d: str) -> DataFrame:
    from ..model import Area
    from ..sources.readers import clip

    return clip(samples(spark, d), Area(2000, 1000, 6000, 4000)).select("sample_id", "x", "y")


RADIUS_SQL = f"""WITH {CELLS_SQL}, {SAMPLES_SQL}, near AS (
  SELECT c.cell_id, c.row, c.col, avg(s.price) AS price_mean, max(s.price) AS price_max, count(s.price) AS price_count
  FROM cells c LEFT JOIN samples s ON s.x BETWEEN c.x - 500 AND c.x + 500 AND s.y BETWEEN c.y - 500 AND c.y + 500 AND sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) <= 500 GROUP BY ALL)
SELECT cell_id, row, col, round(price_mean, 6) AS price_mean, round(price_max, 6) AS price_max, price_count, CAST(price_count > 0 AS INT) AS price_has_data FROM near"""


@query(RADIUS_SQL)
def radius_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Mean, max and count of samples within 500 m of each cell."""
    c = cells(spark, d).select("cell_id", "row", "col")
    found = spatial.radius_aggregate(samples(spark, d), grid(spark, d), 500.0, ["price"])
    out = c.join(found, ["row", "col"], "left").withColumns({"price_count": F.coalesce("price_count", F.lit(0)), "price_has_data": F.coalesce("price_has_data", F.lit(0))})
    return rounded(out).select("cell_id", "row", "col", "price_mean", "price_max", "price_count", "price_has_data")


@query(f"""WITH {CELLS_SQL}, {ANCHORS_SQL} SELECT c.cell_id, count(a.anchor_id) AS n, CAST(coalesce(count(*) FILTER (a.value > 0), 0) AS BIGINT) AS n_positive, coalesce(max(a.value), 0) AS best
FROM cells c LEFT JOIN anchors a ON sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y)) <= 1000 GROUP BY c.cell_id""")
def radius_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.cells_within(anchors(spark, d), grid(spark, d), 1000.0).groupBy("row", "col").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("n_positive"), F.max("value").alias("best"))
    out = cells(spark, d).select("cell_id", "row", "col").join(near, ["row", "col"], "left")
    return out.select("cell_id", *[F.coalesce(c, F.lit(z)).alias(c) for c, z in (("n", 0), ("n_positive", 0), ("best", 0.0))])


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL} SELECT sample_id, arg_min(anchor_id, (sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)), anchor_id)) AS near_id,
  round(min(sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y))), 6) AS near_d FROM samples s, anchors a GROUP BY sample_id""")
def nearest_point(spark: SparkSession, d: str) -> DataFrame:
    """The nearest anchor of each sample, however far."""
    return rounded(spatial.nearest(samples(spark, d), anchors(spark, d), "sample_id", "anchor_id", 500.0).select("sample_id", F.col("near_id"), "near_d"))


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL}, p AS (SELECT sample_id, anchor_id, sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) AS d FROM samples s, anchors a WHERE abs(s.x - a.x) <= 800 AND abs(s.y - a.y) <= 800),
b AS (SELECT sample_id, arg_min(anchor_id, (d, anchor_id)) AS near_id, min(d) AS near_d FROM p WHERE d <= 800 GROUP BY sample_id)
SELECT s.sample_id, near_id, round(near_d, 6) AS near_d FROM samples s LEFT JOIN b USING (sample_id)""")
def nearest_capped(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.nearest_within(samples(spark, d), anchors(spark, d), 800.0, "sample_id", "anchor_id").select("sample_id", "near_id", "near_d"))


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL}, p AS (SELECT sample_id, kind, sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) AS d FROM samples s, anchors a WHERE abs(s.x - a.x) <= 1500 AND abs(s.y - a.y) <= 1500)
SELECT s.sample_id, round(min(d) FILTER (kind = 0 AND d <= 1500), 6) AS d0, round(min(d) FILTER (kind = 1 AND d <= 1500), 6) AS d1, round(min(d) FILTER (kind = 2 AND d <= 1500), 6) AS d2
FROM samples s LEFT JOIN p USING (sample_id) GROUP BY s.sample_id""")
def nearest_by_class(spark: SparkSession, d: str) -> DataFrame:
    a = anchors(spark, d).withColumn("kind", F.concat(F.lit("d"), F.col("kind").cast("string")))
    return rounded(spatial.nearest_by_class(samples(spark, d), a, "sample_id", "kind", ["d0", "d1", "d2"], 1500.0).select("sample_id", "d0", "d1", "d2"))


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL} SELECT sample_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) < 600)""")
def buffer_anti(spark: SparkSession, d: str) -> DataFrame:
    return spatial.outside(samples(spark, d), anchors(spark, d), 600.0, "sample_id", strict=True).select("sample_id")


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL} SELECT sample_id FROM samples s WHERE EXISTS (SELECT 1 FROM anchors a WHERE sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) <= 600)""")
def buffer_semi(spark: SparkSession, d: str) -> DataFrame:
    return spatial.inside(samples(spark, d), anchors(spark, d), 600.0, "sample_id").select("sample_id")


PIP = "c.x >= b.x0 AND c.x < b.x1 AND c.y >= b.y0 AND c.y < b.y1"


@query(f"WITH {CELLS_SQL}, {POLYGONS_SQL} SELECT cell_id, coalesce(arg_min(lith_class, poly_id), -1) AS lith_class FROM cells c LEFT JOIN boxes b ON {PIP} GROUP BY cell_id")
def pip_first(spark: SparkSession, d: str) -> DataFrame:
    """The class of the polygon that holds a cell; the smallest id wins, -1 outside."""
    return spatial.assign_polygon(cells(spark, d), polygons(spark, d), grid(spark, d), "lith_class").select("cell_id", "lith_class")


@query(f"WITH {CELLS_SQL}, {POLYGONS_SQL} SELECT cell_id, coalesce(bool_or(alluvium), false) AS alluvium FROM cells c LEFT JOIN boxes b ON {PIP} GROUP BY cell_id")
def pip_any_flag(spark: SparkSession, d: str) -> DataFrame:
    return spatial.any_polygon(cells(spark, d), polygons(spark, d), grid(spark, d), "alluvium").select("cell_id", "alluvium")


@query(f"""WITH {POLYGONS_SQL}, {GRID_SQL}, rr AS (SELECT unnest(range(n)) AS row FROM g), cc AS (SELECT unnest(range(50)) AS col), c AS (SELECT row, col, col * 250.0::DOUBLE + 125 AS x, row * 250.0::DOUBLE + 125 AS y FROM rr, cc),
hit AS (SELECT b.poly_id, c.row, c.col FROM c JOIN boxes b ON {PIP}),
lost AS (SELECT CAST(floor((y0 + y1) / 2 / 250) AS BIGINT) AS row, CAST(floor((x0 + x1) / 2 / 250) AS BIGINT) AS col FROM boxes WHERE poly_id NOT IN (SELECT poly_id FROM hit)),
core AS (SELECT row, col FROM hit UNION SELECT row, col FROM lost, g WHERE row BETWEEN 0 AND n - 1 AND col BETWEEN 0 AND 49),
around AS (SELECT row + dr AS row, col + dc AS col, CASE WHEN dr = 0 AND dc = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM core, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc))
SELECT row, col, max(weight) AS weight FROM around, g WHERE row BETWEEN 0 AND n - 1 AND col BETWEEN 0 AND 49 GROUP BY row, col""")
def polygon_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of cells in and around polygons."""
    return spatial.polygon_weights(polygons(spark, d), grid(spark, d))


@query(f"""WITH {CELLS_SQL}, {POLYGONS_SQL} SELECT cell_id, round(least(coalesce(min(CASE WHEN poly_id IS NOT NULL THEN sqrt(pow(greatest(x0 - c.x, c.x - x1, 0), 2) + pow(greatest(y0 - c.y, c.y - y1, 0), 2)) END), 2000), 2000), 6) AS d
FROM cells c LEFT JOIN boxes b ON c.x BETWEEN x0 - 2000 AND x1 + 2000 AND c.y BETWEEN y0 - 2000 AND y1 + 2000 GROUP BY cell_id""")
def polygon_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.polygon_distance(cells(spark, d).select("cell_id", "row", "col"), polygons(spark, d), grid(spark, d), 2000.0).select("cell_id", "d"))


@query(f"""WITH {CELLS_SQL}, {POLYGONS_SQL}, d AS (SELECT cell_id, round(least(coalesce(min(CASE WHEN poly_id IS NOT NULL THEN sqrt(pow(greatest(x0 - c.x, c.x - x1, 0), 2) + pow(greatest(y0 - c.y, c.y - y1, 0), 2)) END), 2000), 2000), 6) AS d
FROM cells c LEFT JOIN boxes b ON c.x BETWEEN x0 - 2000 AND x1 + 2000 AND c.y BETWEEN y0 - 2000 AND y1 + 2000 GROUP BY cell_id) SELECT cell_id, CASE WHEN d >= 1000 THEN d END AS d FROM d""")
def polygon_distance_buffered(spark: SparkSession, d: str) -> DataFrame:
    """Distances that would leak a label are null."""
    return rounded(spatial.polygon_distance(cells(spark, d).select("cell_id", "row", "col"), polygons(spark, d), grid(spark, d), 2000.0, buffer=1000.0).select("cell_id", "d"))


@query(f"""WITH {CELLS_SQL}, {POLYGONS_SQL} SELECT cell_id, round(least(coalesce(min(CASE WHEN poly_id IS NULL THEN NULL WHEN c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1 THEN least(c.x - x0, x1 - c.x, c.y - y0, y1 - c.y)
  ELSE sqrt(pow(greatest(x0 - c.x, c.x - x1, 0), 2) + pow(greatest(y0 - c.y, c.y - y1, 0), 2)) END), 2000), 2000), 6) AS d
FROM cells c LEFT JOIN boxes b ON c.x BETWEEN x0 - 2000 AND x1 + 2000 AND c.y BETWEEN y0 - 2000 AND y1 + 2000 GROUP BY cell_id""")
def contact_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest boundary, from inside too."""
    return rounded(spatial.polygon_distance(cells(spark, d).select("cell_id", "row", "col"), polygons(spark, d), grid(spark, d), 2000.0, boundary=True).select("cell_id", "d"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    s = anchors(spark, d)
    point = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    return s.select(F.col("anchor_id").alias("line_id"), F.array(point(0.0, 0.0), point(900.0, 0.0), point(900.0, 600.0)).alias("pts"), "kind")


@query(f"""WITH {CELLS_SQL}, {ANCHORS_SQL}, marks AS (SELECT x + i * 900.0::DOUBLE / 8 AS x, y FROM anchors, range(0, 9) t(i) UNION ALL SELECT x + 900 AS x, y + i * 600.0::DOUBLE / 5 AS y FROM anchors, range(0, 6) t(i))
SELECT cell_id, round(least(coalesce(min(sqrt((c.x - m.x) * (c.x - m.x) + (c.y - m.y) * (c.y - m.y))), 1500), 1500), 6) AS d FROM cells c LEFT JOIN marks m ON m.x BETWEEN c.x - 1500 AND c.x + 1500 AND m.y BETWEEN c.y - 1500 AND c.y + 1500 GROUP BY cell_id""")
def distance_to_fault(spark: SparkSession, d: str) -> DataFrame:
    """Distance to points every 100 m along lines."""
    return rounded(spatial.line_point_distance(cells(spark, d).select("cell_id", "row", "col"), _lines(spark, d), grid(spark, d), 100.0, 1500.0).select("cell_id", "d"))


@query(f"""WITH {CELLS_SQL}, {ANCHORS_SQL} SELECT row, col, round(max(exp(-0.5 * ((((c.x - a.x) * 0.6 + (c.y - a.y) * 0.8) / 600) * (((c.x - a.x) * 0.6 + (c.y - a.y) * 0.8) / 600)
  + ((-(c.x - a.x) * 0.8 + (c.y - a.y) * 0.6) / 200) * ((-(c.x - a.x) * 0.8 + (c.y - a.y) * 0.6) / 200)))), 6) AS weight
FROM cells c JOIN anchors a ON sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y)) <= 1200 GROUP BY row, col""")
def kernel_stamp(spark: SparkSession, d: str) -> DataFrame:
    pts = anchors(spark, d).withColumns({"ux": F.lit(0.6), "uy": F.lit(0.8)})
    w = spatial.stamp_kernel(pts, grid(spark, d), 600.0, 200.0, 1200.0).join(cells(spark, d).select("row", "col"), ["row", "col"], "left_semi")
    return rounded(w.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "weight"))


@query(f"WITH {ANCHORS_SQL}, {GRID_SQL} SELECT anchor_id, CAST(least(greatest(ceil((y - 125) / 250 - 0.5), 0), n - 1) AS BIGINT) AS row, CAST(least(greatest(ceil((x - 125) / 250 - 0.5), 0), 49) AS BIGINT) AS col FROM anchors, g")
def snap_to_cell(spark: SparkSession, d: str) -> DataFrame:
    return spatial.snap_to_cell(anchors(spark, d), grid(spark, d)).select("anchor_id", "row", "col")


@query(f"""WITH {SAMPLES_SQL}, b AS (SELECT CAST(floor(x / 2000) AS BIGINT) AS bx, CAST(floor(y / 2000) AS BIGINT) AS "by", count(*) AS n FROM samples GROUP BY ALL)
SELECT bx, "by", n, CAST(coalesce((SELECT sum(o.n) FROM b o WHERE abs(o.bx - b.bx) <= 1 AND abs(o."by" - b."by") <= 1 AND NOT (o.bx = b.bx AND o."by" = b."by")), 0) AS BIGINT) AS around FROM b""")
def block_adjacency(spark: SparkSession, d: str) -> DataFrame:
    counts = spatial.blocks(samples(spark, d), 2000.0).groupBy("bx", "by").agg(F.count("*").alias("n"))
    return spatial.block_neighbours(counts, "n")


@query("""WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{9,}')) AS v FROM documents), d AS (SELECT doc_id, coalesce(source, '') = 'src3' AS f FROM documents)
SELECT doc_id, bool_or(coalesce(t.v IN (SELECT v FROM t JOIN d USING (doc_id) WHERE f), false)) AS neighbour FROM d LEFT JOIN t USING (doc_id) GROUP BY doc_id""")
def neighbour_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Shapes that share a vertex with a flagged one (documents and their long words)."""
    docs = table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{9,}"), 0)).alias("v"), (F.coalesce("source", F.lit("")) == "src3").alias("f"))
    return spatial.shared_vertices(docs, "doc_id", "v", "f")


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL}, kept AS (SELECT sample_id, x, y FROM samples s WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) <= 300)), {CELLS_SQL}
SELECT sample_id, cells.cell_id, elevation FROM kept JOIN cells ON cells.cell_id = floor(kept.y / 250) * 50 + floor(kept.x / 250)""")
def blind_set(spark: SparkSession, d: str) -> DataFrame:
    """Samples away from all anchors, with the score of their cell."""
    kept = spatial.outside(samples(spark, d), anchors(spark, d), 300.0, "sample_id")
    at = spatial.assign_cells(kept.select("sample_id", "x", "y"), grid(spark, d))
    return at.join(cells(spark, d).select("row", "col", "cell_id", "elevation"), ["row", "col"]).select("sample_id", "cell_id", "elevation")


@query("""WITH r AS (SELECT o_orderkey AS comid, o_orderkey AS hydroseq, o_totalprice / 1000 AS arbolate, o_orderstatus FROM orders), s AS (SELECT hydroseq, arbolate FROM r WHERE o_orderstatus = 'P'),
u AS (SELECT comid, arbolate, max(CASE WHEN o_orderstatus = 'P' THEN arbolate END) OVER (ORDER BY hydroseq DESC) AS seed_max FROM r)
SELECT comid, round(seed_max, 6) AS seed_max, round(CASE WHEN arbolate - seed_max BETWEEN 0 AND 100 THEN arbolate - seed_max END, 6) AS downstream FROM u""")
def upstream_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest seed upstream of each reach and the distance down from it."""
    o = table(spark, d, "orders")
    reaches = o.select(F.col("o_orderkey").alias("comid"), F.col("o_orderkey").alias("hydroseq"), (F.col("o_totalprice") / 1000).alias("arbolate"))
    seeds = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("hydroseq"), (F.col("o_totalprice") / 1000).alias("arbolate"), F.lit("lode").alias("dep_type"))
    return rounded(network.distance_downstream(reaches, seeds, 100.0).select("comid", "seed_max", "downstream"))


@query("""WITH c AS (SELECT o_orderkey AS comid, o_orderkey AS hydroseq, o_totalprice / 1000 AS arbolate FROM orders),
s AS (SELECT l_orderkey AS hydroseq, l_extendedprice / 500 AS arbolate, l_quantity AS value FROM lineitem),
w AS (SELECT comid, exp(-greatest(s.arbolate - c.arbolate, 0) / 5) + 0.3 * exp(-greatest(s.arbolate - c.arbolate, 0) / 25) AS w, value FROM c JOIN s ON s.hydroseq >= c.hydroseq)
SELECT comid, count(*) AS n_samples, round(sum(w * value) / sum(w) * 65536) / 65536 AS catchment FROM w GROUP BY comid""")
def hawkes(spark: SparkSession, d: str) -> DataFrame:
    """Upstream samples averaged with a near and a far decay."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("comid"), F.col("o_orderkey").alias("hydroseq"), (F.col("o_totalprice") / 1000).alias("arbolate"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hydroseq"), (F.col("l_extendedprice") / 500).alias("arbolate"), F.col("l_quantity").cast("double").alias("value"))
    return network.dual_decay(c, s).withColumn("catchment", F.round(F.col("catchment") * 65536) / 65536)  # a binary grid: means of whole numbers are often decimal ties


@query(f"""WITH {SAMPLES_SQL}, h AS (SELECT sample_id, (sqrt(3.0) / 3 * x - y / 3) / 500 AS q, 2 * y / 3 / 500 AS r FROM samples), k AS (SELECT *, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM h)
SELECT CAST(CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN -rr - rs ELSE rq END AS BIGINT) AS q,
  CAST(CASE WHEN NOT (abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r)) AND abs(rr - r) > abs(rs + q + r) THEN -rq - rs ELSE rr END AS BIGINT) AS r, count(*) AS n FROM k GROUP BY ALL""")
def hex_density(spark: SparkSession, d: str) -> DataFrame:
    return spatial.hex_bins(samples(spark, d), 500.0).groupBy("q", "r").agg(F.count("*").alias("n"))


DBSCAN_SQL = f"""WITH RECURSIVE {ANCHORS_SQL}, near AS (SELECT a.anchor_id AS a, b.anchor_id AS b FROM anchors a, anchors b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 700), core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 3),
e AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)), r AS (SELECT a, a AS b FROM core UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a, min(b) AS label FROM r GROUP BY a),
border AS (SELECT near.a, min(label) AS label FROM near JOIN l ON near.b = l.a GROUP BY near.a), clusters AS (SELECT anchor_id, coalesce(l.label, border.label) AS cluster, x, y FROM anchors LEFT JOIN l ON l.a = anchor_id LEFT JOIN border ON border.a = anchor_id)"""


@query(f"{DBSCAN_SQL} SELECT anchor_id, cluster FROM clusters")
def dbscan(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of anchors."""
    return clusters.dbscan(anchors(spark, d), "anchor_id", 700.0, 3)


@query(f"""{DBSCAN_SQL}, c AS (SELECT cluster, count(*) AS n, avg(38.013 + y / 20000) AS lat, avg(-120.517 - x / 20000) AS lon FROM clusters WHERE cluster IS NOT NULL GROUP BY cluster),
p AS (SELECT n_name AS name, 38.0 + n_nationkey % 5 * 0.11 AS lat, -120.6 - n_nationkey // 5 * 0.13 AS lon FROM nation), d AS (SELECT c.cluster, p.name, sqrt((c.lat - p.lat) * (c.lat - p.lat) + pow((c.lon - p.lon) * cos(radians(c.lat)), 2)) AS d FROM c, p),
b AS (SELECT cluster, min(d) AS d, arg_min(name, (d, name)) AS name FROM d WHERE d <= 0.04 GROUP BY cluster)
SELECT c.cluster, n, round(lat, 6) AS lat, round(lon, 6) AS lon, coalesce(b.name, replace(replace('cluster_lat' || printf('%.1f', lat) || '_lon' || printf('%.1f', lon), '.', 'p'), '-', 'neg')) AS name, round(b.d, 6) AS d FROM c LEFT JOIN b USING (cluster)""")
def named_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Centres of the density clusters and the named places near them."""
    a = anchors(spark, d)
    members = clusters.dbscan(a, "anchor_id", 700.0, 3).join(a.select("anchor_id", (38.013 + F.col("y") / 20000).alias("lat"), (-120.517 - F.col("x") / 20000).alias("lon")), "anchor_id")
    key = F.col("n_nationkey")
    named = table(spark, d, "nation").select(F.col("n_name").alias("name"), (38.0 + key % 5 * 0.11).alias("lat"), (-120.6 - F.floor(key / 5) * 0.13).alias("lon"))
    return rounded(clusters.cluster_names(members, named, 0.04))


@query()
def line_tangents(spark: SparkSession, d: str) -> DataFrame:
    """Directions of the nearest lines."""
    return spatial.tangents(samples(spark, d).select("sample_id", "x", "y"), _lines(spark, d), "sample_id", 400.0)


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL} SELECT sample_id FROM samples s WHERE NOT EXISTS (SELECT 1 FROM anchors a WHERE sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) <= CASE kind WHEN 0 THEN 300 WHEN 1 THEN 450 ELSE 120 END)""")
def blind_points(spark: SparkSession, d: str) -> DataFrame:
    """Samples away from all of three kinds of known places, each with its own radius."""
    a = anchors(spark, d)
    known = [(a.where(f"kind = {k}"), r) for k, r in ((0, 300.0), (1, 450.0), (2, 120.0))]
    return spatial.outside_all(samples(spark, d).select("sample_id", "x", "y"), known, "sample_id").select("sample_id")


@query("""WITH o AS (SELECT (o_orderkey * 7919 % 12500)::DOUBLE AS x, (o_orderkey * 104729 % 10000)::DOUBLE AS y, year(o_orderdate) < 1998 AS early FROM orders), h AS (SELECT early, (sqrt(3.0) / 3 * x - y / 3) / 500 AS q, 2 * y / 3 / 500 AS r FROM o), k AS (SELECT *, round(q) AS rq, round(r) AS rr, round(-q - r) AS rs FROM h)
SELECT CAST(CASE WHEN abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) THEN -rr - rs ELSE rq END AS BIGINT) AS q,
  CAST(CASE WHEN NOT (abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r)) AND abs(rr - r) > abs(rs + q + r) THEN -rq - rs ELSE rr END AS BIGINT) AS r, count(*) FILTER (early) AS before, count(*) FILTER (NOT early) AS after FROM k GROUP BY ALL""")
def hex_periods(spark: SparkSession, d: str) -> DataFrame:
    """Records by hexagon before and from a year on."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") * 7919 % 12500).cast("double").alias("x"), (F.col("o_orderkey") * 104729 % 10000).cast("double").alias("y"), (F.year("o_orderdate") < 1998).alias("early"))
    return spatial.hex_bins(o, 500.0).groupBy("q", "r").agg(F.count_if("early").alias("before"), F.count_if(~F.col("early")).alias("after"))
