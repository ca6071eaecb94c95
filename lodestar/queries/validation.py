"""Maps against places they were not made from, fusion with context, priors, texture, and sources that come in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Area
from ..operators import raster, validation
from ..sources import adapters
from .registry import ANCHORS_SQL, CELLS_SQL, HEIGHT, SAMPLES_SQL, WIDTH, anchors, cells, grid, query, rounded, samples, scored, table

MAP_SQL = "m AS (SELECT s.cell_id, s.cell_id // 50 AS row, s.cell_id % 50 AS col, s.score, CASE WHEN s.cell_id % 13 > 0 THEN round(1 - s.score * s.score, 6) END AS other, s.positive, CASE WHEN p_size > 5 THEN p_retailprice END AS gold, p_size FROM scored s JOIN part ON p_partkey = s.cell_id)"
SCORED_SQL = "scored AS (SELECT p_partkey AS cell_id, (p_partkey * 7919 % 997) / 997.0::DOUBLE AS score, (p_partkey * 31 % 17 < CASE WHEN p_partkey * 7919 % 997 > 600 THEN 6 ELSE 2 END)::INT AS positive FROM part)"


def _map(spark: SparkSession, d: str) -> DataFrame:
    """Cells with two scores (one with gaps), positives and a context with gaps."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("cell_id"), F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("gold"), "p_size")
    m = scored(spark, d).join(p.hint("merge"), "cell_id")  # all cells: a broadcast would send them through the driver
    return m.withColumns({"row": F.expr("cell_id div 50"), "col": F.col("cell_id") % 50, "other": F.when(F.col("cell_id") % 13 > 0, F.round(1 - F.col("score") * F.col("score"), 6))})


@query(f"""WITH {SCORED_SQL}, {MAP_SQL}, u AS (SELECT 'score' AS score, score AS s, * EXCLUDE (score, other) FROM m UNION ALL SELECT 'other', other, * EXCLUDE (score, other) FROM m)
SELECT score, count(*) FILTER (b) AS n_inside, coalesce(sum(positive) FILTER (b), 0)::BIGINT AS positives_inside, count(*) FILTER (v) AS n_barren, coalesce(sum(positive) FILTER (v), 0)::BIGINT AS positives_barren, round(median(s) FILTER (b), 6) AS median_inside,
  round(median(s) FILTER (NOT b), 6) AS median_outside, round(median(s) FILTER (v), 6) AS median_barren, round(median(s) FILTER (b) / greatest(median(s) FILTER (NOT b), 1e-6), 6) AS lift, round(corr(s, gold), 6) AS corr, count(*) FILTER (s IS NOT NULL AND gold IS NOT NULL) AS n_corr
FROM (SELECT *, col BETWEEN 15 AND 30 AND row >= 3 AS b, col <= 4 AS v FROM u) GROUP BY score""")
def region_validation(spark: SparkSession, d: str) -> DataFrame:
    """Two scores in a belt, outside it and in a barren region."""
    return rounded(validation.region_validation(_map(spark, d), F.col("col").between(15, 30) & (F.col("row") >= 3), F.col("col") <= 4, ["score", "other"], "positive", "gold"))


@query(f"""WITH {SCORED_SQL}, {MAP_SQL}, {ANCHORS_SQL}, g AS (SELECT max(p_partkey) // 50 + 1 AS n FROM part), r AS (SELECT row, col, other, rank() OVER (ORDER BY other DESC) - 1 AS higher, count(*) OVER () AS n FROM m WHERE other IS NOT NULL),
a AS (SELECT anchor_id, CAST(least(greatest(ceil((y - 125) / 250 - 0.5), 0), n - 1) AS BIGINT) AS row, CAST(least(greatest(ceil((x - 125) / 250 - 0.5), 0), 49) AS BIGINT) AS col FROM anchors, g)
SELECT anchor_id, row, col, round(other, 6) AS score, higher AS n_higher, round(100.0 * (n - higher) / n, 6) AS percentile, round(100.0 * higher / n, 6) AS top_pct FROM a LEFT JOIN r USING (row, col)""")
def map_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Where the cells nearest to external points stand in the map; cells without a score have no place."""
    got = validation.map_percentile(anchors(spark, d), _map(spark, d), grid(spark, d), "other")
    return rounded(got.select("anchor_id", "row", "col", F.col("other").alias("score"), "n_higher", "percentile", "top_pct"))


@query()
def context_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two calibrated scores and context in one probability (tests hold it against a fit of its own)."""
    m = _map(spark, d).withColumns({"a": F.when(F.col("cell_id") % 7 > 1, F.col("score")), "b": F.when(F.col("cell_id") % 7 != 1, F.col("other")), "size": F.col("p_size") / 50})
    return validation.context_fusion(m, ["a", "b"], ["gold", "size"], "positive")[0].select("cell_id", "p_combined")


@query()
def subarea_prior(spark: SparkSession, d: str) -> DataFrame:
    """Prior of the cells around the centre of the positives, from a forest over the whole map."""
    m = _map(spark, d).join(cells(spark, d).select("cell_id", "x", "y").hint("merge"), "cell_id")
    return validation.subarea_prior(m, ["score", "p_size", "gold"], "positive", 6000.0, trees=20)


def _unit(seed: int) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || s_suppkey::VARCHAR), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


STRIP_SQL = f"""strip AS (SELECT s_nationkey % 2 AS kind, 500 + {_unit(9)} * {WIDTH - 1000} AS sx, 500 + {_unit(10)} * {HEIGHT - 1000} AS sy, {_unit(11)} * pi() AS t, (1 + floor({_unit(12)} * 2)) * 125 AS w, (4 + floor({_unit(13)} * 7)) * 125 AS l FROM supplier)"""


@query(f"""WITH {CELLS_SQL}, {STRIP_SQL}, hit AS (SELECT DISTINCT cell_id, kind FROM cells, strip WHERE abs((x - sx) * cos(t) + (y - sy) * sin(t)) <= l AND abs((y - sy) * cos(t) - (x - sx) * sin(t)) <= w)
SELECT cell_id, round(0.3 + coalesce((SELECT sum(CASE kind WHEN 0 THEN 0.25 ELSE 0.15 END) FROM hit WHERE hit.cell_id = cells.cell_id), 0), 6)::DOUBLE AS mean FROM cells""")
def domain_means(spark: SparkSession, d: str) -> DataFrame:
    """Prior mean of every cell: a base, and a boost in each of two kinds of strips whose place and direction are drawn from keys."""
    drawn = validation.strips(table(spark, d, "supplier"), "s_suppkey", (0.0, 0.0, float(WIDTH), float(HEIGHT)), (1, 2), (4, 10), 250.0, 9, 500.0)
    kinds = [(drawn.where(F.col("s_nationkey") % 2 == k), b) for k, b in ((0, 0.25), (1, 0.15))]
    return rounded(validation.domain_means(cells(spark, d), grid(spark, d), kinds, 0.3).select("cell_id", "mean"))


@query(f"""WITH {CELLS_SQL}, e AS (SELECT quantile_cont(elevation, 0.05) AS lo, quantile_cont(elevation, 0.95) AS hi FROM cells), q AS (SELECT row, col, floor(greatest(least((elevation - lo) / greatest(hi - lo, 1e-9), 1), 0) * 15)::DOUBLE AS q FROM cells, e),
p AS (SELECT a.row, a.col, a.q AS i, b.q AS j FROM q a JOIN q b ON b.row = a.row AND b.col = a.col + 1),
w AS (SELECT q.row, q.col, count(*) AS n, avg((i - j) * (i - j)) AS d2, avg(abs(i - j)) AS d1, avg(1 / (1 + (i - j) * (i - j))) AS h, avg(i + j) / 2 AS m, avg(i * i + j * j) / 2 AS ss, avg(i * j) AS ij FROM q JOIN p ON p.row BETWEEN q.row - 2 AND q.row + 2 AND p.col BETWEEN q.col - 2 AND q.col + 1 GROUP BY q.row, q.col)
SELECT q.row, q.col, round(d2, 6) AS contrast, round(d1, 6) AS dissimilarity, round(h, 6) AS homogeneity, round(CASE WHEN n IS NULL THEN NULL WHEN ss - m * m > 1e-12 THEN (ij - m * m) / (ss - m * m) ELSE 1 END, 6) AS correlation FROM q LEFT JOIN (SELECT * FROM w WHERE n = 20) w USING (row, col)""")
def texture(spark: SparkSession, d: str) -> DataFrame:
    """Four properties of co-occurring levels around each cell."""
    return rounded(raster.texture(cells(spark, d).select("row", "col", F.col("elevation").alias("value"))).drop("value"))


AREA = Area(1000.0, 1000.0, 9000.0, 8000.0)


@query(f"""WITH {ANCHORS_SQL}, r AS (SELECT x, y, anchor_id, kind, CASE WHEN kind < 2 THEN [' Gold ', 'Copper', '', NULL][anchor_id % 4 + 1] END AS c1, CASE WHEN kind > 0 THEN ['Silver', ' ', 'Zinc'][anchor_id % 3 + 1] END AS c2 FROM anchors),
q AS (SELECT *, concat_ws(',', nullif(lower(trim(c1)), ''), nullif(lower(trim(c2)), '')) AS s FROM r WHERE x BETWEEN 1000 AND 9000 AND y BETWEEN 1000 AND 8000)
SELECT x, y, s AS commodity, anchor_id::VARCHAR AS raw_record_id, CASE WHEN contains(s, 'gold') THEN 'usgs:36a,usgs:36b' WHEN contains(s, 'copper') THEN 'usgs:21a,usgs:21b' WHEN contains(s, 'zinc') THEN 'usgs:32a' ELSE '' END AS codes FROM q""")
def state_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of three states whose files have different columns, cut to an area."""
    a = anchors(spark, d).withColumn("id", F.col("anchor_id"))
    c1 = F.get(F.array(F.lit(" Gold "), F.lit("Copper"), F.lit(""), F.lit(None)), (F.col("id") % 4).cast("int")).alias("commod1")
    c2 = F.get(F.array(F.lit("Silver"), F.lit(" "), F.lit("Zinc")), (F.col("id") % 3).cast("int")).alias("commod2")
    states = [a.where("kind = 0").select("x", "y", "id", c1), a.where("kind = 1").select("x", "y", "id", c1, c2), a.where("kind = 2").select("id", "x", "y", c2)]
    got = adapters.mrds_states(states, AREA)
    return got.select("x", "y", "commodity", "raw_record_id", F.array_join("deposit_codes", ",").alias("codes"))


@query(f"""WITH {ANCHORS_SQL} SELECT anchor_id FROM anchors WHERE anchor_id % 5 IN (0, 1, 3) AND x BETWEEN 1000 AND 9000 AND y BETWEEN 1000 AND 8000""")
def quadrangle_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of two quadrangles by label, and inside an area."""
    label = F.get(F.array(*map(F.lit, (" tc", "Tanacross ", "MH", "nome", "BD"))), (F.col("anchor_id") % 5).cast("int"))
    return adapters.quadrangles(anchors(spark, d).withColumn("QUAD_250", label), ["TC", "NM"], AREA).select("anchor_id")


COUNTIES = {"Butte": Area(0, 0, 6000, 5000), "Yuba": Area(4000, 3000, 9000, 9000), "Amador": Area(8000, 0, 12500, 4000)}


@query(f"""WITH {ANCHORS_SQL}, b AS (SELECT * FROM (VALUES ('Butte', 0, 0, 6000, 5000), ('Yuba', 4000, 3000, 9000, 9000), ('Amador', 8000, 0, 12500, 4000)) t(place, w, s, e, n)),
l AS (SELECT anchor_id, ['BUTTE County', 'Yuba / Butte', NULL, 'amador'][anchor_id % 4 + 1] AS c FROM anchors)
SELECT 'box' AS rule, place, anchor_id FROM anchors, b WHERE x BETWEEN w AND e AND y BETWEEN s AND n UNION ALL SELECT 'name', place, anchor_id FROM l, b WHERE contains(lower(c), lower(place))""")
def county_records(spark: SparkSession, d: str) -> DataFrame:
    """Records by county: by name where the table has one, else by box."""
    a = anchors(spark, d).select("anchor_id", "x", "y")
    named = a.withColumn("F_COUNTY", F.get(F.array(F.lit("BUTTE County"), F.lit("Yuba / Butte"), F.lit(None), F.lit("amador")), (F.col("anchor_id") % 4).cast("int")))
    by = lambda rule, df: adapters.counties(df, COUNTIES).select(F.lit(rule).alias("rule"), "place", "anchor_id")
    return by("box", a).unionAll(by("name", named))


@query(f"""WITH {SAMPLES_SQL}, l AS (SELECT sample_id AS comid, x, y, x + 300 AS x2, y - 200 AS y2, (sample_id % 8 + 1) % 3 AS lacks, grade FROM samples)
SELECT comid, coalesce(CASE WHEN lacks > 0 THEN (comid % 7)::INT END, 0) AS stream_order, CASE WHEN lacks > 0 THEN grade END AS arbolate_sum FROM l WHERE x <= 9500 AND x2 >= 500 AND y2 <= 8500 AND y >= 500""")
def unit_flowlines(spark: SparkSession, d: str) -> DataFrame:
    """Flow lines of two overlapping drainage units near an area, with attributes where their unit has them."""
    s = samples(spark, d).withColumn("lacks", (F.col("sample_id") % 8 + 1) % 3)
    line = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct((F.col("x") + 300).alias("x"), (F.col("y") - 200).alias("y")))
    lines = s.select(F.col("sample_id").cast("double").alias("nhdplusid"), line.alias("pts"), F.lit(460.0).alias("fcode"), "x")
    more = s.where("lacks > 0").select(F.col("sample_id").cast("double").alias("nhdplusid"), F.col("grade").alias("arbolatesu"), (F.col("sample_id") % 7).alias("streamorde"), F.lit(1.0).alias("hydroseq"), F.lit(0.5).alias("slope"))
    west, east = F.col("x") < 6000, F.col("x") >= 5000
    units = [(lines.where(west).drop("x"), more), (lines.where(east).drop("x"), more)]
    return adapters.nhdplus_units(units, AREA, 500.0).select("comid", "stream_order", "arbolate_sum")
