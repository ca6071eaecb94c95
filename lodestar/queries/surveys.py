"""Adapters of public surveys: raw columns are derived from the test tables, the canonical rows compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import learning, network, ranking, raster, relational, sampling, spatial
from ..sources.adapters import COMMODITY_CODES, LITHOLOGY, get_adapter
from .projections import shifted_sql
from .registry import ANCHORS_SQL, CELLS_SQL, POLYGONS_SQL, SAMPLES_SQL, SCORED_SQL, anchors, cells, polygons, query, rounded, samples, scored, table

PLACE = ("cast({k} % 1000 as double) + 0.5 as x", "cast({k} % 777 as double) + 0.25 as y")
PLACE_SQL = "({k} % 1000)::DOUBLE + 0.5 AS x, ({k} % 777)::DOUBLE + 0.25 AS y"


def _raw(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    return table(spark, d, name).selectExpr(*(p.format(k=key) for p in PLACE), *columns)


def _occurrences(source: str, raw: DataFrame, *more: str) -> DataFrame:
    got = get_adapter("occurrences", source)(raw)
    return got.select("x", "y", "commodity", F.array_join("deposit_codes", ",").alias("codes"), "source", "raw_record_id", *more)


@query(rf"""SELECT {PLACE_SQL.format(k='s_suppkey')}, s_name AS commodity, 'ARDF' AS source, 'A' || s_suppkey AS raw_record_id,
  array_to_string(list_transform(regexp_extract_all(lower((s_nationkey % 40) || 'A, ' || (s_suppkey % 130) || '; ' || s_name), '\b(\d{{1,2}}[a-z]?)\b', 1), lambda c: 'usgs:' || c), ',') AS codes FROM supplier""")
def adapt_ardf(spark: SparkSession, d: str) -> DataFrame:
    model = "concat(cast(s_nationkey % 40 as string), 'A, ', cast(s_suppkey % 130 as string), '; ', s_name) as model_code"
    return _occurrences("ardf", _raw(spark, d, "supplier", "s_suppkey", "s_name as comm_main", model, "concat('A', s_suppkey) as ardf_num"))


@query(f"""WITH r AS (SELECT *, lower(trim(' ' || substr(c_mktsegment, 1, 3))) AS a, CASE c_nationkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE 'l0' || c_nationkey % 7 END AS b FROM customer)
SELECT {PLACE_SQL.format(k='c_custkey')}, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ', Gold' ELSE '' END AS commodity, 'bc:' || a || CASE WHEN b IN ('*', 'nan', '') THEN '' ELSE ',bc:' || b END AS codes, 'BC_MINFILE' AS source, c_name AS raw_record_id FROM r""")
def adapt_bc_minfile(spark: SparkSession, d: str) -> DataFrame:
    second = "case c_nationkey % 4 when 0 then '*' when 1 then 'nan' when 2 then '' else concat('L0', c_nationkey % 7) end as deposit_type_code2"
    return _occurrences("bc_minfile", _raw(
        spark, d, "customer", "c_custkey", "concat(' ', substr(c_mktsegment, 1, 3)) as deposit_type_code1", second, "c_mktsegment as commodity_description1",
        "case when c_custkey % 3 = 0 then ' Gold ' end as commodity_description2", "'nan' as commodity_description3", "c_name as mineral_file_number",
    ))


COMMODITY = "element_at(array('Gold, silver', 'Copper', 'Lead-zinc', 'aura', 'Tungsten', 'zinc; gold', null), cast(p_partkey % 7 + 1 as int))"
CODES_SQL = " ".join(f"WHEN contains(s, '{name}') THEN {'CASE WHEN placer THEN ' + chr(39) * 2 + ' ELSE ' if name in ('au', 'gold') else ''}'{','.join(own)}'{' END' if name in ('au', 'gold') else ''}" for name, own in COMMODITY_CODES)


@query(f"""WITH r AS (SELECT *, ['Gold, silver', 'Copper', 'Lead-zinc', 'aura', 'Tungsten', 'zinc; gold', NULL][p_partkey % 7 + 1] AS c, CASE p_partkey % 5 WHEN 0 THEN 'Stream Placer' WHEN 1 THEN 'black sand' WHEN 2 THEN NULL ELSE p_brand END AS dep,
  CASE WHEN p_partkey % 11 = 0 THEN 'Surface-Placer' END AS oper FROM part), q AS (SELECT *, lower(c) AS s, coalesce(regexp_matches(dep, 'placer|alluvial|black.?sand|residual|eluvial', 'i'), false) OR coalesce(contains(lower(oper), 'placer'), false) AS placer FROM r)
SELECT {PLACE_SQL.format(k='p_partkey')}, c AS commodity, CASE {CODES_SQL} ELSE '' END AS codes, 'MRDS' AS source, p_partkey::VARCHAR AS raw_record_id FROM q""")
def adapt_mrds(spark: SparkSession, d: str) -> DataFrame:
    dep = "case p_partkey % 5 when 0 then 'Stream Placer' when 1 then 'black sand' when 2 then null else p_brand end as dep_type"
    return _occurrences("mrds", _raw(spark, d, "part", "p_partkey", f"{COMMODITY} as commodity", dep, "case when p_partkey % 11 = 0 then 'Surface-Placer' end as oper_type", "p_partkey as id"))


@query(f"""WITH r AS (SELECT *, ['Placer Mine', 'Mine Shaft', 'Gravel Pit', 'Diggings', 'Adit'][o_orderkey % 5 + 1] AS t FROM orders)
SELECT {PLACE_SQL.format(k='o_orderkey')}, 'au gold' AS commodity, 'usgs:39a,usgs:39b' AS codes, 'USMIN' AS source, CASE WHEN o_orderkey % 6 = 0 THEN '-1' ELSE o_orderkey::VARCHAR END AS raw_record_id, t AS ftr_type, o_orderpriority AS ftr_name, o_orderstatus AS topo_name
FROM r WHERE t IN ('Placer Mine', 'Gravel Pit', 'Diggings')""")
def adapt_usmin(spark: SparkSession, d: str) -> DataFrame:
    kind = "element_at(array('Placer Mine', 'Mine Shaft', 'Gravel Pit', 'Diggings', 'Adit'), cast(o_orderkey % 5 + 1 as int)) as ftr_type"
    raw = _raw(spark, d, "orders", "o_orderkey", kind, "case when o_orderkey % 6 = 0 then 'x1' else cast(o_orderkey as string) end as gda_id", "o_orderpriority as ftr_name", "o_orderstatus as topo_name")
    return _occurrences("usmin", raw, "ftr_type", "ftr_name", "topo_name")


@query(f"WITH {POLYGONS_SQL} SELECT round((x0 + x1) / 2, 4) AS x, round((y0 + y1) / 2, 4) AS y, 'au gold' AS commodity, 'usgs:39a' AS codes, 'HYDRAULIC_PITS' AS source, poly_id::VARCHAR AS raw_record_id FROM boxes")
def adapt_hydraulic_pits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_occurrences("hydraulic_pits", polygons(spark, d).withColumnRenamed("poly_id", "pit_id")), 4)


@query("""SELECT o_orderkey AS ddpd_id, max(CASE WHEN l_returnflag = 'A' AND l_quantity >= 10 THEN l_quantity - 10 END) AS "Au_ppm", max(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS "Cu_ppm"
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def adapt_agdb4(spark: SparkSession, d: str) -> DataFrame:
    """One value table per element; below detection is null."""
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "ddpd_id")
    tables = {"Au": li.where("l_returnflag = 'A'").selectExpr("ddpd_id", "l_quantity - 10 as value"), "Cu": li.where("l_returnflag = 'R'").selectExpr("ddpd_id", "l_tax as value")}
    return get_adapter("geochem", "agdb4")(table(spark, d, "orders").select(F.col("o_orderkey").alias("ddpd_id")), tables)


ROW = "l_orderkey * 8 + l_linenumber"
CHEM_SQL = "SELECT {place}, ({row})::VARCHAR AS sample_id, '{source}' AS source, "


@query(f"""SELECT {PLACE_SQL.format(k=f'({ROW})')}, ({ROW})::VARCHAR AS sample_id, 'BCGS_RGS_2020' AS source, l_returnflag AS sample_type, CAST(l_shipdate AS DATE)::VARCHAR AS sample_date,
  round(CASE WHEN l_quantity - 10 > 0 THEN (l_quantity - 10) * 1e-3 WHEN l_tax > 0 THEN l_tax * 1e-3 END, 9) AS "Au_ppm", round(CASE WHEN l_discount > 0 THEN l_discount END, 9) AS "Cu_ppm" FROM lineitem""")
def adapt_bcgs_rgs(spark: SparkSession, d: str) -> DataFrame:
    """The first positive of an element's methods, scaled to ppm."""
    raw = _raw(spark, d, "lineitem", f"({ROW})", f"{ROW} as MASTERID", "l_returnflag as type2", "cast(cast(l_shipdate as date) as string) as date", "l_quantity - 10 as AU_FA_PPB", "l_tax as AU_INA_PPB", "l_discount as CU_AAS_PPM")
    got = get_adapter("geochem", "bcgs_rgs")(raw, ("Au", "Cu"))
    return rounded(got.withColumn("sample_date", F.date_format("sample_date", "yyyy-MM-dd")), 9)


NURE_SQL = f"(SELECT *, -124 + x / 12500 * 8 AS lon0, 34 + y / 10000 * 6 AS lat0 FROM (SELECT *, {PLACE_SQL.format(k=f'({ROW})')} FROM lineitem WHERE l_linenumber <> 3))"


@query(f"""SELECT round(lon, 8) AS x, round(lat, 8) AS y, ({ROW})::VARCHAR AS sample_id, 'NURE' AS source, CASE WHEN l_quantity >= 10 THEN l_quantity - 10 END AS "Au_ppm", l_discount * 1000 AS "Au_ppb", l_tax AS "U_ppm", l_tax AS "Fe_pct"
  FROM {shifted_sql('lon0', 'lat0', NURE_SQL, 'l_orderkey, l_linenumber, l_quantity, l_discount, l_tax')}""")
def adapt_nure(spark: SparkSession, d: str) -> DataFrame:
    """Element columns by name with their units, rows without a place left out, negatives null, places moved to the world datum."""
    return rounded(get_adapter("geochem", "nure_iicpms")(_nure(spark, d)), 8)


def _nure(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d, "lineitem", f"({ROW})", f"{ROW} as lab_id", "l_quantity - 10 as Au_ppm", "l_discount * 1000 as Au_ppb", "l_tax as U_sq_ppm", "l_tax as Fe_pct", "l_discount as other", "l_linenumber")
    placed = raw.withColumns({"x": F.when(F.col("l_linenumber") != 3, -124 + F.col("x") / 12500 * 8), "y": 34 + F.col("y") / 10000 * 6})
    return placed.drop("l_linenumber")


@query(f"""SELECT {PLACE_SQL.format(k=f'({ROW})')}, ({ROW})::VARCHAR AS sample_id, round(coalesce(CASE WHEN l_quantity >= 10 THEN l_quantity - 10 END, l_discount * 1000 / 1000), 8) AS au_in_ppm, round(l_tax * 10000, 8) AS fe_in_ppm FROM lineitem WHERE l_linenumber <> 3""")
def adapt_nure_ppm(spark: SparkSession, d: str) -> DataFrame:
    """Two elements in ppm, whatever their units, places left as they are."""
    got = get_adapter("geochem", "nure_iicpms")(_nure(spark, d), ["Au", "Fe"], in_ppm=True, datum=None)
    back = got.select(F.round((F.col("x") + 124) * 12500 / 8, 6).alias("x"), F.round((F.col("y") - 34) * 10000 / 6, 6).alias("y"), "sample_id", F.col("Au_ppm").alias("au_in_ppm"), F.col("Fe_ppm").alias("fe_in_ppm"))
    return rounded(back, 8)


@query(f"""SELECT {PLACE_SQL.format(k=f'({ROW})')}, ({ROW})::VARCHAR AS sample_id, 'NGDB' AS source, l_returnflag AS sample_type, CAST(l_shipdate AS DATE)::VARCHAR AS sample_date, l_quantity AS "Au_ppm" FROM lineitem""")
def adapt_ngdb(spark: SparkSession, d: str) -> DataFrame:
    """Of the elements asked for, those that the table has."""
    raw = _raw(spark, d, "lineitem", f"({ROW})", f"{ROW} as lab_id", "l_returnflag as primary_class", "cast(cast(l_shipdate as date) as string) as date_collect", "l_quantity as Au_ppm", "l_tax as Cu_ppm")
    got = get_adapter("geochem", "ngdb")(raw, ["Au", "Zn"])
    return got.select("x", "y", "sample_id", "source", "sample_type", F.date_format("sample_date", "yyyy-MM-dd").alias("sample_date"), "Au_ppm")


LITHS = ["Metamorphic, schist", "Igneous, volcanic", "Water", "nothing known", "Sedimentary, carbonate", "Melange", "Unconsolidated, undifferentiated"]
AGES = ["Late Jurassic", "Cretaceous", "EARLY PALEOZOIC", "none", "Proterozoic", "Holocene"]
PICK = "element_at(array({v}), cast({k} % {n} + 1 as int))"
GROUP_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LITHOLOGY.items() if k in LITHS)


def _pick(values: list[str], key: str) -> str:
    return PICK.format(v=", ".join(f"'{v}'" for v in values), k=key, n=len(values))


@query(f"""WITH r AS (SELECT p_partkey AS poly_id, {LITHS}[p_partkey % {len(LITHS)} + 1] AS lith, {AGES}[p_partkey % {len(AGES)} + 1] AS age, p_brand FROM part), f AS (SELECT p_brand, row_number() OVER (ORDER BY min(poly_id)) - 1 AS code FROM r GROUP BY p_brand)
SELECT poly_id, CASE trim(lith) {GROUP_SQL} ELSE 'other' END AS lith_group, CASE WHEN lower(age) LIKE '%jurassic%' THEN 'mesozoic' WHEN lower(age) LIKE '%cretaceous%' THEN 'mesozoic' WHEN lower(age) LIKE '%paleozoic%' THEN 'paleozoic'
  WHEN lower(age) LIKE '%proterozoic%' THEN 'proterozoic' ELSE 'unknown' END AS age_era, CAST(code AS INT) AS lith_class, 'USGS_SGMC' AS source FROM r JOIN f USING (p_brand)""")
def adapt_sgmc(spark: SparkSession, d: str) -> DataFrame:
    """Lithology groups by dictionary, eras by keyword, codes by first appearance."""
    raw = _raw(spark, d, "part", "p_partkey", "p_partkey as poly_id", f"concat({_pick(LITHS, 'p_partkey')}, ' ') as generalized_lith", f"{_pick(AGES, 'p_partkey')} as age_min", "cast(null as string) as age_max", "p_brand as unit_link")
    return get_adapter("geology", "usgs_sgmc")(raw).select("poly_id", "lith_group", "age_era", "lith_class", "source")


UNITS = ["Qal", "Kgr", "Jv", "Pzm", "Ts", "", "nan", "Q", "X", "Qoa"]


@query(f"""WITH r AS (SELECT p_partkey AS poly_id, CASE WHEN {UNITS}[p_partkey % 10 + 1] IN ('', 'nan') THEN CASE WHEN p_partkey % 4 = 0 THEN 'Tb' ELSE '(none)' END ELSE {UNITS}[p_partkey % 10 + 1] END AS p FROM part), f AS (SELECT p, row_number() OVER (ORDER BY min(poly_id)) - 1 AS code FROM r GROUP BY p)
SELECT poly_id, r.p AS ptype, CASE WHEN r.p LIKE 'Q%' THEN 'surficial' WHEN r.p = 'Kgr' THEN 'intrusive' WHEN r.p IN ('Jv', 'Tb') THEN 'volcanic' WHEN r.p = 'Ts' THEN 'sedimentary' ELSE 'other' END AS lith_group, r.p IN ('Qal', 'Q', 'Qoa') AS is_quaternary_alluvium, CAST(code AS INT) AS lith_class FROM r JOIN f USING (p)""")
def adapt_cgs_2010(spark: SparkSession, d: str) -> DataFrame:
    """Unit types with a fallback column, grouped by ordered patterns."""
    raw = _raw(spark, d, "part", "p_partkey", "p_partkey as poly_id", f"{_pick(UNITS, 'p_partkey')} as PTYPE", "case when p_partkey % 4 = 0 then ' Tb ' end as PTYPE2")
    return get_adapter("geology", "cgs_2010")(raw).select("poly_id", "ptype", "lith_group", "is_quaternary_alluvium", "lith_class")


ROCK = ["Intrusive rocks", "volcanic rocks ", "Sedimentary and volcanic rocks", "gravel"]


@query(f"""WITH r AS (SELECT p_partkey AS poly_id, coalesce(CASE WHEN p_partkey % 9 > 0 THEN trim(p_brand) END, '') AS c, lower(trim({ROCK}[p_partkey % 4 + 1])) AS k FROM part), f AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS code FROM r GROUP BY c)
SELECT poly_id, CASE k WHEN 'intrusive rocks' THEN 'intrusive' WHEN 'volcanic rocks' THEN 'volcanic' WHEN 'sedimentary and volcanic rocks' THEN 'volcanic' ELSE 'other' END AS lith_group, CAST(code AS INT) AS lith_class FROM r JOIN f USING (c)""")
def adapt_bcgs_digital(spark: SparkSession, d: str) -> DataFrame:
    raw = _raw(spark, d, "part", "p_partkey", "p_partkey as poly_id", "case when p_partkey % 9 > 0 then concat(p_brand, ' ') end as rock_code", f"{_pick(ROCK, 'p_partkey')} as rock_class")
    return get_adapter("geology", "bcgs_digital")(raw).select("poly_id", "lith_group", "lith_class")


@query("SELECT s_suppkey AS line_id, 'CGS_2010' AS source, s_name AS fault_type FROM supplier")
def adapt_cgs_faults(spark: SparkSession, d: str) -> DataFrame:
    """The type of a fault from the first of its alias columns."""
    raw = table(spark, d, "supplier").selectExpr("s_suppkey as line_id", "array(named_struct('x', 0D, 'y', 0D)) as pts", "s_name as NAME", "'other' as TYPE")
    return get_adapter("faults", "cgs_2010")(raw).select("line_id", "source", "fault_type")


FAULT_AGES = ["Holocene", "Pre-Quaternary", "late Quaternary", "prequaternary", "Pleistocene ", "unknown"]


@query(f"SELECT s_suppkey AS line_id, 'CGS_Jennings' AS source, ['quaternary_active', 'pre_quaternary', 'quaternary_active', 'pre_quaternary', 'quaternary_active', NULL][s_suppkey % {len(FAULT_AGES)} + 1] AS activity_class FROM supplier")
def adapt_jennings(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "supplier").selectExpr("s_suppkey as line_id", "array(named_struct('x', 0D, 'y', 0D)) as pts", f"{_pick(FAULT_AGES, 's_suppkey')} as AGE")
    return get_adapter("faults", "cgs_jennings")(raw).select("line_id", "source", "activity_class")


@query(f"""WITH r AS (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 100 END AS cu, o_orderkey % 400 AS mo, (o_orderkey % 700)::DOUBLE AS au, (o_orderkey % 11)::DOUBLE AS ag FROM orders)
SELECT {PLACE_SQL.format(k='o_orderkey')}, o_orderkey::VARCHAR AS hole_id, 'BCGS_GF2025-11' AS source, CAST(o_orderdate AS DATE)::VARCHAR AS drill_date, (coalesce(cu, 0) >= 2000 OR mo >= 300 OR au >= 500 OR ag >= 10) AS intersected,
  round(coalesce(cu, 0) / 10000, 8) AS max_cu_pct, round(mo / 10000.0::DOUBLE, 8) AS max_mo_pct, round(au / 1000, 8) AS max_au_gpt, ag AS max_ag_gpt FROM r""")
def adapt_geofile(spark: SparkSession, d: str) -> DataFrame:
    """Holes that intersect by any of four grades; missing grades count as none."""
    raw = _raw(
        spark, d, "orders", "o_orderkey", "o_orderkey as hole_id", "cast(cast(o_orderdate as date) as string) as drill_date", "case when o_orderkey % 3 > 0 then o_totalprice / 100 end as max_cu_ppm",
        "cast(o_orderkey % 400 as double) as max_mo_ppm", "cast(o_orderkey % 700 as double) as max_au_ppb", "cast(o_orderkey % 11 as double) as max_ag_ppm",
    )
    got = get_adapter("drillholes", "bcgs_geofile")(raw).drop("total_depth_m")
    return rounded(got.withColumn("drill_date", F.date_format("drill_date", "yyyy-MM-dd")), 8)


@query("SELECT (s_suppkey % 360 - 180)::DOUBLE AS x, (s_suppkey % 90)::DOUBLE AS y, s_name AS hole_id, 'KENORLAND' AS source, (1990 + s_suppkey % 30) || '-01-01' AS drill_date, s_acctbal > 3000 AS intersected FROM supplier")
def adapt_kenorland(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "supplier").selectExpr(
        "cast(s_suppkey % 360 - 180 as double) as lon", "cast(s_suppkey % 90 as double) as lat", "s_name as hole_id", "concat(1990 + s_suppkey % 30, '.0') as drill_year", "case when s_acctbal > 3000 then 'positive' else 'negative' end as outcome",
        "0.1D as cu_pct", "0.2D as mo_pct", "0.3D as au_gpt",
    )
    return get_adapter("drillholes", "kenorland")(raw).select("x", "y", "hole_id", "source", F.date_format("drill_date", "yyyy-MM-dd").alias("drill_date"), "intersected")


@query("""SELECT o_orderkey AS comid, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS arbolate_sum, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 ELSE 0 END AS INT) AS stream_order, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 10 ELSE 0 END AS hydroseq,
  CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 10 > 0 THEN 0.5::DOUBLE END AS slope, CAST(o_custkey AS INT) AS fcode, 'NHDPLUS_HR' AS source FROM orders""")
def adapt_nhdplus(spark: SparkSession, d: str) -> DataFrame:
    """Reaches with attributes joined on ids that come as floats; half of them have attributes, some slopes are sentinels."""
    o = table(spark, d, "orders")
    lines = o.selectExpr("cast(o_orderkey as double) as nhdplusid", "array(named_struct('x', 0D, 'y', 0D)) as pts", "cast(o_custkey as double) as fcode")
    more = o.where("o_orderkey % 2 = 0").selectExpr("cast(o_orderkey as double) as nhdplusid", "o_totalprice as arbolatesu", "o_orderkey % 7 as streamorde", "cast(o_orderkey * 10 as double) as hydroseq", "case when o_orderkey % 10 = 0 then -9998D else 0.5D end as slope")
    return get_adapter("hydrology", "nhdplus_hr")(lines, more).drop("pts")


@query("SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_partkey % 13 > 0 THEN p_retailprice END AS value FROM part")
def adapt_geophysics(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "part").selectExpr("p_partkey div 50 as row", "p_partkey % 50 as col", "case when p_partkey % 13 > 0 then p_retailprice else -1.0e32D end as value")
    return get_adapter("geophysics", "usgs")(raw)


@query("""WITH t AS (SELECT 0 AS t, p_partkey // 50 AS row, p_partkey % 50 AS col, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS value FROM part WHERE p_partkey % 50 < 30 UNION ALL SELECT 1, p_partkey // 50, p_partkey % 50, p_size::DOUBLE FROM part WHERE p_partkey % 50 >= 20)
SELECT row, col, arg_min(value, t) AS value FROM t WHERE value IS NOT NULL GROUP BY row, col""")
def adapt_elevation(spark: SparkSession, d: str) -> DataFrame:
    """A mosaic of two overlapping tiles, the first with gaps."""
    p = table(spark, d, "part").withColumns({"row": F.expr("p_partkey div 50"), "col": F.col("p_partkey") % 50})
    first = p.where("col < 30").select("row", "col", F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("value"))
    return get_adapter("elevation", "threedep")([first, p.where("col >= 20").select("row", "col", F.col("p_size").cast("double").alias("value"))])


# ---- single operators that adapters and reports use


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.01 THEN l_tax END AS slope, coalesce(CASE WHEN l_linenumber > 3 THEN l_orderkey END, 0) AS hydroseq, 0 AS stream_order FROM lineitem")
def clean_attributes(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case when l_tax > 0.01 then l_tax else -9998D end as slope", "case when l_linenumber > 3 then l_orderkey end as hydroseq", "cast(null as int) as stream_order")
    return network.clean_attributes(raw)


@query(r"SELECT s_suppkey, list_reduce(list_transform(string_split('0 0, ' || s_suppkey || ' 1,2 ' || s_nationkey, ','), lambda v: trim(v)), lambda a, b: a || ';' || b) AS vertices FROM supplier")
def wkt_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of a WKT polygon without the closing one."""
    wkt = F.format_string("POLYGON((0 0, %d 1,2 %d,0 0))", F.col("s_suppkey"), F.col("s_nationkey"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(scalar.wkt_vertices(wkt), ";").alias("vertices"))


@query("SELECT c_custkey, round(sqrt(pow(((c_custkey % 360) - 180 + 120.5) * cos(radians(38.0)), 2) + pow((c_custkey % 90) - 38.0, 2)), 8) AS d FROM customer")
def flat_distance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 360 - 180).cast("double").alias("lon"), (F.col("c_custkey") % 90).cast("double").alias("lat"))
    return rounded(c.select("c_custkey", scalar.flat_distance_degrees(F.col("lon"), F.col("lat"), -120.5, 38.0).alias("d")), 8)


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS d, max(l_quantity) / 500 AS q, -max(l_tax) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber),
u AS (SELECT l_orderkey, l_linenumber, unnest([('discount', d), ('quantity', q), ('tax', t)]) AS s FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY abs(s[2]) DESC, s[1]) AS r FROM u)
SELECT l_orderkey, l_linenumber, string_agg(s[1], ',' ORDER BY r) AS names FROM o WHERE r <= 2 GROUP BY l_orderkey, l_linenumber""")
def top_features(spark: SparkSession, d: str) -> DataFrame:
    """The two features with the largest magnitude of each row, the largest first."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_discount").alias("discount"), (F.max("l_quantity") / 500).alias("quantity"), (-F.max("l_tax")).alias("tax"))
    named = F.transform(relational.top_features(own, ["discount", "quantity", "tax"], 2), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    return own.select("l_orderkey", "l_linenumber", F.array_join(named, ",").alias("names"))


@query(f"WITH {SCORED_SQL} SELECT cell_id, round(rank() OVER (ORDER BY score) / count(*) OVER ()::DOUBLE, 9) AS pct FROM scored")
def percent_rank(spark: SparkSession, d: str) -> DataFrame:
    """Share of cells at or below a score, ties at their lowest rank."""
    return rounded(ranking.percent_rank(scored(spark, d), "score", "pct").select("cell_id", "pct"), 9)


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL} SELECT anchor_id, CASE WHEN kind = 1 OR EXISTS (SELECT 1 FROM samples s WHERE s.grade > 45 AND sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y)) <= 100) THEN 'tertiary' ELSE 'quaternary' END AS class FROM anchors a""")
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences near a pit or on old units are of the older class."""
    return spatial.reclassify(anchors(spark, d), samples(spark, d).where("grade > 45"), 100.0, "anchor_id", F.col("kind") == 1, "tertiary", "quaternary").select("anchor_id", "class")


@query("""WITH f AS (SELECT *, p_partkey % 5 AS fold, (p_partkey * 31 % 17 < 3)::INT AS y, p_size::DOUBLE AS s FROM part), n AS (SELECT fold, count(*) AS n, sum(y) AS pos FROM f GROUP BY fold HAVING count(*) >= 50 AND sum(y) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY s DESC, p_partkey) AS r FROM f)
SELECT n.fold, CAST(n AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, round(sum(y) FILTER (r <= ceil(n * 0.1)) / max(pos)::DOUBLE, 8) AS capture, round(sum(y) FILTER (r <= ceil(n * 0.1)) / max(pos)::DOUBLE * max(n) / ceil(max(n) * 0.1), 8) AS lift FROM n JOIN r USING (fold) GROUP BY n.fold, n, pos""")
def fold_capture(spark: SparkSession, d: str) -> DataFrame:
    """Capture and lift in the best tenth of each fold; folds with few rows or positives are left out."""
    p = table(spark, d, "part").selectExpr("p_partkey", "p_partkey % 5 as fold", "cast(p_partkey * 31 % 17 < 3 as int) as y", "cast(p_size as double) as s")
    return rounded(ranking.fold_capture(p, "s", "y", "fold", ["p_partkey"], 10.0), 8)


@query("SELECT p_type AS feature, round(avg(p_retailprice) FILTER (p_partkey % 3 = 0), 6) AS a, round(avg(p_retailprice) FILTER (p_partkey % 3 = 1), 6) AS b, round(avg(p_retailprice) FILTER (p_partkey % 3 = 2), 6) AS c FROM part GROUP BY p_type")
def importance_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Importance of each feature by model, as columns."""
    p = table(spark, d, "part").select(F.col("p_type").alias("feature"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("model"), F.col("p_retailprice").alias("importance"))
    return rounded(learning.importance_pivot(p, ["a", "b", "c"]))


@query("""WITH c AS (SELECT c_nationkey AS area, count(*) AS n FROM customer GROUP BY 1) SELECT 'N' || area AS area, n, CASE WHEN n >= 60 THEN 'PASS' WHEN n >= 55 THEN 'MARGINAL' ELSE 'FAIL' END AS gate FROM c WHERE area < 20
UNION ALL SELECT 'outside', CAST(sum(n) AS BIGINT), NULL FROM c WHERE area >= 20""")
def area_gates(spark: SparkSession, d: str) -> DataFrame:
    """Counts by listed area against a gate, and what lies outside the list."""
    c = table(spark, d, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("area"))
    return relational.area_gates(c, "area", [f"N{i}" for i in range(20)], 60, 55)


NEAR = "sqrt((s.x - a.x) * (s.x - a.x) + (s.y - a.y) * (s.y - a.y))"


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL}, p AS (SELECT sample_id, anchor_id, value, kind, {NEAR} AS d FROM samples s, anchors a WHERE abs(s.x - a.x) <= 700 AND abs(s.y - a.y) <= 700),
b AS (SELECT sample_id, arg_min({{'i': anchor_id, 'v': value, 'k': kind}}, (d, anchor_id)) AS t, min(d) AS d FROM p WHERE d <= 700 GROUP BY sample_id)
SELECT s.sample_id, t.i AS near_id, t.v AS value, t.k AS kind, round(d, 6) AS near_d FROM samples s LEFT JOIN b USING (sample_id)""")
def reach_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of the nearest reach, and how far it is."""
    got = spatial.nearest_within(samples(spark, d), anchors(spark, d), 700.0, "sample_id", "anchor_id", ["value", "kind"])
    return rounded(got.select("sample_id", "near_id", "value", "kind", "near_d"))


@query(f"""WITH {SAMPLES_SQL}, {ANCHORS_SQL}, seeds AS (SELECT DISTINCT ((c_custkey * 7919) % 12500)::DOUBLE AS x, ((c_custkey * 104729) % 10000)::DOUBLE AS y FROM customer WHERE c_acctbal > 9500),
m AS (SELECT s.x, s.y, arg_min({{'h': anchor_id, 'l': value / 100}}, ({NEAR}, anchor_id)) AS t FROM seeds s, anchors a WHERE {NEAR} <= 400 GROUP BY s.x, s.y),
g AS (SELECT a.anchor_id, a.value / 100 AS l, max(m.t.l) AS best FROM anchors a LEFT JOIN m ON m.t.h >= a.anchor_id GROUP BY ALL),
n AS (SELECT sample_id, arg_min(anchor_id, ({NEAR}, anchor_id)) AS comid FROM samples s, anchors a WHERE abs(s.x - a.x) <= 400 AND abs(s.y - a.y) <= 400 AND {NEAR} <= 400 GROUP BY sample_id)
SELECT s.sample_id, n.comid, round(CASE WHEN g.l - best BETWEEN 0 AND 60 THEN g.l - best END, 6) AS downstream FROM samples s LEFT JOIN n USING (sample_id) LEFT JOIN g ON g.anchor_id = n.comid""")
def distance_downstream(spark: SparkSession, d: str) -> DataFrame:
    """Seeds and samples snapped to reaches; running length from the nearest seed upstream."""
    reaches = anchors(spark, d).select(F.col("anchor_id").alias("comid"), F.col("anchor_id").alias("hydroseq"), (F.col("value") / 100).alias("arbolate"), "x", "y")
    c = table(spark, d, "customer").where("c_acctbal > 9500")
    seeds = c.select(((F.col("c_custkey") * 7919) % 12500).cast("double").alias("x"), ((F.col("c_custkey") * 104729) % 10000).cast("double").alias("y"), F.lit("vein").alias("dep_type"))
    return rounded(network.snapped_downstream(samples(spark, d), reaches, seeds, "sample_id", 400.0, 60.0))


@query(f"WITH {CELLS_SQL} SELECT row, col, elevation AS band1, CASE WHEN cell_id % 4 > 0 THEN slope END AS band2 FROM cells")
def two_bands(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    second = c.select("row", "col", F.when(F.col("cell_id") % 4 > 0, F.col("slope")).alias("value"))
    return raster.two_bands(c.select("row", "col", F.col("elevation").alias("value")), second)


@query("""WITH s AS (SELECT p_partkey, p_type, p_size, p_retailprice, CAST(p_partkey % 29 = 0 AS INT) AS label, CAST(('0x' || substr(md5('9:' || p_partkey::VARCHAR), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS h FROM part),
q AS (SELECT p_type, greatest(1, count(*) * 2) AS quota FROM s WHERE label = 1 GROUP BY p_type), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY h, p_partkey) AS r FROM s WHERE label = 0)
SELECT p_partkey, p_type, p_size, label FROM s WHERE label = 1 UNION ALL SELECT p_partkey, p_type, p_size, label FROM r JOIN q USING (p_type) WHERE r <= quota""")
def training_set(spark: SparkSession, d: str) -> DataFrame:
    """Positives and stratified pseudo-negatives, without a column that would give the label away."""
    p = table(spark, d, "part")
    return sampling.training_set(p.select("p_partkey", "p_type", "p_size", "p_retailprice"), p.where("p_partkey % 29 = 0"), "p_partkey", "p_type", 2, 9, ("p_retailprice",))


@query("""WITH w AS (SELECT l_orderkey, avg(CASE WHEN l_returnflag = 'A' AND l_quantity >= 0 THEN l_quantity * 0.001 END) AS "Au_ppm", avg(CASE WHEN l_returnflag = 'R' AND l_quantity >= 0 THEN l_quantity END) AS "Cu_ppm" FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey)
SELECT (o_orderkey % 1000)::DOUBLE + 0.5 AS x, o_orderkey::VARCHAR AS sample_id, o_orderstatus AS sample_type, round("Au_ppm", 8) AS "Au_ppm", round("Cu_ppm", 8) AS "Cu_ppm" FROM orders LEFT JOIN w ON l_orderkey = o_orderkey""")
def ngdb_joined(spark: SparkSession, d: str) -> DataFrame:
    """Samples with their pivoted assays, as canonical geochemistry."""
    li = table(spark, d, "lineitem").selectExpr("l_orderkey as lab_id", "case l_returnflag when 'A' then 'Au' when 'R' then 'Cu' else 'Zn' end as species", "case l_returnflag when 'A' then 'ppb' else 'ppm' end as unit", "l_quantity as value")
    main = _raw(spark, d, "orders", "o_orderkey", "o_orderkey as lab_id", "o_orderstatus as primary_class")
    wide = relational.pivot_ppm(relational.semi_filter(li, main, "lab_id", ["Au", "Cu"]), "lab_id", ["Au", "Cu"])
    got = get_adapter("geochem", "ngdb")(main.join(wide, "lab_id", "left"), ["Au", "Cu"])
    return rounded(got.select("x", "sample_id", "sample_type", "Au_ppm", "Cu_ppm"), 8)


ROCK_SQL = "CASE p_size % 6 WHEN 0 THEN ' Slate' WHEN 1 THEN 'slate' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'Granodiorite' ELSE p_brand END"


@query(f"""WITH r AS (SELECT p_partkey AS poly_id, CASE WHEN lower(trim(coalesce({ROCK_SQL}, ''))) = '' THEN '(none)' ELSE lower(trim({ROCK_SQL})) END AS m FROM part), f AS (SELECT m, row_number() OVER (ORDER BY min(poly_id)) - 1 AS code FROM r GROUP BY m)
SELECT poly_id, code::INT AS major1_class, 0 AS major3_class FROM r JOIN f USING (m)""")
def major_rocks(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the first major rock name; a table without the third has one code for it."""
    raw = _raw(spark, d, "part", "p_partkey", "p_partkey as poly_id", "'Water' as generalized_lith", "cast(null as string) as age_min", "cast(null as string) as age_max", "p_brand as unit_link", f"{ROCK_SQL} as major1", "p_type as major2")
    return get_adapter("geology", "usgs_sgmc")(raw).select("poly_id", "major1_class", "major3_class")
