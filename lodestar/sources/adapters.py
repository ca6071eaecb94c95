"""Adapters: raw tables of public surveys to canonical ones, found by kind and source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import bounds, centroid
from ..functions.projection import NAD27_SHIFTS, crs, reproject
from ..functions.scalar import first_match, mask_nodata, parse_codes, priority_value, sentinel, to_ppm
from ..model import Area
from ..operators.relational import factorize, join_many, reconcile, recode
from .readers import clip, overlaps, resolve, to_date

ADAPTERS: dict[str, dict[str, Callable[..., DataFrame]]] = {}


def adapter(kind: str, source: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ADAPTERS.setdefault(kind, {})[source] = f
        return f

    return add


def get_adapter(kind: str, source: str) -> Callable[..., DataFrame]:
    if kind not in ADAPTERS:
        raise KeyError(f"unknown kind {kind!r}; known: {', '.join(sorted(ADAPTERS))}")
    if source not in ADAPTERS[kind]:
        raise KeyError(f"unknown {kind} source {source!r}; known: {', '.join(sorted(ADAPTERS[kind]))}")
    return ADAPTERS[kind][source]


# Deposit codes by commodity, in order of precedence.
COMMODITY_CODES = [
    ("au", ("usgs:36a", "usgs:36b")), ("gold", ("usgs:36a", "usgs:36b")), ("cu", ("usgs:21a", "usgs:21b")), ("copper", ("usgs:21a", "usgs:21b")),
    ("pb", ("usgs:32a",)), ("zn", ("usgs:32a",)), ("lead", ("usgs:32a",)), ("zinc", ("usgs:32a",)),
]
# Fixed value: deposit types that are placers.
PLACER = r"(?i)placer|alluvial|stream.?placer|paleo.?placer|black.?sand|residual|eluvial"
# Feature types that are placers or gravel workings.
PLACER_FEATURES = (
    "Placer Mine", "Hydraulic Mine", "Gravel Pit", "Sand Pit", "Sand and Gravel Pit", "Gravel/Borrow Pit - Undifferentiated", "Diggings",
    "Tailings - Undifferentiated", "Mine Dump",
)
# Methods of each element, the most reliable first, with the factor to ppm.
METHODS = {
    "Ag": [("AG_FA_PPM", 1.0), ("AG_INA_PPM", 1.0), ("AG_ICP_PPB", 1e-3), ("AG_AAS_PPM", 1.0)],
    "As": [("AS_INA_PPM", 1.0), ("AS_ICP_PPM", 1.0), ("AS_AAS_PPM", 1.0)],
    "Au": [("AU_FA_PPB", 1e-3), ("AU_INA_PPB", 1e-3), ("AU_ICP_PPB", 1e-3)],
    "Ba": [("BA_INA_PPM", 1.0), ("BA_ICP_PPM", 1.0), ("BA_AAS_PPM", 1.0)],
    "Bi": [("BI_ICP_PPM", 1.0), ("BI_AAS_PPM", 1.0)],
    "Cu": [("CU_ICP_PPM", 1.0), ("CU_AAS_PPM", 1.0)],
    "Hg": [("HG_INA_PPM", 1.0), ("HG_AAS_PPB", 1e-3), ("HG_ICP_PPB", 1e-3)],
    "Mo": [("MO_INA_PPM", 1.0), ("MO_ICP_PPM", 1.0), ("MO_AAS_PPM", 1.0)],
    "Pb": [("PB_ICP_PPM", 1.0), ("PB_AAS_PPM", 1.0)],
    "Sb": [("SB_INA_PPM", 1.0), ("SB_ICP_PPM", 1.0), ("SB_AAS_PPM", 1.0)],
    "Te": [("TE_ICP_PPM", 1.0)],
    "Tl": [("TL_ICP_PPM", 1.0)],
    "Zn": [("ZN_INA_PPM", 1.0), ("ZN_ICP_PPM", 1.0), ("ZN_AAS_PPM", 1.0)],
}
# Lithology groups by generalised lithology.
LITHOLOGY = {
    "Metamorphic, volcanic": "greenstone", "Metamorphic, serpentinite": "ultramafic", "Metamorphic, schist": "metasediment", "Metamorphic, sedimentary": "metasediment",
    "Metamorphic, sedimentary clastic": "metasediment", "Metamorphic, amphibolite": "metasediment", "Metamorphic, gneiss": "metamorphic",
    "Metamorphic, carbonate": "metamorphic", "Metamorphic, granulite": "metamorphic", "Metamorphic, igneous": "metamorphic", "Metamorphic, intrusive": "metamorphic",
    "Metamorphic, undifferentiated": "metamorphic", "Metamorphic, other": "metamorphic", "Melange": "melange", "Igneous, intrusive": "intrusive",
    "Igneous, undifferentiated": "intrusive", "Igneous, volcanic": "volcanic", "Sedimentary, clastic": "sedimentary", "Sedimentary, carbonate": "sedimentary",
    "Sedimentary, chemical": "sedimentary", "Sedimentary, evaporite": "sedimentary", "Sedimentary, iron formation, undifferentiated": "sedimentary",
    "Sedimentary, undifferentiated": "sedimentary", "Unconsolidated, undifferentiated": "surficial", "Unconsolidated and Sedimentary, undifferentiated": "surficial",
    "Igneous and Metamorphic, undifferentiated": "metamorphic", "Igneous and Sedimentary, undifferentiated": "sedimentary",
    "Metamorphic and Sedimentary, undifferentiated": "metasediment", "Tectonite, undifferentiated": "tectonite", "Water": "water", "Ice": "water", "Dam": "water",
    "Unknown": "other",
}
# Eras by keyword, in order.
ERAS = [
    ("cenozoic", "cenozoic"), ("quaternary", "cenozoic"), ("tertiary", "cenozoic"), ("mesozoic", "mesozoic"), ("cretaceous", "mesozoic"), ("jurassic", "mesozoic"),
    ("triassic", "mesozoic"), ("paleozoic", "paleozoic"), ("proterozoic", "proterozoic"), ("archean", "archean"), ("precambrian", "precambrian"),
]
# Rock classes of the provincial map.
ROCKS = {
    "intrusive rocks": "intrusive", "ultramafic rocks": "intrusive", "volcanic rocks": "volcanic", "sedimentary rocks": "sedimentary",
    "sedimentary and volcanic rocks": "volcanic", "volcanic and sedimentary rocks": "volcanic", "metamorphic rocks": "metamorphic",
}
# Lithology groups by the letters after the age letter of a unit's type, in order; types of alluvium.
UNIT_GROUPS = [
    ("^Q", "surficial"), ("^[A-Z](gr|gd|qm|tn|di|gb|um|sy|mz|ad|to|pl|alk)", "intrusive"), ("^[A-Z](v|b|a|r|da|rh|an|py|tu|ig|ba)", "volcanic"),
    ("^[A-Z](m|sch|gn|qz|mb|ph|sl|am)", "metamorphic"), ("^[A-Z](s|c|sh|ss|ls|cg|mu|ms|dl|ch)", "sedimentary"),
]
ALLUVIUM = "(?i)^Q(a|al|g|f|l|w|oa|s|ls|p|e|c|pf|d|m|t|ya|oal)?$"
# Grades that count as an intersection (Cu ppm, Mo ppm, Au ppb, Ag ppm).
GRADES = {"max_cu_ppm": 2000.0, "max_mo_ppm": 300.0, "max_au_ppb": 500.0, "max_ag_ppm": 10.0}
# Names of quadrangles by code; boxes of states (west, south, east, north).
QUADRANGLES = {"TC": "TANACROSS", "NM": "NOME"}
STATES = {"CA": (-124.5, 32.5, -114.0, 42.0), "AK": (-180.0, 51.0, -130.0, 72.0), "AZ": (-114.8, 31.0, -109.0, 37.0)}


def _occurrence(raw: DataFrame, commodity: Column, codes: Column, source: str, record: Column, *more: Column) -> DataFrame:
    return raw.select("x", "y", commodity.cast("string").alias("commodity"), codes.cast("array<string>").alias("deposit_codes"), F.lit(source).alias("source"), record.cast("string").alias("raw_record_id"), F.lit(None).cast("int").alias("year"), *more)


@adapter("occurrences", "ardf")
def ardf(raw: DataFrame) -> DataFrame:
    return _occurrence(raw, resolve(raw, ["comm_main", "commodity"]), parse_codes(resolve(raw, ["model_code", "model"]).cast("string")), "ARDF", resolve(raw, ["ardf_num", "id"]))


@adapter("occurrences", "bc_minfile")
def bc_minfile(raw: DataFrame) -> DataFrame:
    code = [F.lower(F.trim(resolve(raw, [f"deposit_type_code{i}"]).cast("string"))) for i in (1, 2)]
    codes = F.transform(F.filter(F.array(*code), lambda c: c.isNotNull() & ~c.isin("", "nan", "*")), lambda c: F.concat(F.lit("bc:"), c))
    parts = [F.trim(resolve(raw, [f"commodity_description{i}"]).cast("string")) for i in range(1, 9)]
    return _occurrence(raw, F.concat_ws(", ", *[F.when(~p.isin("", "nan"), p) for p in parts]), codes, "BC_MINFILE", resolve(raw, ["mineral_file_number"]))


@adapter("occurrences", "mrds")
def mrds(raw: DataFrame) -> DataFrame:
    """The first commodity that is contained decides (so "au" is found inside words); gold of placer type or operation has no codes."""
    s = F.lower(F.col("commodity"))
    dep, oper = resolve(raw, ["dep_type"]).cast("string"), resolve(raw, ["oper_type"]).cast("string")
    placer = F.coalesce(dep.rlike(PLACER), F.lit(False)) | F.coalesce(F.lower(oper).contains("placer"), F.lit(False))
    none, codes = F.array().cast("array<string>"), F
    for name, own in COMMODITY_CODES:
        value = F.array(*map(F.lit, own))
        codes = codes.when(s.contains(name), F.when(placer, none).otherwise(value) if name in ("au", "gold") else value)
    return _occurrence(raw, F.col("commodity"), codes.otherwise(none), "MRDS", resolve(raw, ["id"]))


@adapter("occurrences", "mrds_states")
def mrds_states(states: list[DataFrame], area: Area | None = None) -> DataFrame:
    """Records of several states' files (columns that one lacks are null): three commodities make one, lower-case and joined by commas."""
    every = states[0]
    for more in states[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    parts = [F.lower(F.trim(resolve(every, [f"commod{i}"]).cast("string"))) for i in (1, 2, 3)]
    every = every.withColumn("commodity", F.concat_ws(",", *[F.nullif(p, F.lit("")) for p in parts]))
    return mrds(clip(every, area) if area else every)


def quadrangles(raw: DataFrame, quads: list[str], area: Area | None = None, names: dict[str, str] = QUADRANGLES) -> DataFrame:
    """Records whose label is one of the quadrangles, by code or name in any case. Labels are editorial, so ``area`` also asks where a record is."""
    wanted = sorted({n for q in quads for n in (q.upper(), names.get(q.upper(), q.upper()))})
    rows = raw.where(F.upper(F.trim(resolve(raw, ["quad_250", "quad"]).cast("string"))).isin(*wanted))
    return clip(rows, area) if area else rows


def state_of(area: Area) -> str:
    """The state whose box holds the centre of an area; the first of ``STATES`` wins, none is an error."""
    x, y = (area.west + area.east) / 2, (area.south + area.north) / 2
    for state, (west, south, east, north) in STATES.items():
        if west <= x <= east and south <= y <= north:
            return state
    raise ValueError(f"no state at {x:.3f}, {y:.3f}")


def counties(raw: DataFrame, boxes: dict[str, Area]) -> DataFrame:
    """A row per record and county it is in, with ``place``: the county column holds the name, in any case; a table without such a column goes by the boxes."""
    column = resolve(raw, ["county", "f_county", "geog_loc"], F.lit(False))
    known = any(c.lower() in ("county", "f_county", "geog_loc") for c in raw.columns)
    hits = []
    for name, box in boxes.items():
        by_box = F.col("x").between(box.west, box.east) & F.col("y").between(box.south, box.north)
        hits.append(F.when(F.lower(column.cast("string")).contains(name.lower()) if known else by_box, F.lit(name)))
    return raw.withColumn("place", F.explode(F.array_compact(F.array(*hits)))) if hits else raw.where("false").withColumn("place", F.lit(""))


@adapter("occurrences", "usmin")
def usmin(raw: DataFrame) -> DataFrame:
    kept = raw.where(resolve(raw, ["ftr_type"]).isin(*PLACER_FEATURES))
    record = F.coalesce(resolve(raw, ["usmin_gda_id", "gda_id"]).try_cast("bigint"), F.lit(-1))
    return _occurrence(kept, F.lit("au gold"), F.array(F.lit("usgs:39a"), F.lit("usgs:39b")), "USMIN", record, *[resolve(raw, [n]).alias(n) for n in ("ftr_type", "ftr_name", "topo_name")])


@adapter("occurrences", "hydraulic_pits")
def hydraulic_pits(raw: DataFrame) -> DataFrame:
    c = centroid(F.col("ring"))
    points = raw.withColumns({"x": c["x"], "y": c["y"]})
    return _occurrence(points, F.lit("au gold"), F.array(F.lit("usgs:39a")), "HYDRAULIC_PITS", F.col("pit_id"))


@adapter("geochem", "agdb4")
def agdb4(samples: DataFrame, tables: dict[str, DataFrame], key: str = "ddpd_id") -> DataFrame:
    """Samples with ``<element>_ppm`` from one value table per element."""
    return join_many(samples, {f"{e}_ppm": t for e, t in tables.items()}, key)


@adapter("geochem", "bcgs_rgs")
def bcgs_rgs(raw: DataFrame, elements: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    own = {c.upper(): c for c in raw.columns}
    values = []
    for e in elements:
        found = [(F.col(own[c]), k) for c, k in METHODS[e] if c in own]
        values.append((priority_value(found) if found else F.lit(None).cast("double")).alias(f"{e}_ppm"))
    return raw.select(
        resolve(raw, ["longitude", "long", "x"]).cast("double").alias("x"), resolve(raw, ["latitude", "lat", "y"]).cast("double").alias("y"), resolve(raw, ["masterid"]).cast("string").alias("sample_id"),
        F.lit("BCGS_RGS_2020").alias("source"), resolve(raw, ["type2"]).cast("string").alias("sample_type"), to_date(resolve(raw, ["date"]).cast("string")).alias("sample_date"), *values,
    )


@adapter("geochem", "ngdb")
def ngdb(wide: DataFrame, elements: list[str]) -> DataFrame:
    have = [e for e in elements if f"{e}_ppm" in wide.columns]
    return wide.select("x", "y", F.col("lab_id").cast("string").alias("sample_id"), F.lit("NGDB").alias("source"), resolve(wide, ["primary_class", "sample_type"]).cast("string").alias("sample_type"), to_date(resolve(wide, ["date_collect"]).cast("string")).alias("sample_date"), *[f"{e}_ppm" for e in have])


# Fixed value: the form of element columns: symbol, perhaps a mark of semi-quantitative values, unit.
ELEMENT = r"^([A-Z][a-z]?)(?:_sq)?_(ppm|ppb|pct)$"


@adapter("geochem", "nure_iicpms")
def nure(raw: DataFrame, elements: list[str] | None = None, in_ppm: bool = False, datum: str | None = "conus") -> DataFrame:
    """Element columns by their names' form, each with its unit, negatives null; with ``in_ppm`` one column in ppm per element (the first of ppm, ppb, pct that isn't null).

    ``datum``: places are on the older North American datum of that area and are moved to the world datum; ``None`` leaves them.
    """
    import re

    found: dict[str, dict[str, Column]] = {}
    for c in raw.columns:
        m = re.match(ELEMENT, c)
        if m and (elements is None or m[1] in elements):
            found.setdefault(m[1], {}).setdefault(m[2], F.when(F.col(c) >= 0, F.col(c)))
    if in_ppm:
        values = [F.coalesce(*(to_ppm(own[u].cast("double"), F.lit(u)) for u in ("ppm", "ppb", "pct") if u in own)).alias(f"{e}_ppm") for e, own in found.items()]
    else:
        values = [v.alias(f"{e}_{u}") for e, own in found.items() for u, v in own.items()]
    placed = raw.where("x is not null and y is not null")
    if datum:
        placed = reproject(placed, replace(crs(4267), shift=NAD27_SHIFTS[datum]), crs(4326))
    return placed.select("x", "y", resolve(raw, ["sample_id", "lab_id"]).cast("string").alias("sample_id"), F.lit("NURE").alias("source"), *values)


@adapter("geology", "usgs_sgmc")
def sgmc(raw: DataFrame) -> DataFrame:
    """Lithology groups, eras, and codes by first appearance of the unit and of the three major rock names (lower case, blank ones are one name)."""
    rows = recode(raw.withColumn("_g", F.trim("generalized_lith")), "_g", LITHOLOGY, "other", "lith_group")
    era = first_match(F.concat_ws("  ", F.coalesce("age_min", F.lit("")), F.coalesce("age_max", F.lit(""))), ERAS, "unknown")
    rows = factorize(rows.withColumns({"age_era": era, "source": F.lit("USGS_SGMC")}).drop("_g"), "unit_link", by="poly_id").withColumnRenamed("code", "lith_class")
    have = {c.lower() for c in raw.columns}
    for name in ("major1", "major2", "major3"):
        if name not in have:
            rows = rows.withColumn(f"{name}_class", F.lit(0))
            continue
        clean = F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))
        rows = factorize(rows.withColumn("_m", F.when(clean == "", "(none)").otherwise(clean)), "_m", by="poly_id").withColumnRenamed("code", f"{name}_class").drop("_m")
    return rows


@adapter("geology", "bcgs_digital")
def bcgs_digital(raw: DataFrame) -> DataFrame:
    rows = raw.withColumns({"rock_code": F.coalesce(F.trim("rock_code"), F.lit("")), "_r": F.lower(F.trim("rock_class")), "source": F.lit("BCGS_DigitalGeology")})
    return factorize(recode(rows, "_r", ROCKS, "other", "lith_group").drop("_r"), "rock_code").withColumnRenamed("code", "lith_class")


@adapter("geology", "cgs_2010")
def cgs_2010(raw: DataFrame) -> DataFrame:
    clean = [F.when(~F.lower(F.trim(c)).isin("", "nan"), F.trim(c)) for c in (resolve(raw, [n]).cast("string") for n in ("ptype", "ptype2"))]
    rows = raw.withColumn("ptype", F.coalesce(*clean, F.lit("(none)")))
    p, group = F.col("ptype"), F
    for pattern, name in UNIT_GROUPS:
        group = group.when(p.rlike(pattern), name)
    rows = rows.withColumns({"lith_group": group.otherwise("other"), "is_quaternary_alluvium": p.rlike(ALLUVIUM), "source": F.lit("CGS_2010")})
    return factorize(rows, "ptype", by="poly_id").withColumnRenamed("code", "lith_class")


@adapter("faults", "cgs_2010")
def cgs_faults(raw: DataFrame) -> DataFrame:
    return raw.select("line_id", "pts", F.lit("CGS_2010").alias("source"), resolve(raw, ["ltype", "ftype", "name", "type"], F.lit("unknown")).cast("string").alias("fault_type"))


@adapter("faults", "cgs_jennings")
def jennings(raw: DataFrame, older: tuple[str, ...] = ("pre-", "pre ", "pre_", "prequaternary", "prepleistocene")) -> DataFrame:
    s = F.lower(F.trim(resolve(raw, ["age", "class", "activity", "ltype"]).cast("string")))
    value = F
    for m in older:
        value = value.when(s.contains(m), "pre_quaternary")
    value = value.when(s.contains("holocene") | s.contains("quaternary") | s.contains("pleistocene"), "quaternary_active")
    return raw.select("line_id", "pts", F.lit("CGS_Jennings").alias("source"), F.lit(None).cast("string").alias("fault_type"), value.otherwise(F.lit(None)).alias("activity_class"))


@adapter("drillholes", "bcgs_geofile")
def geofile(raw: DataFrame) -> DataFrame:
    v = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in GRADES}
    hit = F.lit(False)
    for n, least in GRADES.items():
        hit = hit | (v[n] >= least)
    return raw.select(
        "x", "y", F.col("hole_id").cast("string").alias("hole_id"), F.lit("BCGS_GF2025-11").alias("source"), to_date(resolve(raw, ["drill_date"]).cast("string")).alias("drill_date"),
        resolve(raw, ["total_depth_m"]).cast("double").alias("total_depth_m"), hit.alias("intersected"), (v["max_cu_ppm"] / 10000.0).alias("max_cu_pct"), (v["max_mo_ppm"] / 10000.0).alias("max_mo_pct"),
        (v["max_au_ppb"] / 1000.0).alias("max_au_gpt"), v["max_ag_ppm"].alias("max_ag_gpt"),
    )


@adapter("drillholes", "kenorland")
def kenorland(raw: DataFrame) -> DataFrame:
    year = F.substring(F.col("drill_year").cast("string"), 1, 4)
    return raw.select(F.col("lon").alias("x"), F.col("lat").alias("y"), "hole_id", F.lit("KENORLAND").alias("source"), to_date(F.concat(year, F.lit("-01-01"))).alias("drill_date"), F.lit(None).cast("double").alias("total_depth_m"), (F.col("outcome") == "positive").alias("intersected"), F.col("cu_pct").alias("max_cu_pct"), F.col("mo_pct").alias("max_mo_pct"), F.col("au_gpt").alias("max_au_gpt"), F.lit(None).cast("double").alias("max_ag_gpt"))


@adapter("hydrology", "nhdplus_hr")
def nhdplus(lines: DataFrame, attributes: DataFrame) -> DataFrame:
    """Flow lines with their attributes; ids come as floats and are cut to whole numbers, sentinels become nulls and zeros."""
    rows = lines.withColumn("comid", F.col("nhdplusid").cast("bigint")).join(attributes.withColumn("comid", F.col("nhdplusid").cast("bigint")).drop("nhdplusid"), "comid", "left")
    return rows.select(
        "comid", "pts", F.col("arbolatesu").alias("arbolate_sum"), F.coalesce("streamorde", F.lit(0)).cast("int").alias("stream_order"), F.coalesce("hydroseq", F.lit(0)).cast("bigint").alias("hydroseq"),
        sentinel(F.col("slope"), -9000).alias("slope"), F.col("fcode").cast("int").alias("fcode"), F.lit("NHDPLUS_HR").alias("source"),
    )


@adapter("hydrology", "nhdplus_units")
def nhdplus_units(units: list[tuple[DataFrame, DataFrame]], area: Area, buffer: float = 0.0) -> DataFrame:
    """Flow lines of several drainage units whose box meets the area widened by ``buffer``, each with its unit's attributes; lines are not cut. A line that two units hold is taken once."""
    wide = Area(area.west - buffer, area.south - buffer, area.east + buffer, area.north + buffer, area.crs)
    every = reconcile(*[nhdplus(lines, attributes).withColumn("_u", F.lit(i)) for i, (lines, attributes) in enumerate(units)]).withColumn("_b", bounds(F.col("pts")))
    met = overlaps(every.withColumns({n: F.col(f"_b.{n}") for n in ("xmin", "ymin", "xmax", "ymax")}), wide).drop("_b", "xmin", "ymin", "xmax", "ymax")
    least = met.groupBy("comid").agg(F.min("_u").alias("_u"))
    return met.join(least, ["comid", "_u"], "left_semi").drop("_u")


@adapter("geophysics", "usgs")
def geophysics(raster: DataFrame) -> DataFrame:
    return raster.withColumn("value", mask_nodata(F.col("value")))


@adapter("elevation", "threedep")
def elevation(tiles: list[DataFrame]) -> DataFrame:
    """Mosaic of tiles: the first tile that has a cell wins."""
    rows = reconcile(*[t.withColumn("_t", F.lit(i)) for i, t in enumerate(tiles)])
    return rows.where("value is not null").groupBy("row", "col").agg(F.min_by("value", "_t").alias("value"))
