"""Single operators on hand-made inputs."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry, scalar
from lodestar.model import Area, Grid, validate
from lodestar.operators import calibration, network, ranking, raster, relational, spatial
from lodestar.plans.thesaurus import token_set_ratio
from lodestar.sources import adapters, readers


def one(spark, column, **values):
    kinds = {float: "double", int: "long", str: "string", bool: "boolean", type(None): "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("d,want", [(0.0, 1.0), (100.0, math.exp(-0.5)), (200.0, math.exp(-2)), (300.0, math.exp(-4.5)), (None, 0.0)])
def test_gaussian_falloff(spark, d, want):
    assert one(spark, scalar.gaussian_falloff(F.col("d"), 100.0), d=d) == pytest.approx(want)


@pytest.mark.parametrize("at,want", [((0, 1, 2, 3, 4), 1.0), ((0, 20, 40, 60, 80), 0.2), ((0, 5, 20, 40, 60), 0.2), ((), 0.0)])
def test_capture(spark, at, want):
    df = spark.createDataFrame([(i, float(100 - i), int(i in at)) for i in range(100)], "id long, s double, p int")
    assert ranking.capture_at(df, "s", "p", ["id"], [5.0]).first().capture == pytest.approx(want)


def test_capture_of_nothing(spark):
    df = spark.createDataFrame([], "id long, s double, p int")
    assert ranking.capture_at(df, "s", "p", ["id"], [5.0]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 10, 25, 99])
def test_deciles_are_those_of_interpolated_edges(spark, n):
    import pandas as pd

    df = spark.createDataFrame([(i, float(-i)) for i in range(n)], "id long, s double")
    got = [r.decile for r in ranking.decile(df, "s", ["id"]).orderBy("id").collect()]
    assert got == ([0] if n == 1 else pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False, duplicates="drop").tolist() if n >= 10 else got)


def test_percentiles_match_numpy(spark):
    import numpy as np

    v = np.random.default_rng(0).integers(0, 50, 501).astype(float)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    assert ranking.percentiles(df, "v", [0.0, 0.01, 0.5, 0.777, 1.0]) == pytest.approx(np.percentile(v, [0, 1, 50, 77.7, 100]).tolist())


def test_percentiles_of_several_columns(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 401).astype(float), rng.normal(1e6, 3, 401)
    df = spark.createDataFrame([(float(x), float(y) if i % 3 else None, None, 5.0) for i, (x, y) in enumerate(zip(a, b))], "a double, b double, c double, d double")
    got = ranking.percentiles_of(df, {n: F.col(n) for n in "abcd"}, [0.01, 0.5, 0.99])
    for n, v in (("a", a), ("b", b[[i for i in range(401) if i % 3]]), ("d", np.full(3, 5.0))):
        assert got[n] == pytest.approx(np.percentile(v, [1, 50, 99]).tolist())
    assert got["c"] == [None] * 3 and ranking.percentiles_of(df, {}, [0.5]) == {}


def test_empty_percentiles(spark):
    assert ranking.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_equal_width_edge_goes_by_the_double(spark):
    df = spark.createDataFrame([(0.3, 1)], "s double, y int")
    assert calibration.reliability(df, "s", "y", calibration.width_edges()).first().bin == 2


def test_rasterised_polygon(spark):
    g = Grid(0.0, 0.0, 100.0, 10, 10)
    ring = [(400.5, 400.5), (700.5, 400.5), (700.5, 700.5), (400.5, 700.5), (400.5, 400.5)]
    df = spark.createDataFrame([(1, [(float(x), float(y)) for x, y in ring])], "poly_id long, ring array<struct<x:double,y:double>>")
    got = [r.weight for r in spatial.polygon_weights(df, g).collect()]
    assert got.count(1.0) == 9 and got.count(0.5) == 16


def test_small_polygon_takes_its_cell(spark):
    g = Grid(0.0, 0.0, 100.0, 5, 5)
    ring = [(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 20.0), (10.0, 10.0)]
    df = spark.createDataFrame([(1, ring)], "poly_id long, ring array<struct<x:double,y:double>>")
    assert [r.weight for r in spatial.polygon_weights(df, g).where("row = 0 and col = 0").collect()] == [1.0]


def test_lode_guard(spark):
    ok = spark.createDataFrame([(5, 1.0, "vein")], "hydroseq long, arbolate double, dep_type string")
    network.guard_lode(ok)
    with pytest.raises(ValueError):
        network.guard_lode(ok.withColumn("dep_type", F.lit("Placer gold")))
    with pytest.raises(KeyError):
        network.guard_lode(ok.drop("dep_type"))


def test_dual_decay_signs(spark):
    cells = spark.createDataFrame([(1, 50, 10.0)], "comid long, hydroseq long, arbolate double")
    samples = spark.createDataFrame([(50, 10.0, 2.0), (60, 15.0, 4.0), (40, 1.0, 100.0)], "hydroseq long, arbolate double, value double")
    r = network.dual_decay(cells, samples).first()
    w = math.exp(-1) + 0.3 * math.exp(-0.2)
    assert r.n_samples == 2 and r.catchment == pytest.approx((2 * 1.3 + 4 * w) / (1.3 + w))
    assert network.dual_decay(cells, samples, sign=-1).first().catchment == pytest.approx(3.0)


def test_dual_decay_without_pairs(spark):
    """Against brute force, with ties, nulls, a frequent length and a frequent place, for one range and many; and no join by inequality."""
    import random

    draw = random.Random(5)
    length = lambda: draw.choice([None, 7.0, 7.0, round(draw.uniform(0, 400), 1), draw.uniform(0, 20)])
    cells = [(i, draw.choice([50, draw.randrange(100)]), length()) for i in range(150)] + [(900, None, 1.0)]
    samples = [(draw.choice([50, None, draw.randrange(95)]), length(), draw.choice([None, draw.uniform(0, 9)])) for _ in range(200)]
    c, s = spark.createDataFrame(cells, "comid long, hydroseq long, arbolate double"), spark.createDataFrame(samples, "hydroseq long, arbolate double, value double")
    # the last one is dealt again and again, until a task has 12 rows at most
    for sign, near, far, ranges, rows in ((1, 5.0, 0.0, 1, 20_000), (1, 0.0, 25.0, 3, 20_000), (-1, 5.0, 25.0, 7, 20_000), (1, 5.0, 25.0, 7, 20_000), (-1, 5.0, 25.0, 3, 12)):
        want = {}
        for i, h, x in cells:
            above = [(y, v) for q, y, v in samples if h is not None and q is not None and q >= h]
            w = [((math.exp(-d / near) if near else 0) + (0.3 * math.exp(-d / far) if far else 0), v) for y, v in above if v is not None for d in [0 if x is None or y is None else max(sign * (y - x), 0)]]
            if above:
                want[i] = (len(w), sum(a * v for a, v in w) / sum(a for a, _ in w) if sum(a for a, _ in w) > 0 else None)
        out = network.dual_decay(c, s, near=near, far=far, sign=sign, ranges=ranges, rows=rows)
        got = {r.comid: (r.n_samples, r.catchment) for r in out.collect()}
        assert got.keys() == want.keys() and len(want) > 100
        for i, (n, v) in want.items():
            assert got[i][0] == n and (v is None) == (got[i][1] is None) and got[i][1] == (v if v is None else pytest.approx(v, rel=1e-9))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_geometry(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)],)], "r array<struct<x:double,y:double>>")
    c = df.select(geometry.centroid(F.col("r")).alias("c"), geometry.contains(F.col("r"), F.lit(1.0), F.lit(1.0)).alias("a"), geometry.contains(F.col("r"), F.lit(5.0), F.lit(1.0)).alias("b"), geometry.line_distance(F.lit(1.0), F.lit(3.0), F.col("r")).alias("d")).first()
    assert (c.c.x, c.c.y) == (2.0, 1.0) and c.a and not c.b and c.d == 1.0
    clipped = df.select(geometry.bounds(geometry.clip_ring(F.col("r"), 1.0, -1.0, 3.0, 1.0)).alias("b")).first().b
    assert (clipped.xmin, clipped.ymin, clipped.xmax, clipped.ymax) == (1.0, 0.0, 3.0, 1.0)
    assert df.select(F.size(geometry.clip_ring(F.col("r"), 10.0, 10.0, 11.0, 11.0))).first()[0] == 0


def test_entropy_and_tail(spark):
    assert one(spark, scalar.binary_entropy(F.col("p")), p=0.5) == 1.0
    assert one(spark, scalar.binary_entropy(F.col("p")), p=1.0) == 0.0
    assert one(spark, scalar.normal_tail(F.col("z")), z=1.0) == pytest.approx(0.5 * math.erfc(1 / math.sqrt(2)), abs=1e-6)
    assert one(spark, scalar.normal_tail(F.col("z")), z=-2.0) == pytest.approx(1 - 0.5 * math.erfc(2 / math.sqrt(2)), abs=1e-6)


def test_validation(spark):
    df = spark.createDataFrame([], "x double, y double")
    with pytest.raises(ValueError, match="line_id is missing"):
        validate(df, "fault_line")
    with pytest.raises(KeyError):
        validate(df, "nothing")


def test_adapters(spark):
    with pytest.raises(KeyError, match="known"):
        adapters.get_adapter("occurrences", "nowhere")
    raw = spark.createDataFrame([(1.0, 2.0, "Gold, Copper", "vein", None, "7"), (1.0, 2.0, "gold", "placer", None, "8"), (1.0, 2.0, None, None, None, "9")], "x double, y double, commodity string, dep_type string, oper_type string, id string")
    rows = validate(adapters.get_adapter("occurrences", "mrds")(raw), "occurrences").orderBy("raw_record_id").collect()
    assert [r.deposit_codes for r in rows] == [["usgs:36a", "usgs:36b"], [], []]
    holes = spark.createDataFrame([(0.0, 0.0, "a", 100.0, None, 600.0, None)], "x double, y double, hole_id string, max_cu_ppm double, max_mo_ppm double, max_au_ppb double, max_ag_ppm double")
    assert validate(adapters.get_adapter("drillholes", "bcgs_geofile")(holes), "drillhole").first().intersected
    rgs = spark.createDataFrame([(1.0, 2.0, -1.0, "40", "x")], "LONGITUDE double, LATITUDE double, AU_FA_PPB double, AU_INA_PPB string, DATE string")
    assert adapters.get_adapter("geochem", "bcgs_rgs")(rgs).first().Au_ppm == pytest.approx(0.04)
    units = spark.createDataFrame([(1, "Qal", None), (2, " ", "Kgr"), (3, None, None)], "poly_id long, PTYPE string, PTYPE2 string")
    got = {r.poly_id: (r.lith_group, r.is_quaternary_alluvium, r.lith_class) for r in adapters.get_adapter("geology", "cgs_2010")(units).collect()}
    assert got == {1: ("surficial", True, 0), 2: ("intrusive", False, 1), 3: ("other", False, 2)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y,flag\n1,2.5,3.5,Present\n2,20,30,absent\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), "id long, x double, y double, flag string")
    assert [r.id for r in readers.clip(df, Area(0, 0, 10, 10)).collect()] == [1]
    assert [r.flag for r in readers.downcast(df, ["flag"]).orderBy("id").collect()] == [True, False]
    (tmp_path / "g.json").write_text('{"features": [{"geometry": {"coordinates": [1.0, 2.0]}, "properties": {"n": "a"}}]}')
    assert readers.read_geojson(spark, str(tmp_path / "g.json"), "n:string").first().asDict() == {"x": 1.0, "y": 2.0, "n": "a"}


def test_tiles_equal_the_whole(spark):
    import numpy as np

    z = np.random.default_rng(0).random((20, 20))
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(20) for j in range(20)], "row long, col long, value double")
    kernel = lambda g: raster.gaussian(g, 1.0)
    got = {(r.row, r.col): r.out for r in raster.tiles(df, 6, 4, kernel).collect()}
    whole = kernel(z)
    assert all(abs(got[i, j] - whole[i, j]) < 1e-9 for i in range(20) for j in range(20))


def brute_token_set_ratio(a, b):
    """By sets of words and the longest common subsequence, plainly."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, c in enumerate(left):
        for j, e in enumerate(right):
            table[i + 1][j + 1] = table[i][j] + 1 if c == e else max(table[i][j + 1], table[i + 1][j])
    ab, ba = (f"{both} {w}".strip() for w in (left, right))
    ratio = lambda distance, total: 100.0 * (1 - distance / total) if total else 0.0
    best = ratio(len(left) + len(right) - 2 * table[-1][-1], len(ab) + len(ba))
    return max([best, *([ratio(len(w) - len(both), len(both) + len(w)) for w in (ab, ba)] if both else [])])


def test_token_set_ratio(spark):
    import random

    rng = random.Random(3)
    words = ["quartz", "vein", "pyrite", "pyritic", "a", "argillite", "argillic", "granite", ""]
    pairs = [("quartz vein", "vein quartz"), ("", ""), ("", "a"), ("a a", "a"), ("fuzzy was a bear", "fuzzy fuzzy was a bear"), ("abc", "xyz")]
    pairs += [(" ".join(rng.choices(words, k=rng.randrange(5))), " ".join(rng.choices(words, k=rng.randrange(5)))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    for r in df.select("i", token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r.r == pytest.approx(brute_token_set_ratio(*pairs[r.i])), pairs[r.i]


def test_nearest_of_points_without_a_place(spark):
    nan = float("nan")
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 1.0), (4, 9e4, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (8, None, 0.0), (9, 1.0, nan)], "k long, x double, y double")
    got = {r.id: (r.near_id, r.near_d) for r in spatial.nearest(left, right, "id", "k", 1.0).collect()}
    assert got[1] == (7, 5.0) and got[2] == got[3] == (None, None) and got[4][0] == 7
    assert all(r.near_id is None for r in spatial.nearest(left, right.limit(0), "id", "k", 1.0).collect()) and len(got) == 4


@pytest.mark.parametrize("descending", [True, False])
def test_order_of_a_frequent_value(spark, descending):
    rows = [(i, 0.0 if i % 10 else float(i % 7), i % 3) for i in range(3000)] + [(5000, None, 1)]
    df = spark.createDataFrame(rows, "id long, s double, c long")
    got = {r.id: (r.rank, r.c_upto) for r in ranking.ordered(df, "s", ["id"], descending=descending, sums={"c": F.col("c")}).collect()}
    upto = 0
    for k, (i, s, c) in enumerate(sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if descending else r[1], r[0]))):
        upto += c
        assert got[i] == (k + 1, upto)


def test_codes_of_sorted_text(spark):
    values = [f"v{i % 37:02}" for i in range(200)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = {v: i for i, v in enumerate(sorted({v for v in values if v}))} | {None: -1}
    assert all(r.code == want[r.v] for r in relational.factorize(df, "v").collect())



@pytest.mark.parametrize("boundary", [False, True])
def test_far_polygons_by_blocks(spark, boundary):
    """Blocks that look for shapes give the distances of shapes that look for cells."""
    import random

    rng = random.Random(11)
    g = Grid(0.0, 0.0, 10.0, 60, 90)
    rows = [(r, c) for r in range(60) for c in range(90) if rng.random() < 0.7]
    cells = spark.createDataFrame(rows, "row long, col long")
    rings = []
    for i, (x, y, w, h) in enumerate([(50, 60, 300, 180), (700, 500, 15, 25), (640, 20, 3, 3), (-900, 300, 50, 50)]):
        rings.append((i, [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]))
    polygons = spark.createDataFrame(rings, "poly_id long, ring array<struct<x:double,y:double>>")
    lines = polygons.withColumnRenamed("ring", "pts")
    for cap in (120.0, 5000.0):
        for run in (lambda k: spatial.polygon_distance(cells, polygons, g, cap, boundary, direct=k), lambda k: spatial.line_point_distance(cells, lines, g, 7.0, cap, direct=k)):  # noqa: B023
            near, far = ({(r.row, r.col): r.d for r in run(k).collect()} for k in (10**6, 0))
            assert len(near) == len(rows) and far == pytest.approx(near)


def test_reconcile(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    assert [tuple(r) for r in relational.reconcile(a, b).orderBy("i").collect()] == [(1, "x"), (2, None)]


def test_stream_state(spark, tmp_path):
    from lodestar.streaming import beliefs

    spark.createDataFrame([("a", 1), ("a", 1), ("b", 0)], "k string, obs int").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = beliefs.stream_parquet(spark, str(tmp_path / "in"), "k string, obs int")
    q = beliefs.running_belief(rows, "k", {"h1": 0.8, "h2": 0.2}).writeStream.format("memory").queryName("belief").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.k: (r.n, round(r.posterior, 4)) for r in spark.table("belief").collect()}
    assert got == {"a": (2, round(16 / 17, 4)), "b": (1, 0.2)}


def test_stage_is_built_once(spark, tmp_path):
    from lodestar.plans.storage import stage

    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert stage(spark, str(tmp_path), "s", "v1", build).count() == 3
    assert stage(spark, str(tmp_path), "s", "v1", build).count() == 3 and len(calls) == 1


def test_metrics_and_model_card(spark, tmp_path):
    from lodestar.plans import storage

    df = spark.createDataFrame([("lr", 0.91234567, 3), ("rf", None, 4)], "model string, auc double, n long")
    storage.write_metrics(df, str(tmp_path / "m"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "m"), df.schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    card = storage.model_card("Map", {"Folds": df}, "A note.")
    assert card.startswith("# Map\n\nA note.\n\n## Folds\n\n| model | auc | n |\n| - | - | - |\n") and "| lr | 0.9123 | 3 |" in card and "| rf |  | 4 |" in card
    with pytest.raises(ValueError):
        storage.model_card("Map", {"Rows": spark.range(500).toDF("i")})


def test_rasters_of_two_shapes(spark):
    a, b = (spark.createDataFrame([(0, i, 1.0) for i in range(n)], "row long, col long, value double") for n in (3, 4))
    assert raster.two_bands(a, a).count() == 3
    with pytest.raises(ValueError):
        raster.two_bands(a, b)


def test_order_of_many_nulls_and_ties_is_dealt_to_ranges(spark):
    import random

    from lodestar.operators import ranking

    draw = random.Random(9)
    for kind in ("long", "string"):
        keys = list(range(4000)) if kind == "long" else [f"k{i:04d}ä" for i in range(4000)]
        draw.shuffle(keys)
        rows = [(k, None if i % 3 else draw.choice([1.0, 2.0, 2.0, 2.0])) for i, k in enumerate(keys)]
        df = spark.createDataFrame(rows, f"k {kind}, s double")
        out = ranking.ordered(df, "s", ["k"])
        got = {r.k: r["rank"] for r in out.collect()}
        want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        assert [got[k] for k, _ in want] == list(range(1, 4001))
        value = F.col("s").cast("double")
        found = sorted(df.agg(F.percentile_approx(value, [i / 8 for i in range(1, 8)], 400)).first()[0])
        parts = df.withColumn("q", ranking._tie_range(df, value, found, ["k"], 6)).where("s is null").groupBy("q").count().collect()
        assert len(parts) > 4 and max(r["count"] for r in parts) < 1200


def test_near_any_by_cells(spark):
    import random

    from lodestar.operators import spatial

    draw = random.Random(4)
    place = lambda: (float(draw.randrange(60)), float(draw.randrange(60))) if draw.random() < 0.9 else (None, 1.0)
    left, right = [(i, *place()) for i in range(300)], [(i, *place()) for i in range(40)] + [(99, 5.0, 5.0)] * 50
    a, b = (spark.createDataFrame(x, "id long, x double, y double") for x in (left, right))
    for strict in (False, True):
        ok = (lambda d: d < 5) if strict else (lambda d: d <= 5)
        want = {i for i, x, y in left if x is not None and any(u is not None and ok(math.hypot(x - u, y - v)) for _, u, v in right)}
        assert {r.id for r in spatial.near_any(a, b, 5.0, "id", strict).collect()} == want and 50 < len(want) < 250
    assert spatial.near_any(a, b.limit(0), 5.0, "id").count() == 0
