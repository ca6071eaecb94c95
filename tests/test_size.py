"""What keeps work from growing faster than its input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import sampling


def test_replicates_are_hashed_once_in_all_tasks(spark):
    df = spark.range(300).coalesce(1).withColumn("v", F.col("id") % 7)
    got = sampling.replicated(df, "id", 4, 9)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # one small file is one task
    assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    drawn = df.crossJoin(spark.range(4).select(F.col("id").cast("int").alias("rep"))).withColumn("w", sampling.poisson_weight(sampling.unit_hash(9, "rep", "id")))
    want = sorted((r.id, r.v, r.rep, r.w) for r in drawn.where("w > 0").collect())
    assert sorted((r.id, r.v, r.rep, r.w) for r in got.collect()) == want


def test_decayed_sums_of_a_group_do_not_depend_on_the_span():
    """One factor a row, and doubled sums of neighbours where lengths span too many decays, against pairs."""
    import pyarrow as pa

    from lodestar.operators import network

    rng = np.random.default_rng(6)
    for wide in (1.0, 40.0):  # 300 lengths are 60 near decays; 12,000 are 2,400
        m = (rng.random(300) < 0.6).astype(float)
        length, p = np.round(rng.random(300) * 300) * wide, rng.integers(0, 40, 300).astype(float)
        n, v = m * rng.integers(0, 3, 300), m * rng.random(300)
        group = pa.table({"f": np.full(300, 2, np.int32), "comid": np.arange(300), "p": p, "len": length, "m": m, "n": n, "v": v})
        got = network._own(group, 5.0, 25.0, 0.3).to_pylist()
        assert len(got) > 100
        for r in got:
            i = r["comid"]
            above = (m > 0) & (p >= p[i])
            d = np.maximum(length[above] - length[i], 0)
            w = np.exp(-d / 5) + 0.3 * np.exp(-d / 25)
            assert m[i] == 0 and r["f"] == 2 and (r["m"], r["n"]) == (above.sum(), n[above].sum())
            assert r["w"] == pytest.approx((w * n[above]).sum(), rel=1e-11) and r["wv"] == pytest.approx((w * v[above]).sum(), rel=1e-11)


def test_folds_are_summed_in_one_job(spark, monkeypatch):
    from lodestar.operators import folds
    from lodestar.plans import storage

    written = []
    real = storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df: written.append(1) or real(df))
    cells = spark.range(200).selectExpr("id comid", "id hydroseq", "cast(id * 37 % 91 as double) arbolate")
    samples = spark.range(400).selectExpr("id % 190 hydroseq", "cast(id * 13 % 97 as double) arbolate", "cast(id % 5 as double) value", "cast(id % 4 as int) fold")
    assert folds.decay_without_fold(cells, samples, [0, 1, 2, 3], ranges=3).count() == 4 * 190
    assert len(written) <= 6


def test_shapes_are_cut_and_united_in_all_tasks(spark, monkeypatch):
    """One file of small shapes makes as many tasks as there are; a lone piece isn't swept again, and few rows at a time are Python objects."""
    from lodestar.operators import overlay

    box = lambda x, y, w: F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (w, 0), (w, w), (0, w), (0, 0))))
    shapes = spark.range(60).coalesce(1).selectExpr("id", "cast(id % 10 * 9 as double) x", "cast(id div 10 * 9 as double) y").select("id", F.array(box(F.col("x"), F.col("y"), 12.0)).alias("rings"))
    pieces = overlay.cut(shapes, 10.0)
    assert pieces.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    mask = overlay.union(pieces, 10.0, together=2)
    assert mask.agg(F.sum(overlay.piece_area(10.0))).first()[0] == pytest.approx(93 * 57)
    rest = overlay.clip(overlay.cut(shapes, 10.0), overlay.union(overlay.cut(shapes.where("id < 10"), 10.0), 10.0), 10.0, inside=False)
    assert rest.agg(F.sum(overlay.piece_area(10.0))).first()[0] == pytest.approx(sum(144 - 36 * (10 <= i < 20) for i in range(10, 60)))
    assert [b.num_rows for b in overlay._slices(iter([__import__("pyarrow").record_batch({"a": list(range(150))})]))] == [64, 64, 22]


def test_leave_one_out_weighs_rows_in_all_tasks(spark, monkeypatch):
    from lodestar.operators import folds
    from lodestar.plans import storage

    parts = []
    real = storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df: parts.append(df.rdd.getNumPartitions()) or real(df))
    df = spark.range(90).coalesce(1).selectExpr("id", "id * 7 % 13 / 13.0 a", "cast(id % 9 = 0 as int) label")
    assert folds.leave_one_out(df, ["a"], "id").count() == 10
    assert parts == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_fits_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    """One small file makes as many tasks as its rows ask for; weights need no join by class; the order of the rows is moot."""
    from lodestar.operators import learning

    monkeypatch.setattr(learning, "TASK_ROWS", 100)
    df = spark.range(500).coalesce(1).selectExpr("id", "id * 37 % 101 / 101.0 a", "id * 13 % 29 / 29.0 b", "case when id % 50 > 0 then cast(id * 37 % 101 + id * 13 % 29 > 70 as int) end label")
    got = learning.balanced(df, "label")
    assert got.rdd.getNumPartitions() == 5 and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    sums = {r.label: (r.n, r.w) for r in got.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    assert set(sums) == {0, 1} and sums[0][0] + sums[1][0] == 490 and sums[0][1] == pytest.approx(sums[1][1])
    rows = df.where("label is not null")
    runs = [sorted(map(tuple, learning.pu_bagging(x, ["a", "b"], "id", "label", 2, 5).collect())) for x in (rows, rows.orderBy(F.desc("id")))]
    assert runs[0] == runs[1] and len(runs[0]) > 300
    folds = rows.withColumn("fold", (F.col("id") % 2).cast("int"))
    oof = learning.out_of_fold(folds, {"p": learning.forest(["a", "b"], trees=3)}, 2, ["id", "label"])
    assert oof.count() == 490 and oof.inputFiles()  # written, so the stack doesn't score again


def test_bags_are_drawn_and_scored_once(spark, monkeypatch):
    from lodestar.operators import learning
    from lodestar.plans import storage

    written = []
    real = storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df: written.append(df.columns) or real(df))
    df = spark.range(200).selectExpr("id", "id * 37 % 101 / 101.0 a", "cast(id % 5 = 0 as int) y", "'long' as text")
    got = learning.pu_bagging(df, ["a"], "id", "y", 3, 1)
    assert [sorted(c) for c in written] == [["a", "bag", "id", "in_bag", "label"]]
    assert "md5(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("id % 5 = 0 and n_bags < 3").isEmpty()


def test_flow_sends_no_cells_through_the_driver(spark, monkeypatch):
    from lodestar.operators import raster
    from lodestar.plans import storage

    plans = []
    real = storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    df = spark.range(60).selectExpr("id div 10 as row", "id % 10 as col", "cast(id as double) as value")
    assert raster.flow_accumulation(df).agg(F.max("flow")).first()[0] > 1
    assert len(plans) > 2 and not [p for p in plans if "Broadcast" in p]


def test_subarea_prior_joins_its_map_once_by_shuffle(spark, monkeypatch):
    from lodestar.operators import validation
    from lodestar.plans import storage
    from lodestar.queries import QUERIES

    plans = []
    real = storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    got = QUERIES["subarea_prior"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 1 and "Broadcast" not in plans[0]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString() and got.columns == ["x", "y", "p_prior", "label"]
    assert "Broadcast" not in validation.subarea(spark.createDataFrame([(1.0, 2.0, 1)], "x double, y double, label int"), "label", 1.0)._jdf.queryExecution().executedPlan().toString()


def test_points_outside_are_told_by_place(spark):
    """No join or gathering by key; points without a whole place are near nothing."""
    from lodestar.operators import spatial

    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0), (3, None, 0.0), (4, float("nan"), 0.0), (5, 0.0, 0.0), (6, 3.0, 4.0)], "id long, x double, y double")
    right = spark.createDataFrame([(0.0, 0.0), (float("nan"), 0.0), (None, 1.0)], "x double, y double")
    got = spatial.outside(left, right, 5.0, "id")
    assert {r.id for r in got.collect()} == {2, 3, 4} and got.columns == left.columns
    assert {r.id for r in spatial.outside(left, right, 5.0, "id", strict=True).collect()} == {2, 3, 4, 6}
    assert {r.id for r in spatial.inside(left, right, 5.0, "id").collect()} == {1, 5, 6} == {r.id for r in spatial.near_any(left, right, 5.0, "id").collect()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


def test_samples_are_grouped_in_tasks_of_bounded_size(spark, monkeypatch):
    from lodestar.queries import registry

    monkeypatch.setattr(registry, "SAMPLE_ROWS", 500)
    d = "/root/testdata/sf0.001"
    rows = registry.table(spark, d, "lineitem")
    n, ids = rows.count(), rows.selectExpr("l_orderkey * 8 + l_linenumber").distinct().count()
    got = registry.samples(spark, d)
    assert got.rdd.getNumPartitions() == -(-n // 500) > 8 and got.count() == ids


def test_low_percentile_sends_a_cell_along_rows_then_columns(spark):
    """As the percentile over all pairs of near cells, with cells and values missing."""
    from lodestar.operators import raster

    df = spark.range(120).where("id % 7 <> 3 and id <> 40").selectExpr("id div 10 as row", "id % 10 as col", "case when id % 5 > 0 and id < 100 then id * 37 % 41 / 3.0 end as value").coalesce(1)
    got = raster.elevation_percentile(df, 2, 0.1)
    want = raster.focal(df, 2, F.percentile("v", 0.1), "low")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.count("Aggregate") == 2  # one between them


def test_channels_are_asked_for_in_turn(spark, monkeypatch):
    """The flow is written once, and its percentile isn't taken where there are mapped channels."""
    from lodestar.operators import terrain
    from lodestar.queries import QUERIES

    monkeypatch.setattr(terrain, "flow_channels", lambda *a: pytest.fail("not needed"))
    got = QUERIES["paleochannel_likelihood"](spark, "/root/testdata/sf0.001")
    assert got.where("likelihood is not null").count() > 0
