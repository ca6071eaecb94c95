"""Features and fits that leave something out, against naive recomputation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.model import Grid
from lodestar.operators import folds, network, spatial


def test_radius_without_fold_equals_recomputation(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y), int(f) if f < 3 else None, None if i % 5 == 0 else float(v)) for i, (x, y, f, v) in enumerate(zip(*rng.uniform(0, 10, (2, 80)), rng.integers(0, 4, 80), rng.normal(size=80)))]
    points = spark.createDataFrame(rows, "id long, x double, y double, fold int, v double")
    grid = Grid(0.0, 0.0, 1.0, 10, 10)
    got = {(r.row, r.col, r.fold): (r.v_mean, r.v_max, r.v_count, r.v_has_data) for r in folds.radius_without_fold(points, grid, 1.5, ["v"], [0, 1, 2]).collect()}
    near = spatial.cells_within(points, grid, 1.5).select("row", "col").distinct().count()
    assert len(got) == 3 * near
    for f in range(3):
        want = {(r.row, r.col): r for r in spatial.radius_aggregate(points.where(f"fold is null or fold <> {f}"), grid, 1.5, ["v"]).collect()}
        for (row, col, g), (mean, top, n, has) in got.items():
            if g == f:
                w = want.get((row, col))
                assert (n, has, top) == ((w.v_count, w.v_has_data, w.v_max) if w else (0, 0, None))
                assert mean is None if not n else mean == pytest.approx(w.v_mean, rel=1e-12)


@pytest.mark.parametrize("how", [{}, {"ranges": 4, "rows": 60}])
def test_decay_without_fold_equals_recomputation(spark, how):
    rng = np.random.default_rng(1)
    cells = [(i, int(rng.integers(60)), float(rng.uniform(0, 900))) for i in range(40)]
    samples = [(int(rng.integers(60)), float(rng.uniform(0, 900)), float(rng.normal()), int(rng.integers(3))) for _ in range(60)]
    c, s = spark.createDataFrame(cells, "comid long, hydroseq long, arbolate double"), spark.createDataFrame(samples, "hydroseq long, arbolate double, value double, fold int")
    got = {(r.comid, r.fold): (r.n_samples, r.catchment) for r in folds.decay_without_fold(c, s, [0, 1, 2], **how).collect()}
    for i, h, x in cells:
        for f in range(3):
            w = [(math.exp(-d / 5) + 0.3 * math.exp(-d / 25), v) for q, y, v, g in samples if q >= h and g != f for d in [max(y - x, 0)]]
            if not any(q >= h for q, *_ in samples):
                assert (i, f) not in got
                continue
            n, v = got[i, f]
            assert n == len(w)
            # far samples alone leave tiny weights: nothing may be lost by taking one's own fold off
            total = sum(a for a, _ in w)
            assert v is None if total == 0 else v == pytest.approx(sum(a * b for a, b in w) / total, rel=1e-9)


def fit_alone(x, y, penalty):
    n, pos = len(y), y.sum()
    c = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos)))
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 0.0) * n
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (c * (p - y)) + ridge * w)
        w -= step
    return w


def test_leave_one_out_equals_separate_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) > 1.8).astype(int)
    df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(400)], "id long, a double, b double, c double, label int")
    rows = folds.leave_one_out(df.repartition(5), ["a", "b", "c"], "id", penalty=1e-2).collect()
    assert len(rows) == y.sum() > 20
    full = np.concatenate([x, np.ones((400, 1))], 1)
    for r in rows:
        keep = np.arange(400) != r.id
        w = fit_alone(full[keep], y[keep], 1e-2)
        p = 1 / (1 + np.exp(-full @ w))
        assert r.score == pytest.approx(p[r.id], abs=1e-6)
        assert abs(r.higher - (p > p[r.id]).sum()) <= 1 and r.pct == pytest.approx(100 * r.higher / 400)


def test_leave_one_out_passes_do_not_grow_with_positives(spark, monkeypatch):
    passes = []
    real = folds._gradients
    monkeypatch.setattr(folds, "_gradients", lambda *a, **k: passes.append(1) or real(*a, **k))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    count = []
    for n in (8, 120):
        y = np.zeros(600, int)
        y[np.argsort(-(x[:, 0] + rng.normal(size=600)))[:n]] = 1
        df = spark.createDataFrame([(i, *map(float, x[i]), int(y[i])) for i in range(600)], "id long, a double, b double, label int")
        passes.clear()
        assert folds.leave_one_out(df, ["a", "b"], "id", penalty=1e-2).count() == n
        count.append(len(passes))
    assert max(count) < 45 and count[1] <= count[0] + 3, count


def test_leave_one_out_odd_inputs(spark):
    df = spark.createDataFrame([(i, float(i % 3) if i % 4 else None, 1 if i < 1 else 0) for i in range(12)], "id long, a double, label int")
    assert folds.leave_one_out(df, ["a"], "id").count() == 0  # without a second positive there is nothing left to learn
    assert folds.leave_one_out(df.limit(0), ["a"], "id").count() == 0
    with pytest.raises(ValueError):
        folds.leave_one_out(df.withColumn("label", F.lit(1) - (F.col("id") == 3).cast("int")), ["a"], "id", most=4)


def test_fold_metrics(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(3)), int(rng.random() < 0.3), float(rng.integers(12)), float(rng.random())) for _ in range(300)] + [(3, 0, 1.0, 0.5), (3, 0, 2.0, None)]
    got = {(r.model, r.fold): r for r in folds.fold_metrics(spark.createDataFrame(rows, "fold int, label int, u double, v double"), ["u", "v"], [0, 1, 2, 3]).collect()}
    for k, name in enumerate("uv"):
        for f in range(3):
            s, y = np.array([r[2 + k] for r in rows if r[0] == f]), np.array([r[1] for r in rows if r[0] == f])
            auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
            ap = sum(((s == t) & (y == 1)).sum() * (y[s >= t]).mean() for t in np.unique(s)) / y.sum()
            assert got[name, f].auc == pytest.approx(auc) and got[name, f].ap == pytest.approx(ap) and got[name, f].n == len(y)
        assert got[name, 3].auc is None and got[name, 3].ap is None
