"""Fusion, priors, texture and sources in parts, against computations of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.model import Area, Grid
from lodestar.operators import raster, validation
from lodestar.sources import adapters


def balanced_fit(x, y, steps=60):
    """Newton's method for half the squared weights (not the intercept) plus the balanced losses."""
    z = np.column_stack([x, np.ones(len(x))])
    s = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum())
    w, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(ridge + (z * (s * p * (1 - p))[:, None]).T @ z, ridge @ w + z.T @ (s * (p - y)))
    return w, 1 / (1 + np.exp(-z @ w))


def test_context_fusion(spark):
    rng = np.random.default_rng(2)
    n = 400
    a, b, c = rng.random(n), rng.random(n), rng.normal(0, 2, n)
    y = (a + 0.5 * b + 0.2 * c + rng.normal(0, 0.5, n) > 1.0).astype(int)
    none_a, none_b, odd = rng.random(n) < 0.3, rng.random(n) < 0.3, rng.integers(0, 12, n)
    rows = [(i, None if none_a[i] else float(a[i]), None if none_b[i] else float(b[i]), {0: None, 1: float("nan"), 2: float("inf")}.get(int(odd[i]), float(c[i])), int(y[i]) or None) for i in range(n)]
    got, learned = validation.context_fusion(spark.createDataFrame(rows, "id long, a double, b double, c double, label int"), ["a", "b"], ["c"], "label")
    got = {r.id: r.p_combined for r in got.collect()}
    covered = ~(none_a & none_b)
    x = np.column_stack([np.where(none_a, 0, a), np.where(none_b, 0, b), np.where(odd < 3, np.median(c[odd >= 3]), c)])[covered]
    w, p = balanced_fit(x, y[covered])
    assert [got[i] is None for i in range(n)] == (~covered).tolist()
    assert np.allclose([got[i] for i in np.flatnonzero(covered)], p, atol=1e-5)
    assert np.allclose([*learned["weights"].values(), learned["intercept"]], w, atol=1e-4) and learned["n"] == covered.sum()


def test_context_fusion_needs_positives(spark):
    df = spark.createDataFrame([(i, 0.5, 1.0, int(i < 3)) for i in range(40)], "id long, a double, c double, label int")
    with pytest.raises(ValueError, match="3 positives"):
        validation.context_fusion(df, ["a"], ["c"], "label")


def test_subarea(spark):
    rows = [(float(x), float(y), int(x == 7 and y in (3, 5)), float(x * y % 5)) for x in range(12) for y in range(12)]
    df = spark.createDataFrame(rows, "x double, y double, label int, f double")
    assert {(r.x, r.y) for r in validation.subarea(df, "label", 4.0).collect()} == {(float(x), float(y)) for x in range(5, 10) for y in range(2, 7)}
    got = validation.subarea_prior(df, ["f"], "label", 4.0, trees=5).collect()
    assert len(got) == 25 and sum(r.label for r in got) == 2 and all(0 <= r.p_prior <= 1 for r in got)
    with pytest.raises(ValueError, match="no positive"):
        validation.subarea(df.where("label = 0"), "label", 4.0)


def test_map_without_scores(spark):
    """Points over cells without a score, and an empty map."""
    m = spark.createDataFrame([(0, 0, 0.5), (0, 1, None), (1, 0, 0.9), (1, 1, 0.5)], "row long, col long, s double")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 15.0, 5.0), (3, -90.0, 15.0), (4, 15.0, 15.0)], "id long, x double, y double")
    got = {r.id: (r.n_higher, r.percentile and round(r.percentile, 3)) for r in validation.map_percentile(p, m, Grid(0.0, 0.0, 10.0, 2, 2), "s").collect()}
    assert got == {1: (1, 66.667), 2: (None, None), 3: (0, 100.0), 4: (1, 66.667)}
    assert {r.n_higher for r in validation.map_percentile(p, m.limit(0), Grid(0.0, 0.0, 10.0, 2, 2), "s").collect()} == {None}


def test_region_without_cells(spark):
    df = spark.createDataFrame([(0.2, 1, 1.0), (None, 0, 2.0)], "s double, label int, c double")
    r = validation.region_validation(df, F.lit(None).cast("boolean"), F.lit(True), ["s"], "label", "c").first()
    assert (r.n_inside, r.positives_inside, r.median_inside, r.lift, r.n_barren, r.median_barren, r.n_corr) == (0, 0, None, None, 2, 0.2, 1)


def test_texture_against_matrices(spark):
    rng = np.random.default_rng(5)
    z = rng.random((11, 9))
    z[2:8, 2:8] = 0.4  # a flat part
    rows = [(i, j, None if (i, j) == (9, 4) else float(z[i, j])) for i in range(11) for j in range(9) if (i, j) != (0, 8)]
    got = {(r.row, r.col): r for r in raster.texture(spark.createDataFrame(rows, "row long, col long, value double")).collect()}
    known = np.array([v for *_, v in rows if v is not None])
    lo, hi = np.percentile(known, [5, 95])
    q = {(i, j): 0 if v is None else int(min(max((v - lo) / (hi - lo), 0), 1) * 15) for i, j, v in rows}
    i, j = np.meshgrid(np.arange(16), np.arange(16), indexing="ij")
    for (r, c), row in got.items():
        pairs = [(q[a, b], q[a, b + 1]) for a in range(r - 2, r + 3) for b in range(c - 2, c + 2) if (a, b) in q and (a, b + 1) in q]
        if len(pairs) < 20:
            assert row.contrast is None and row.correlation is None
            continue
        m = np.zeros((16, 16))
        for a, b in pairs:
            m[a, b] += 1
            m[b, a] += 1
        m /= m.sum()
        mean = (m * i).sum()
        spread = (m * (i - mean) ** 2).sum()
        want = [(m * (i - j) ** 2).sum(), (m * abs(i - j)).sum(), (m / (1 + (i - j) ** 2)).sum(), (m * (i - mean) * (j - mean)).sum() / spread if spread > 1e-12 else 1.0]
        assert np.allclose([row.contrast, row.dissimilarity, row.homogeneity, row.correlation], want, atol=1e-9)


def test_state_of():
    assert [adapters.state_of(Area(*b)) for b in ((-121, 39, -120, 40), (-145, 63, -141, 64), (-112, 33, -110, 34))] == ["CA", "AK", "AZ"]
    with pytest.raises(ValueError, match="no state"):
        adapters.state_of(Area(0, 0, 1, 1))


def test_strips_repeat(spark):
    df = spark.range(50)
    a, b = (validation.strips(df, "id", (0.0, 0.0, 100.0, 80.0), (1, 2), (4, 6), 5.0, 1, 10.0).collect() for _ in range(2))
    assert a == b
    for r in a:
        (x0, y0), (x1, y1), (x2, y2) = ((p.x, p.y) for p in r.ring[:3])
        long, wide = np.hypot(x1 - x0, y1 - y0), np.hypot(x2 - x1, y2 - y1)
        assert round(long, 6) in (20.0, 25.0, 30.0) and round(wide, 6) in (5.0, 10.0) and r.ring[0] == r.ring[4]
        assert 10 <= (x0 + x2) / 2 <= 90 and 10 <= (y0 + y2) / 2 <= 70
