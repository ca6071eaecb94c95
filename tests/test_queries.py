"""Every query of the library against its SQL; those without SQL against invariants."""

import pytest
from conftest import duck_at, same_rows

from lodestar.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"  # rasters need full rows


@pytest.fixture(scope="module")
def larger():
    return duck_at(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, larger, name):
    same_rows(QUERIES[name](spark, SF), larger.execute(ORACLE_SQL[name]).df())


def test_probabilities(spark):
    for name, column in (("oof_stack", "p_stack"), ("isotonic", "p_cal"), ("transfer", "p"), ("expected_deposit", "p")):
        low, high, n = QUERIES[name](spark, SF).selectExpr(f"min({column})", f"max({column})", "count(*)").first()
        assert n > 0 and 0 <= low <= high <= 1, name


def test_bootstrap_interval(spark):
    row = QUERIES["bootstrap_capture"](spark, SF).first()
    assert row.lo <= row.capture <= row.hi


def test_flow_accumulation_counts_every_cell(spark):
    import numpy as np

    from lodestar.operators.raster import flow_accumulation

    z = np.random.default_rng(0).random((9, 7))
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(9) for j in range(7)], "row long, col long, value double")
    got = {(r.row, r.col): r.flow for r in flow_accumulation(df).collect()}
    flow, to = np.ones((9, 7), int), {}
    for i, j in np.ndindex(9, 7):
        best = max(
            ((z[i, j] - z[a, b]) / np.hypot(a - i, b - j), -a, -b) for a in range(max(0, i - 1), min(9, i + 2)) for b in range(max(0, j - 1), min(7, j + 2)) if (a, b) != (i, j)
        )
        if best[0] > 0:
            to[i, j] = (-best[1], -best[2])
    for i, j in sorted(np.ndindex(9, 7), key=lambda c: -z[c]):
        if (i, j) in to:
            flow[to[i, j]] += flow[i, j]
    assert got == {c: int(flow[c]) for c in np.ndindex(9, 7)}


def test_dbscan_matches_brute_force(spark):
    import numpy as np

    from lodestar.operators.clusters import dbscan

    xy = np.random.default_rng(1).random((120, 2)) * 10
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r.id: r.cluster for r in dbscan(df, "id", 0.9, 4).collect()}
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) <= 0.9
    core = near.sum(1) >= 4
    label = np.where(core, np.arange(120), 10**6)
    for _ in range(120):
        for i in np.flatnonzero(core):
            label[i] = label[near[i] & core].min()
    for i in range(120):
        if core[i]:
            assert got[i] == label[i]
        else:
            reach = label[near[i] & core]
            assert got[i] == (reach.min() if len(reach) else None)
