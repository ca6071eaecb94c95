"""Density clusters and their names against brute force."""

import math

import numpy as np
import pytest

from lodestar.operators.clusters import cluster_names, dbscan


def brute(xy, eps, least):
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(xy)), 10**9)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], 10**9).min(1, initial=10**9), 10**9)
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], 10**9).min(1, initial=10**9)
    return [int(b) if b < 10**9 else None for b in np.where(core, label, border)]


@pytest.mark.parametrize("pairs", [1024, 4])
def test_clusters(spark, pairs):
    """Tight clumps (halved when few pairs are allowed), a bridge, thin points, copies of one place, points without a place."""
    rng = np.random.default_rng(3)
    xy = np.concatenate([
        rng.normal((0, 0), 0.25, (60, 2)), rng.normal((1.9, 0.2), 0.2, (60, 2)), np.stack([np.linspace(6, 11, 9), np.full(9, 2.0)], 1), np.repeat([[-5.0, -5.0]], 6, 0), [[-4.2, -5.0]], rng.random((60, 2)) * 14 - 4,
    ])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    lost = [(9000, None, 1.0), (9001, float("nan"), 1.0)]
    got = {r.id: r.cluster for r in dbscan(spark.createDataFrame(rows + lost, "id long, x double, y double"), "id", 0.8, 4, pairs).collect()}
    want = brute(xy, 0.8, 4)
    assert got == {i: want[i] for i in range(len(xy))} | {9000: None, 9001: None}


def test_clusters_of_one_point_or_none(spark):
    schema = "id long, x double, y double"
    assert dbscan(spark.createDataFrame([], schema), "id", 1.0, 2).count() == 0
    assert [r.cluster for r in dbscan(spark.createDataFrame([(5, 0.0, 0.0)], schema), "id", 1.0, 1).collect()] == [5]


def test_cluster_names(spark):
    rng = np.random.default_rng(4)
    centres = [(float(a), float(b)) for a, b in np.stack([rng.uniform(-60, 60, 30), rng.uniform(-170, 170, 30)], 1)]
    named = [(f"n{i}", a + float(rng.normal(0, 0.2)), b + float(rng.normal(0, 0.3))) for i, (a, b) in enumerate(centres) if i % 3]
    members = [(i, a + s, b) for i, (a, b) in enumerate(centres) for s in (-0.01, 0.01)] + [(None, 0.0, 0.0)]
    got = {r.cluster: r for r in cluster_names(spark.createDataFrame(members, "cluster long, lat double, lon double"), spark.createDataFrame(named, "name string, lat double, lon double"), 0.3).collect()}
    assert len(got) == 30
    for i, (a, b) in enumerate(centres):
        d, name = min(((math.hypot(a - p, (b - q) * math.cos(math.radians(a))), n) for n, p, q in named), default=(9.0, ""))
        if d <= 0.3:
            assert got[i].name == name and got[i].d == pytest.approx(d, abs=1e-9)
        else:
            assert got[i].d is None and got[i].name.startswith("cluster_lat") and "-" not in got[i].name and "." not in got[i].name
