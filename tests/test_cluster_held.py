"""Cluster trees that are built where their points are gathered, against levels of jobs."""

import numpy as np
import pytest

from tesserae.operators import cluster


def trees(points, **how):
    tree, order = cluster.build(points, **how)
    return sorted(map(tuple, tree.collect())), sorted(map(tuple, order.collect()))


@pytest.mark.parametrize("how", [{"leaf_size": 8}, {"leaf_size": 30, "least_level": 4}, {"leaf_size": 3, "max_level": 5, "split": cluster.geometric(adaptive=False)}])
def test_held_clusters_equal_levels(spark, monkeypatch, how):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 2)).round(1), np.full((20, 2), 0.5)])  # ties, and points that no split parts
    points = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(rng.permutation(len(x)), x, strict=True)], "dof long, x array<double>")
    monkeypatch.setattr(cluster, "HELD_POINTS", 0)
    levels = trees(points, **how)
    for held in (60, 10_000):
        monkeypatch.setattr(cluster, "HELD_POINTS", held)
        assert trees(points, **how) == levels


def test_held_clusters_take_no_job_a_level(spark, monkeypatch):
    tables = []
    settle = cluster.settled
    monkeypatch.setattr(cluster, "settled", lambda df: tables.append(1) or settle(df))
    points = spark.range(3000).selectExpr("id AS dof", "array(double(id), double(id * id)) AS x")
    tree, _ = cluster.build(points, leaf_size=10)
    assert tree.where("is_leaf").count() > 100 and len(tables) <= 4


def test_points_without_a_box_go_by_levels(spark):
    points = spark.createDataFrame([(k, [float(k), float("nan") if k == 7 else 0.0]) for k in range(40)], "dof long, x array<double>")
    tree, order = cluster.build(points, leaf_size=10)
    assert order.count() == 40 and sorted(r.i for r in order.collect()) == list(range(40)) and tree.count() >= 1
