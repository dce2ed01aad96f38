"""All pairs of two sides: dealt to tasks, never shuffled."""

import math
import re

import numpy as np

from tesserae.functions import kernels
from tesserae.operators import coo, iterate


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, x):
    return spark.createDataFrame([(k, [float(c) for c in p]) for k, p in enumerate(x)], "dof long, x array<double>")


def test_pairs_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(iterate, "PAIRS_A_TASK", 100)
    left, right = spark.range(50, numPartitions=1).select(iterate.F.col("id").alias("a")), spark.range(20, numPartitions=1)
    pairs = iterate.paired(left, right)
    assert pairs.rdd.getNumPartitions() == 10 and pairs.distinct().count() == 1000


def test_kernel_pairs_are_made_without_shuffle_or_array_functions(spark):
    x = np.random.default_rng(1).normal(size=(30, 3))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    found = kernels.matrix_of(points(spark, x), points(spark, x), kernels.exponential)
    text = plan(found)
    assert "zip_with" not in text and "CartesianProduct" not in text and "hashpartitioning" not in text
    assert all(math.isclose(r.v, math.exp(-d[r.i, r.j]), rel_tol=1e-12) for r in found.collect()) and found.count() == 900


def test_kernel_times_vector_adds_pairs_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(iterate, "PAIRS_A_TASK", 100)
    x = np.random.default_rng(2).normal(size=(40, 2))
    w = spark.createDataFrame([(k, float(k % 5)) for k in range(40) if k != 7], "i long, v double")
    found = kernels.mul_vec(points(spark, x), points(spark, x), kernels.exponential, w)
    text = plan(found)
    after = text[: text.index("NestedLoopJoin")]
    assert len(re.findall(r"Exchange hashpartitioning", after)) == 1 and "HashAggregate" in after and "Join" not in after.replace("BroadcastNested", "")
    weights = np.array([k % 5 if k != 7 else 0 for k in range(40)])
    expected = np.exp(-np.linalg.norm(x[:, None] - x[None], axis=2)) @ weights
    got = {r.i: r.v for r in found.collect()}
    assert np.allclose([got[k] for k in range(40)], expected)


def test_rounding_of_many_rows(spark):
    given = [0.5, -0.5, 1.23445, -1.23445, 2.5, 123.456789, -1e-9, 0.0, 1e20, -1e20, float("inf"), float("-inf"), 9999.99995]
    found = spark.createDataFrame([(v,) for v in given], "v double").select(iterate.rounded(iterate.F.col("v"), 4).alias("a"), iterate.F.round("v", 4).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found]
    assert all(math.copysign(1, r.a) == 1 for r in found if r.a == 0)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(iterate.rounded(iterate.F.col("v"), 4).alias("a")).collect()
    assert odd[0].a is None and math.isnan(odd[1].a)


def test_rank1_pairs_beyond_the_matrix_are_not_grouped(spark):
    """Entries at known and unknown rows and columns; sums only where a has both."""
    a = spark.createDataFrame([(0, 0, 1.0), (0, 3, 2.0), (9, 1, 4.0)], "i long, j long, v double")
    x = spark.createDataFrame([(k, k + 1.0) for k in range(4)], "i long, v double")
    found = coo.add_rank1(a, 2.0, x, x)
    expected = {(i, j): 2.0 * (i + 1) * (j + 1) for i in range(4) for j in range(4)}
    for i, j, v in ((0, 0, 1.0), (0, 3, 2.0), (9, 1, 4.0)):
        expected[i, j] = expected.get((i, j), 0.0) + v
    assert {(r.i, r.j): r.v for r in found.collect()} == expected and found.count() == len(expected)
    text = plan(found)
    assert text.count("NestedLoopJoin") >= 3 and "SortMergeJoin" not in text
