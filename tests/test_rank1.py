"""Products of two vectors as operators, and the queries that solve with one."""

import numpy as np
import pandas as pd
import pytest

from tesserae.operators import coo, solve
from tesserae.plans import linop, queries


def vec(spark, x):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double").coalesce(1)


def values(x, n):
    found = {r.i: r.v for r in x.collect()}
    return np.array([found.get(k, 0.0) for k in range(n)])


def test_product_of_vectors_as_operator(spark):
    rng = np.random.default_rng(3)
    x, y, p, q = rng.normal(size=4), rng.normal(size=6), rng.normal(size=6), rng.normal(size=4)
    a = linop.Rank1(vec(spark, x), vec(spark, y), 4, 6, 0.5)
    assert np.allclose(values(a.apply(vec(spark, p)), 4), 0.5 * np.outer(x, y) @ p)
    assert np.allclose(values(a.apply(vec(spark, q), coo.TRANSPOSED), 6), 0.5 * np.outer(x, y).T @ q)


@pytest.mark.parametrize("weighed", [False, True])
def test_column_relaxation_with_products(spark, weighed):
    """Sparse entries, one column without any, and two products, of which one is transposed: step by step as on the full matrix."""
    rng = np.random.default_rng(4)
    n, m = 6, np.zeros((6, 6))
    for k in range(5):
        m[k, k], m[(k + 2) % 6, k] = 3 + k, 0.5
    u, v, p, q = rng.normal(size=(4, n))
    u[1] = v[2] = p[0] = 0.0
    full = m + 0.5 * np.outer(u, v) - 2 * np.outer(q, p)
    w, b = np.diag(1.0 + np.arange(n)), rng.normal(size=n)
    entries = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "i long, j long, v double").coalesce(1)
    a = linop.matrix_sum((1.0, coo.NORMAL, linop.Matrix(entries, n, n)), (0.5, coo.NORMAL, linop.Rank1(vec(spark, u), vec(spark, v), n, n)), (1.0, coo.TRANSPOSED, linop.Rank1(vec(spark, p), vec(spark, q), n, n, -2.0)))
    weight = linop.diagonal(vec(spark, np.diag(w)), n) if weighed else None
    x, info = solve.kaczmarz(a, vec(spark, b), weight, solve.Stop(2, 1e-12), x0=vec(spark, np.zeros(n)))
    wa, wb, expected = (w @ full, w @ b, np.zeros(n)) if weighed else (full, b, np.zeros(n))
    for _ in range(info.steps):
        for j in range(n):
            expected[j] -= wa[:, j] @ (wa @ expected - wb) / (wa[:, j] @ wa[:, j])
    assert info.steps == 2 and np.allclose(values(x, n), expected)


def test_solver_queries_never_form_the_product(spark, tmp_path):
    """300 suppliers have 90,000 pairs; the system keeps one entry a supplier."""
    pd.DataFrame({"s_suppkey": np.arange(300), "s_nationkey": (np.arange(300) % 25).astype(np.int32), "s_acctbal": np.linspace(-999, 9999, 300)}).to_parquet(tmp_path / "supplier.parquet")
    a, _, _ = queries.rank1_system(spark, str(tmp_path))
    kept = [t.entries.count() for _, _, t in a.terms if isinstance(t, linop.Matrix)]
    assert kept == [300] and a.is_self_adjoint()
