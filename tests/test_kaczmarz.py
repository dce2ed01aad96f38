"""Column relaxation against numpy."""

import numpy as np

from tesserae.operators import solve
from tesserae.plans import linop


def test_column_relaxation(spark):
    rng = np.random.default_rng(2)
    m = np.eye(5) * 4 + rng.normal(size=(5, 5)) / 4
    b = rng.normal(size=5)
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(5) for j in range(5)], "i long, j long, v double").coalesce(1)
    x, info = solve.kaczmarz(linop.Matrix(a, 5, 5), spark.createDataFrame([(k, float(v)) for k, v in enumerate(b)], "i long, v double").coalesce(1), stop=solve.Stop(25, 1e-8))
    assert info.status == "converged"
    found = {r.i: r.v for r in x.collect()}
    assert np.allclose([found[k] for k in range(5)], np.linalg.solve(m, b), atol=1e-6)
