"""Complex coordinate matrices, block products and files of several parts, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import blocks, coo, vector
from tesserae.sources import matrices

RNG = np.random.default_rng(11)
A = RNG.normal(size=(6, 5)) + 1j * RNG.normal(size=(6, 5))
B = RNG.normal(size=(5, 6)) + 1j * RNG.normal(size=(5, 6))
X, Y = RNG.normal(size=5) + 1j * RNG.normal(size=5), RNG.normal(size=6) + 1j * RNG.normal(size=6)


def matrix(spark, m):
    rows = [(int(i), int(j), float(v.real), float(v.imag)) for (i, j), v in np.ndenumerate(m)]
    df = spark.createDataFrame(rows, "i long, j long, re double, im double")
    return df if np.iscomplexobj(m) else df.select("i", "j", F.col("re").alias("v"))


def vec(spark, x):
    df = spark.createDataFrame([(k, float(v.real), float(v.imag)) for k, v in enumerate(x)], "i long, re double, im double")
    return df if np.iscomplexobj(x) else df.select("i", F.col("re").alias("v"))


def array(df, *shape):
    out = np.zeros(shape, complex)
    for r in df.collect():
        out[(r.i, r.j) if len(shape) == 2 else r.i] = complex(r.re, r.im) if "im" in df.columns else r.v
    return out


@pytest.mark.parametrize("op, f", [("N", lambda m: m), ("T", lambda m: m.T), ("C", lambda m: m.conj().T), ("J", lambda m: m.conj())])
def test_complex_products_with_vectors(spark, op, f):
    m = f(A)
    x, y = (X, Y) if m.shape[1] == 5 else (Y, X)
    found = coo.mul_vec(matrix(spark, A), vec(spark, x), 2 - 1j, 0.5j, vec(spark, y), op)
    assert np.allclose(array(found, m.shape[0]), (2 - 1j) * m @ x + 0.5j * y)


def test_a_small_case_keeps_beta_y(spark):
    one = lambda v: spark.createDataFrame([(0, v, 0.0)], "i long, re double, im double")
    a = spark.createDataFrame([(0, 0, 1.0, 0.0)], "i long, j long, re double, im double")
    assert coo.mul_vec(a, one(1.0), 1.0, 2.0, one(5.0)).collect() == [(0, 11.0, 0.0)]


@pytest.mark.parametrize("a, b", [(A, B), (A.real, B), (A, B.real), (A.real, B.real)])
def test_complex_and_mixed_matrices(spark, a, b):
    x, y = matrix(spark, a), matrix(spark, b)
    assert np.allclose(array(coo.matmul(x, y, 0.5 + 2j), 6, 6), (0.5 + 2j) * a @ b)
    assert np.allclose(array(coo.add(1j, coo.apply_op(y, "C"), x), 6, 5), a + 1j * b.conj().T)
    assert np.allclose(array(coo.hadamard(x, coo.transpose(y)), 6, 5), a * b.T)
    assert np.allclose(array(coo.add_rank1(x, 2j, vec(spark, Y), vec(spark, X)), 6, 5), a + 2j * np.outer(Y, X.conj()))
    assert np.allclose(array(coo.scale_columns(x, vec(spark, X)), 6, 5), a * X)
    assert np.allclose(array(coo.real_part(x), 6, 5) + 1j * array(coo.imaginary_part(x), 6, 5), a)
    assert np.isclose(coo.norm_frobenius(coo.scale(3j, x)).first().v, 3 * np.linalg.norm(a))
    assert np.allclose(array(vector.add(1 - 1j, vec(spark, X), vec(spark, X.real)), 5), X.real + (1 - 1j) * X)


@pytest.mark.parametrize("side, shape", [("left", "lower"), ("right", "upper")])
def test_triangles(spark, side, shape):
    a, b = RNG.normal(size=(5, 5)), RNG.normal(size=(5, 5))
    t = np.tril(a) if shape == "lower" else np.triu(a)
    t = t - np.diag(np.diag(t)) + np.eye(5)
    found = coo.matmul_triangle(matrix(spark, a), matrix(spark, b), side, shape, True, 2.0)
    assert np.allclose(array(found, 5, 5), 2 * t @ b if side == "left" else 2 * b @ t)


def leaf(k, bi, bj, kind, d=None, a=None, b=None):
    pack = lambda m: None if m is None else [float(v) for v in m.T.ravel()]
    rank = None if a is None else a.shape[1]
    return (k, 0, bi, bj, 1, 3 * bi, 3 * bi + 2, 3 * bj, 3 * bj + 2, kind, "unsymmetric", rank, pack(d), pack(a), pack(b))


def tiled(spark, seed, low):
    """A 6 x 6 matrix of four leaves, those in `low` of rank 2."""
    from tesserae.schemas import BLOCKS

    rng, rows, whole = np.random.default_rng(seed), [], np.zeros((6, 6))
    for k, (bi, bj) in enumerate((p, q) for p in range(2) for q in range(2)):
        u, v, d = rng.normal(size=(3, 2)), rng.normal(size=(3, 2)), rng.normal(size=(3, 3))
        rows.append(leaf(k + 1, bi, bj, "rk", a=u, b=v) if k in low else leaf(k + 1, bi, bj, "dense", d))
        whole[3 * bi : 3 * bi + 3, 3 * bj : 3 * bj + 3] = u @ v.T if k in low else d
    return spark.createDataFrame(rows, BLOCKS), whole


def test_block_products_of_dense_and_low_rank_leaves(spark):
    (a, p), (b, q) = tiled(spark, 1, {1, 2}), tiled(spark, 2, {0, 2})
    assert np.allclose(array(blocks.matmul(a, b, -0.5), 6, 6), -0.5 * p @ q)
    row, column = np.zeros(6), np.zeros(6)
    for r in blocks.row(a, 4).collect():
        row[r.j] = r.v
    for r in blocks.column(a, 1).collect():
        column[r.i] = r.v
    assert np.allclose(row, p[4]) and np.allclose(column, p[:, 1])
    d, whole = tiled(spark, 3, set())
    turned = array(blocks.to_coo(blocks.permuted(d, [1, 2, 0], [2, 1, 0])), 6, 6)
    expected = np.zeros((6, 6))
    for i in range(6):
        for j in range(6):
            expected[i // 3 * 3 + [1, 2, 0][i % 3], j // 3 * 3 + [2, 1, 0][j % 3]] = whole[i, j]
    assert np.allclose(turned, expected)


def test_files_of_several_parts(spark, tmp_path):
    n = 500
    a = spark.range(n).select(((F.col("id") * 7) % n).alias("i"), F.col("id").alias("j"), (F.col("id") / 8).alias("v")).repartition(8)
    for write, read, name in ((matrices.write_market_matrix, matrices.read_market_matrix, "m.mtx"), (matrices.write_samg_matrix, matrices.read_samg_matrix, "m.amg"), (matrices.write_harwell_boeing, matrices.read_harwell_boeing, "m.hb")):
        path = str(tmp_path / name)
        write(a, n, n, path)
        found = {(r.i, r.j): r.v for r in read(spark, path).collect()}
        assert found == {((k * 7) % n, k): k / 8 for k in range(n)}
    x = spark.range(n).select(F.col("id").alias("i"), (F.col("id") / 4).alias("v")).repartition(8)
    matrices.write_market_vector(x, n, str(tmp_path / "v.mtx"))
    assert {r.i: r.v for r in matrices.read_market_vector(spark, str(tmp_path / "v.mtx")).collect()} == {k: k / 4 for k in range(n)}
    z = a.select("i", "j", F.col("v").alias("re"), (-F.col("v")).alias("im"))
    matrices.write_market_matrix(z, n, n, str(tmp_path / "z.mtx"))
    assert {(r.i, r.j): (r.re, r.im) for r in matrices.read_market_matrix(spark, str(tmp_path / "z.mtx")).collect()} == {((k * 7) % n, k): (k / 8, -k / 8) for k in range(n)}
