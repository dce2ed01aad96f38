import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.operators import dense, lowrank

RNG = np.random.default_rng(3)
M = RNG.standard_normal((7, 5))
S = RNG.standard_normal((6, 6)) + 6 * np.eye(6)
H = S @ S.T


def test_factorisations():
    f = dense.lu(S)
    assert np.allclose((np.tril(f, -1) + np.eye(6)) @ np.triu(f), S)
    low = dense.cholesky(H)
    assert np.allclose(low @ low.T, H)
    unit, d = dense.ldl(H)
    assert np.allclose(unit * d @ unit.T, H)
    c = H + 1j * (S + S.T) * 0.1
    unit, d = dense.ldl(c, hermitian=False)
    assert np.allclose(unit * d @ unit.T, c)
    low = dense.cholesky(c, hermitian=False)
    assert np.allclose(low @ low.T, c)
    q, r, order = dense.qr_pivoted(M)
    assert np.allclose(q @ r, M[:, order]) and np.allclose(q.T @ q, np.eye(5))
    q, r = dense.tsqr_local(RNG.standard_normal((400, 4)), rows=32)
    assert np.allclose(q.T @ q, np.eye(4)) and np.allclose(r, np.triu(r))
    low, q = dense.lq(M)
    assert np.allclose(low @ q, M)
    with pytest.raises(ZeroDivisionError):
        dense.lu(np.zeros((2, 2)))


def test_solves_and_inverses():
    b = RNG.standard_normal((6, 2))
    t = np.tril(S)
    assert np.allclose(t @ dense.solve_triangular(t, b), b)
    assert np.allclose(dense.solve_triangular(t, b.T, side="right") @ t, b.T)
    assert np.allclose(dense.invert_triangular(t) @ t, np.eye(6))
    assert np.allclose(dense.pseudo_inverse(M), np.linalg.pinv(M))
    assert dense.condition(np.diag([4.0, 2.0, 0.0])) == 2 and dense.condition(np.zeros((2, 2))) == 0
    w, v = dense.eigen_hermitian(H, 1, 3)
    assert len(w) == 3 and np.allclose(H @ v, v * w)
    w, v = dense.eigen_tridiagonal(np.full(4, 2.0), np.full(3, -1.0))
    assert np.allclose(w, 2 - 2 * np.cos(np.arange(1, 5) * np.pi / 5))


def test_truncation_rule():
    sigma = np.array([1, 1e-3, 1e-9])
    assert [lowrank.fixed_precision(1e-4).cut(sigma), lowrank.fixed_precision(1e-2).cut(sigma), lowrank.fixed_rank(1).cut(sigma), lowrank.EXACT.cut(np.zeros(3))] == [2, 1, 1, 0]
    assert lowrank.Accuracy(relative=1e-2, norm="frobenius").cut(np.array([1, 0.009, 0.002])) == 1
    assert lowrank.Accuracy(most=2).cut(np.ones(5)) == 2


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 12), st.integers(2, 12), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from(["svd", "rrqr", "random"]))
def test_low_rank_error(n, m, k, seed, method):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, k)) @ rng.standard_normal((k, m))
    a, b = lowrank.APPROX[method](x, lowrank.fixed_precision(1e-8))
    assert a.shape[1] <= min(n, m, k) + 2 and np.linalg.norm(x - a @ b.T) <= 1e-5 * (1 + np.linalg.norm(x))
    a, b = lowrank.add_rank(a, b, -1.0, a, b, lowrank.absolute_precision(1e-6), method)
    assert np.linalg.norm(a @ b.T) < 1e-4


def test_low_rank_algebra():
    a, b = RNG.standard_normal((8, 3)), RNG.standard_normal((6, 3))
    m = a @ b.T
    assert np.isclose(lowrank.frobenius(a, b), np.linalg.norm(m)) and np.allclose(lowrank.singular_values(a, b)[:3], np.linalg.svd(m, compute_uv=False)[:3])
    assert np.isclose(lowrank.frobenius(np.array([[1.0], [2], [3]]), np.array([[4.0], [5]])), np.sqrt(14 * 41))
    x, y = lowrank.from_dense(m)
    assert np.allclose(x @ y.T, m)
    x, y = lowrank.add_dense(a, b, 2.0, m, lowrank.fixed_precision(1e-10))
    assert x.shape[1] == 3 and np.allclose(x @ y.T, 3 * m)


def test_blocks_in_tables(spark):
    mats = [RNG.standard_normal((4, 4)) + 4 * np.eye(4) for _ in range(5)]
    blocks = spark.createDataFrame([(k, 4, 4, dense.pack(m)) for k, m in enumerate(mats)], "id long, nrows long, ncols long, d array<double>")
    for r in dense.inverted(blocks, ["id"]).collect():
        assert np.allclose(dense.unpack(r.d, 4, 4) @ mats[r.id], np.eye(4))
    for r in dense.singular_values(blocks, ["id"]).collect():
        assert np.allclose(r.sigma, np.linalg.svd(mats[r.id], compute_uv=False))
    for r in lowrank.compress_blocks(blocks, lowrank.fixed_rank(2), ["id"]).collect():
        assert r["rank"] == 2 and np.isclose(r.error, np.sqrt((np.linalg.svd(mats[r.id], compute_uv=False)[2:] ** 2).sum()))


def test_tall_matrices(spark):
    x = RNG.standard_normal((300, 6))
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k long, r array<double>").repartition(20)
    assert np.allclose(dense.tall_singular_values(rows, "r"), np.linalg.svd(x, compute_uv=False))
    q = np.array([r.q for r in dense.tall_orthogonal(rows, "k", "r").collect()])
    assert np.allclose(q.T @ q, np.eye(6))
    g = {(r.i, r.j): r.v for r in dense.gram(rows, "r").collect()}
    assert np.allclose([[g[i, j] for j in range(6)] for i in range(6)], x.T @ x)
