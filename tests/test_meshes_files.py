"""Boundary elements against analytic values, and file formats by hand-written files and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import complexnum as cx
from tesserae.functions import quadrature as q
from tesserae.operators import bem, coo
from tesserae.sources import grids, matrices


def test_quadrature_rules():
    x, w = q.gauss(5)
    assert all(np.isclose((w * x**k).sum(), 1 / (k + 1)) for k in range(10))
    p, w = q.triangle(4)
    assert np.isclose(w.sum(), 0.5) and np.isclose((w * p[:, 0] ** 2 * p[:, 1]).sum(), 2 / math.factorial(5))
    for common in range(4):
        a, b, w = q.triangle_pair(common, 4)
        assert np.isclose(w.sum(), 0.25) and np.isclose((w * a[:, 0] * b[:, 1]).sum(), 1 / 36) and (a.min() >= -1e-12) and (a.sum(1).max() <= 1 + 1e-12)
    assert [q.adjusted_order(4, d, 1.0) for d in (0.0, 4.0, 6.0, 30.0)] == [4, 4, 3, 2]


def test_singular_rules_converge():
    corners = {3: np.array([[[0, 0], [1, 0], [0, 1]]] * 2, float), 2: np.array([[[0, 0], [1, 0], [0, 1]], [[0, 0], [1, 0], [0, -1]]], float), 1: np.array([[[0, 0], [1, 0], [0, 1]], [[0, 0], [-1, 0], [0, -1]]], float)}
    for common, (t0, t1) in corners.items():
        at = lambda t, p: t[0] + p[:, :1] * (t[1] - t[0]) + p[:, 1:] * (t[2] - t[0])
        values = []
        for order in (4, 6, 8):
            a, b, w = q.triangle_pair(common, order)
            values.append((w / np.linalg.norm(at(t0, a) - at(t1, b), axis=1)).sum())
        assert abs(values[1] - values[2]) < 1e-3 * values[2] and abs(values[1] - values[2]) <= abs(values[0] - values[2]) + 1e-9


@pytest.fixture(scope="module")
def sphere(spark):
    v, t = bem.make_grid(spark, "sphere-1")
    return v.coalesce(1).persist(), t.coalesce(1).persist()


def test_meshes_and_spaces(spark, sphere):
    v, t = sphere
    assert (v.count(), t.count()) == (18, 32)
    area = bem.with_geometry(v, t).agg(F.sum("jac") / 2, F.min(F.col("nx") * F.col("x0") + F.col("ny") * F.col("y0") + F.col("nz") * F.col("z0"))).first()
    assert 8 < area[0] < 4 * math.pi and area[1] > 0
    for name, size in (("square-1", 1.0), ("cube", 6.0)):
        assert np.isclose(bem.with_geometry(*bem.make_grid(spark, name)).agg(F.sum("jac") / 2).first()[0], size)
    const, linear = bem.constant_space(t), bem.linear_space(t)
    mass = {(r.i, r.j): r.v for r in bem.mass(v, t, const, const).collect()}
    jac = {r.tid: r.jac for r in bem.with_geometry(v, t).collect()}
    assert all(np.isclose(mass[k, k], jac[k] / 2) for k in jac) and len(mass) == 32
    assert np.isclose(bem.mass(v, t, linear, linear).agg(F.sum("v")).first()[0], area[0])
    one = bem.right_hand_side(v, t, linear, lambda x, y, z, a, b, c: F.lit(1.0))
    assert np.isclose(one.agg(F.sum("v")).first()[0], area[0])
    points = bem.coordinates(v, t, linear).orderBy("dof").collect()
    assert np.allclose([r.x for r in points], np.array([list(r)[1:] for r in v.orderBy("vid").collect()]))
    assert bem.edge_space(v, t).select("dof").distinct().count() == 48
    moved = bem.rotate(bem.scale(bem.translate(v, (1, 0, 0)), (2, 2, 2)), (0, 0, 1), math.pi / 2)
    assert np.isclose(bem.with_geometry(moved, bem.switch_orientation(t)).agg(F.sum("jac") / 2).first()[0], 4 * area[0])
    n = bem.vertex_normals(v, t).agg(F.max(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)).first()[0]
    assert np.isclose(n, 1)


def test_forms(spark, sphere):
    v, t = sphere
    s = bem.constant_space(t)
    single = bem.form(v, t, s, s, bem.laplace_single, 3)
    m = np.zeros((32, 32))
    for r in single.collect():
        m[r.i, r.j] = r.v
    assert np.allclose(m, m.T, rtol=1e-3) and (m > 0).all() and np.linalg.eigvalsh(m).min() > 0
    area = bem.with_geometry(v, t).agg(F.sum("jac") / 2).first()[0]
    # the single layer of a constant on the unit sphere is 1; the mesh is inside of it
    assert 0.8 * area < m.sum() < 1.1 * area
    double = bem.form(v, t, s, s, bem.laplace_double, 3).agg(F.sum("v")).first()[0]
    assert abs(abs(double) - area / 2) < 0.15 * area  # solid angles: -1/2 or 1/2 of the area by orientation
    k0 = bem.form(v, t, s, s, bem.helmholtz_single(0.0), 3).agg(F.sum("re"), F.sum("im")).first()
    assert np.isclose(k0[0], m.sum()) and np.isclose(k0[1], 0)


def test_vector_forms(spark):
    v, t = bem.mesh(spark, *bem.octahedron())
    e = bem.edge_space(v, t)
    mass = np.zeros((12, 12))
    for r in bem.maxwell_mass(v, t, e, e).collect():
        mass[r.i, r.j] = r.v
    assert np.allclose(mass, mass.T) and np.linalg.eigvalsh(mass).min() > 0
    one = e.where("dof < 3")
    found = np.zeros((3, 3), complex)
    for r in bem.maxwell_form(v, t, one, one, 1.0, 1.0, order=3).collect():
        found[r.i, r.j] = r.re + 1j * r.im
    assert np.allclose(found, found.T, rtol=1e-3, atol=1e-6)
    f = bem.maxwell_rhs(v, t, e, lambda x, y, z: (cx.real(F.lit(1.0)), cx.real(F.lit(0.0)), cx.real(F.lit(0.0))))
    assert f.count() == 12


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return f"file://{p}"


def values(a):
    return {(r.i, r.j): r.v for r in a.collect()}


def test_matrix_files(spark, tmp_path):
    m = put(tmp_path, "a.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% note\n3 3 3\n1 1 2.0\n2 1 -1.5D0\n3 3 4\n")
    assert values(matrices.read_matrix(spark, m)) == {(0, 0): 2.0, (1, 0): -1.5, (0, 1): -1.5, (2, 2): 4.0}
    m = put(tmp_path, "b.mtx", "%%MatrixMarket matrix coordinate complex hermitian\n2 2 1\n2 1 1 2\n")
    assert {(r.i, r.j, r.re, r.im) for r in matrices.read_matrix(spark, m).collect()} == {(1, 0, 1.0, 2.0), (0, 1, 1.0, -2.0)}
    m = put(tmp_path, "c.mtx", "%%MatrixMarket matrix coordinate pattern skew-symmetric\n2 2 1\n2 1\n")
    assert values(matrices.read_matrix(spark, m)) == {(1, 0): 1.0, (0, 1): -1.0}
    x = put(tmp_path, "x.mtx", "%%MatrixMarket matrix array real general\n3 1\n1\n2\n3\n")
    assert sorted((r.i, r.v) for r in matrices.read_vector(spark, x).collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]
    y = put(tmp_path, "y.mtx", "%%MatrixMarket matrix array real general\n2 3\n1\n2\n3\n4\n5\n6\n")
    assert {r.dof: r.x for r in matrices.read_market_coordinates(spark, y).collect()} == {0: [1, 3, 5], 1: [2, 4, 6]}
    put(tmp_path, "s.frm", "f 4\n3 2 11\n")
    s = put(tmp_path, "s.amg", "1\n3\n4\n1\n2\n2\n5.0\n6.0\n7.0\n")
    assert values(matrices.read_matrix(spark, s)) == {(0, 0): 5.0, (0, 1): 6.0, (1, 1): 7.0}
    put(tmp_path, "s.rhs", "1.5\n2.5\n")
    assert sorted((r.i, r.v) for r in matrices.read_vector(spark, s.replace(".amg", ".rhs")).collect()) == [(0, 1.5), (1, 2.5)]
    hb = "title".ljust(72) + "key\n" + "".join(f"{n:14d}" for n in (3, 1, 1, 1, 0)) + "\nRUA           " + "".join(f"{n:14d}" for n in (2, 2, 3, 0)) + "\n(8I5)           (8I5)           (4E12.4)            \n    1    3    4\n    1    2    2\n  1.0000E+00  2.0000D+00  3.0000E+00\n"
    assert values(matrices.read_matrix(spark, put(tmp_path, "h.rua", hb))) == {(0, 0): 1.0, (1, 0): 2.0, (1, 1): 3.0}
    p = put(tmp_path, "p.txt", "2\nx\ny\n0\n0\n1 1 4.0\n2 1 5.0\n")
    assert values(matrices.read_pltmg_matrix(spark, p)) == {(0, 0): 4.0, (1, 0): 5.0}
    d = np.arange(6.0).reshape(2, 3)
    (tmp_path / "m.mat").write_bytes(matrices.matlab_bytes({"A": d}))
    got = values(matrices.read_matrix(spark, f"file://{tmp_path}/m.mat"))
    assert all(got[i, j] == d[i, j] for i in range(2) for j in range(3))
    a = matrices.read_matrix(spark, s)
    matrices.write_market_matrix(a, 2, 2, f"file://{tmp_path}/out")
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    assert values(matrices.read_matrix(spark, put(tmp_path, "again.mtx", text))) == values(a)
    matrices.write_octave(a, 2, 2, f"file://{tmp_path}/oct")
    assert "5.0 6.0" in "".join(f.read_text() for f in sorted((tmp_path / "oct").glob("part-*")))
    with pytest.raises(ValueError):
        matrices.read_matrix(spark, put(tmp_path, "z.unknown", "x"))


def test_grid_files(spark, tmp_path):
    v, t = bem.mesh(spark, *bem.unit_square())
    expected = (sorted(map(tuple, v.collect())), sorted(tuple(r)[1:] for r in t.collect()))
    for name, write in (("ply", grids.write_ply), ("tri", grids.write_tri), ("msh", grids.write_gmsh)):
        write(v, t, f"file://{tmp_path}/{name}")
        text = "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))
        w, u = grids.read_grid(spark, put(tmp_path, f"g.{name}", text))
        assert (sorted(map(tuple, w.collect())), sorted(tuple(r)[1:] for r in u.collect())) == expected
    s = put(tmp_path, "g.sur", "surfacemesh\n4\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n2\n1 2 3\n1 3 4\n")
    w, u = grids.read_grid(spark, s)
    assert (sorted(map(tuple, w.collect())), sorted(tuple(r)[1:] for r in u.collect())) == expected
    grids.write_vtk(v, t, f"file://{tmp_path}/vtk")
    assert "POLYGONS 2 8" in "".join(f.read_text() for f in (tmp_path / "vtk").glob("part-*"))


def test_streaming(spark, tmp_path):
    from tesserae.streaming import updates

    path = f"file://{tmp_path}/in"
    spark.createDataFrame([(0, 0, 2.0), (1, 0, 3.0), (0, 0, 1.0)], "i long, j long, v double").write.parquet(path)
    x = spark.createDataFrame([(0, 10.0)], "i long, v double")
    stream = updates.running_product(spark.readStream.schema("i long, j long, v double").parquet(path), x)
    run = stream.writeStream.outputMode("complete").format("memory").queryName("product").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    run.awaitTermination(60)
    assert sorted(map(tuple, spark.table("product").collect())) == [(0, 30.0), (1, 30.0)]
    assert coo.mul_vec(spark.read.parquet(path), x).count() == 2
