"""Trees, graphs, blocks, operators and solvers against numpy and by their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import geometry as g
from tesserae.functions import kernels
from tesserae.operators import block_cluster as bc
from tesserae.operators import blocks, cluster, coo, graph, solve, vector
from tesserae.plans import linop

RNG = np.random.default_rng(5)


def to_coo(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "i long, j long, v double")


def to_vec(spark, x):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i long, v double").coalesce(1)


def dense(df, n, m=None):
    if m is None:
        out = np.zeros(n)
        for r in df.collect():
            out[r.i] = r.v
        return out
    out = np.zeros((n, m))
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([(12 * a + b, [float(a), float(b)]) for a in range(12) for b in range(12)], "dof long, x array<double>").coalesce(1)


@pytest.mark.parametrize("split", [cluster.geometric(False), cluster.cardinality(), cluster.principal(), cluster.principal(True), cluster.automatic()])
def test_cluster_trees(spark, grid, split):
    tree, perm = cluster.build(grid, split, leaf_size=40)
    leaves = tree.where("is_leaf").collect()
    assert sum(r.last - r.first + 1 for r in leaves) == 144 and all(r.last - r.first < 40 for r in leaves)
    assert sorted(r.i for r in perm.collect()) == list(range(144)) == sorted(r.e for r in perm.collect())
    at = sorted((r.first, r.last) for r in leaves)
    assert at[0][0] == 0 and all(b[0] == a[1] + 1 for a, b in zip(at[:-1], at[1:], strict=True))


def test_nested_dissection_and_curves(spark, grid):
    near = grid.alias("a").join(grid.alias("b"), F.col("a.dof") != F.col("b.dof")).where(g.point_distance(F.col("a.x"), F.col("b.x")) < 1.1).select(F.col("a.dof").alias("src"), F.col("b.dof").alias("dst"), F.lit(1.0).alias("w"))
    tree, perm = cluster.build(grid, cluster.cardinality(), leaf_size=40, interface=near)
    place = {r.e: r.i for r in perm.collect()}
    top = {r.cid: (r.first, r.last) for r in tree.where("lvl = 1").collect()}
    inside = lambda d, c: c in top and top[c][0] <= place[d] <= top[c][1]
    assert not any(inside(r.src, 1) and inside(r.dst, 2) for r in near.collect())
    tree, perm = cluster.build(grid, cluster.least_cut(near), leaf_size=40)
    assert perm.count() == 144
    tree, perm = cluster.space_filling(grid, leaf_size=20)
    assert tree.where("is_leaf and bbmin is null").count() == 0 and perm.count() == 144
    assert sorted(cluster.hilbert_index(np.array([[a, b] for a in range(8) for b in range(8)]), 3)) == list(range(64))
    assert cluster.block_low_rank(grid, [F.get("x", F.lit(0))], 12).count() == 144
    assert cluster.flattened(tree).where("is_leaf").count() == tree.where("is_leaf").count()


def test_block_cluster_tree_tiles_everything(spark):
    points = spark.createDataFrame([(6 * a + b, [float(a), float(b)]) for a in range(6) for b in range(6)], "dof long, x array<double>").coalesce(1)
    tree, perm = cluster.build(points, leaf_size=10)
    tree = tree.coalesce(1).persist()
    found = {}
    for name, test, same in (("strong", bc.strong(1.0), True), ("weak", bc.weak(), False)):
        found[name] = bc.build(tree, tree, test, same_level=same)
        cover = np.zeros((36, 36), int)
        for r in bc.to_blocks(found[name], tree, tree).collect():
            cover[r.row_first : r.row_last + 1, r.col_first : r.col_last + 1] += 1
        assert (cover == 1).all()
    assert bc.sparsity_constant(found["strong"]).first().c_sp >= 1
    assert bc.statistics(found["weak"]).first().admissible > 0
    edges = spark.createDataFrame([(k + 1, k) for k in range(35)], "src long, dst long").coalesce(1)
    pairs = found["weak"].where("lvl = 1").select("row_cid", "col_cid")
    assert bc.graph_admissible(pairs, tree, edges, perm).where("adm and row_cid = col_cid").count() == 0
    one = tree.where("cid = 1").select(*[F.col(c).alias(f"r_{c}") for c in ("cid", "bbmin", "bbmax", "is_domain")]).crossJoin(tree.where("cid = 2").select(*[F.col(c).alias(f"c_{c}") for c in ("cid", "bbmin", "bbmax", "is_domain")]))
    assert one.select(bc.off_diagonal().alias("o"), bc.high_low_frequency(1.0, 0.1)().alias("h")).first() == (True, False)


def test_ranks_in_pieces(spark):
    from tesserae.operators.iterate import ranks

    x = spark.range(300).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    whole = {tuple(r) for r in ranks(x, ["g"], ["v"]).select("g", "v", "rank").collect()}
    assert {tuple(r) for r in ranks(x, ["g"], ["v"], limit=40).select("g", "v", "rank").collect()} == whole
    assert sorted(r["rank"] for r in ranks(x, [], ["v"], limit=70).collect()) == list(range(1, 301))


def test_boxes(spark):
    row = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("a"), F.array(F.lit(1.0), F.lit(2.0)).alias("b"), F.array(F.lit(4.0), F.lit(6.0)).alias("c"), F.array(F.lit(5.0), F.lit(7.0)).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    r = row.select(g.distance(a, b, c, d).alias("dist"), g.periodic_distance(a, b, c, d, [5.0, 7.0]).alias("per"), g.diameter(a, b).alias("diam"), g.volume(a, b).alias("vol"), g.overlap_dim(a, b, a, b).alias("o"), g.is_inside(a, b, F.array(F.lit(1.0), F.lit(2.0))).alias("in"), g.cross(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).alias("x"), g.sphere_distance(a, F.lit(1.0), c, F.lit(1.0)).alias("s")).first()
    assert (r.dist, r.per, r.vol, r.o, r["in"], r.x) == (5.0, 0.0, 2.0, 2, True, [0.0, 0.0, 1.0])
    assert np.isclose(r.diam, 5**0.5) and np.isclose(r.s, 52**0.5 - 2)


def test_graphs(spark):
    e = graph.from_matrix(spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (6, 6)], "i long, j long"))
    assert {(r.node, r.component) for r in graph.connected_components(e).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)}
    path = graph.from_matrix(spark.createDataFrame([(k, k + 1) for k in range(9)], "i long, j long")).coalesce(1)
    assert graph.connected_components(path).agg(F.max("component")).first()[0] == 0
    assert graph.diameter(path, 4)[0] == 9
    halves = graph.bisect_by_levels(path, graph.nodes(path))
    assert graph.edge_cut(path, halves).first().cut == 1
    assert graph.edge_cut(path, graph.bisect_spectral(path, graph.nodes(path), 10)).first().cut <= 3
    sep = {r.node for r in graph.vertex_separator(path, halves).collect()}
    assert len(sep) == 1
    assert graph.partition_components(e, graph.nodes(e)).groupBy("side").count().count() == 2 and graph.partition_components(path, graph.nodes(path)) is None
    tree, perm = graph.algebraic_tree(path, graph.nodes(path), 4, dissect=True)
    assert tree.where("is_leaf").agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] == 10
    assert sorted(np.bincount(graph.pack_in_bins([5, 4, 3, 3, 3]), [5, 4, 3, 3, 3])) == [9, 9]
    w = graph.weighted(spark.createDataFrame([(0, 1, 2.0), (1, 0, -8.0), (1, 2, 4.0)], "i long, j long, v double"), levels=4)
    assert {(r.src, r.dst): r.w for r in w.collect()}[(0, 1)] == 4.0
    left, right = (spark.createDataFrame([(k,) for k in s], "node long") for s in ((0, 1), (7, 8)))
    assert bc.graph_distance_admissible(path, left, right) and not bc.graph_distance_admissible(path, left, spark.createDataFrame([(1,), (2,)], "node long"), 0.5)
    assert graph.high_degree(e, 0.5).count() == 6 and graph.min_edge_weight(e).first().w == 1.0


def test_block_matrices(spark):
    d, a, b = RNG.standard_normal((2, 2)), RNG.standard_normal((2, 1)), RNG.standard_normal((2, 1))
    s = RNG.standard_normal((2, 2))
    s = s + s.T
    rows = [(1, 0, 0, 0, 1, 0, 1, 0, 1, "dense", "symmetric", None, s.ravel("F").tolist(), None, None), (2, 0, 1, 0, 1, 2, 3, 0, 1, "rk", "symmetric", 1, None, a.ravel("F").tolist(), b.ravel("F").tolist()), (3, 0, 1, 1, 1, 2, 3, 2, 3, "dense", "symmetric", None, (d + d.T).ravel("F").tolist(), None, None)]
    from tesserae.schemas import BLOCKS

    t = spark.createDataFrame(rows, BLOCKS)
    m = np.block([[s, (a @ b.T).T], [a @ b.T, d + d.T]])
    assert np.allclose(dense(blocks.to_coo(blocks.mirrored(t)), 4, 4), m)
    x = RNG.standard_normal(4)
    assert np.allclose(dense(blocks.mul_vec(t, to_vec(spark, x)), 4), m @ x)
    assert np.allclose(dense(blocks.mul_vec(t, to_vec(spark, x), 2.0, 1.0, to_vec(spark, x), transpose=True), 4), 2 * m.T @ x + x)
    assert np.isclose(blocks.entry(t, 0, 3).first().v, m[0, 3]) and np.allclose(dense(blocks.diagonal(t), 4), np.diag(m))
    st = blocks.statistics(t).first()
    assert (st.nblocks, st.lowrank, st.dense) == (3, 1, 2) and blocks.byte_size(t).first().bytes == 8 * (4 + 4 + 4)
    p = blocks.pattern(t).first()
    assert p.is_lower_left and not p.is_diag
    assert np.allclose(dense(blocks.to_coo(blocks.mirrored(blocks.scale(2.0, t))), 4, 4), 2 * m)
    added = blocks.add_block(t.where("kind = 'dense'"), 3.0, to_coo(spark, np.ones((4, 4))))
    assert np.allclose(dense(added, 4, 4)[:2, :2], s + 3)


def test_sparse_formats_and_checks(spark):
    m = (RNG.random((6, 6)) < 0.5) * RNG.standard_normal((6, 6))
    a = to_coo(spark, m)
    one = coo.export_ccs(a, 6)
    assert np.allclose(dense(coo.import_ccs(one), 6, 6), m)
    with pytest.raises(KeyError):
        coo.set_entry(a, 0, 99, 1.0)
    assert coo.check(a, 6, 6).first().asDict() == {"out_of_range": 0, "undefined": 0, "zeros": 0, "repeated": 0}
    assert np.isclose(coo.spectral_norm(a, 200), np.linalg.norm(m, 2), rtol=1e-4)
    assert all(coo.compose(p, q) == coo.compose(q, p) for p in "NTCJ" for q in "NTCJ") and coo.compose("T", "C") == "J"
    x, y = RNG.standard_normal(6), RNG.standard_normal(6)
    assert np.allclose(dense(coo.add_rank1(a, 2.0, to_vec(spark, x), to_vec(spark, y)), 6, 6), m + 2 * np.outer(x, y))
    z = spark.createDataFrame([(0, 1.0, 1.0)], "i long, re double, im double")
    w = spark.createDataFrame([(0, 2.0, -1.0)], "i long, re double, im double")
    assert tuple(vector.dot(z, w).first()) == (1.0, -3.0) and tuple(vector.dotu(z, w).first()) == (3.0, 1.0)
    tree = spark.createDataFrame([(1, 0, 2, True), (2, 3, 5, True)], "cid long, first long, last long, is_leaf boolean")
    assert sorted((r.blk, r.i) for r in vector.to_blocked(to_vec(spark, x), tree).collect()) == [(1, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5)]


def test_operators(spark):
    m, n = RNG.standard_normal((4, 5)), RNG.standard_normal((5, 4))
    a, b = linop.Matrix(to_coo(spark, m), 4, 5), linop.Matrix(to_coo(spark, n), 5, 4)
    x, y = RNG.standard_normal(4), RNG.standard_normal(5)
    p = linop.matrix_product((2.0, "N", a), (3.0, "N", b))
    assert np.allclose(dense(p.apply(to_vec(spark, x)), 4), 6 * m @ n @ x) and np.allclose(dense(p.apply(to_vec(spark, x), "T"), 4), 6 * (m @ n).T @ x)
    s = linop.matrix_sum((1.0, "N", a), (-1.0, "T", b))
    assert np.allclose(dense(s.apply(to_vec(spark, y)), 4), (m - n.T) @ y)
    assert np.allclose(dense(linop.matrix_product((1.0, "N", a)).apply(to_vec(spark, y)), 4), m @ y)
    with pytest.raises(ValueError):
        linop.matrix_product((1.0, "N", a), (1.0, "N", a))
    perm = spark.createDataFrame([(0, 3), (1, 2), (2, 1), (3, 0)], "e long, i long")
    q = linop.Matrix(to_coo(spark, np.diag([1.0, 2, 3, 4])), 4, 4, True)
    assert np.allclose(dense(linop.Permuted(q, perm, perm).apply(to_vec(spark, x)), 4), [4, 3, 2, 1] * x)


@pytest.mark.parametrize("name", ["cg", "cgs", "bicgstab", "minres", "gmres", "tfqmr", "linear"])
def test_solvers(spark, name):
    n = 4
    m = 4 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    b = RNG.standard_normal(n)
    a = linop.Matrix(to_coo(spark, m), n, n, True)
    w = solve.jacobi(to_vec(spark, np.diag(m)), n) if name == "linear" else None
    x, info = solve.SOLVERS[name](a, to_vec(spark, b), w, solve.Stop(14, 1e-6 if name != "linear" else 1e-2))
    assert info.status == "converged", str(info)
    assert np.linalg.norm(m @ dense(x, n) - b) <= (1e-4 if name != "linear" else 0.1) * np.linalg.norm(b)


def test_kernels():
    d = np.array([0.0, 0.3, 1.0, 4.0])
    assert np.allclose(kernels.matern_general(d, 0.5), np.exp(-d), atol=1e-7)
    r = np.sqrt(3) * d
    assert np.allclose(kernels.matern_general(d, 1.5, 2.0), 4 * (1 + r / np.sqrt(3) * 1) * np.exp(-r / np.sqrt(3)), atol=1e-6)
