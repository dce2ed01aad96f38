"""Surface meshes, function spaces and boundary-element forms.

A mesh is vertices (vid, x, y, z) and triangles (tid, v0, v1, v2). A space is its support (dof, tid, local): the triangles
of each basis function. A form joins supports, triangles and a small quadrature table and sums by (i, j): no loop, and
basis values, kernels and weights are one column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import complexnum as cx
from ..functions import kernels as k
from ..functions import quadrature as q

Mesh = tuple[DataFrame, DataFrame]

# ---- meshes ----------------------------------------------------------------------------------------------------------


def mesh(spark: SparkSession, vertices: np.ndarray, triangles: np.ndarray) -> Mesh:
    v = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(vertices)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(n, *map(int, p)) for n, p in enumerate(triangles)], "tid long, v0 long, v1 long, v2 long")
    return v, t


def octahedron() -> tuple[np.ndarray, np.ndarray]:
    v = np.array([[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1]], float)
    t = np.array([(a, b, c) if s > 0 else (a, c, b) for a, sa in ((0, 1), (1, -1)) for b, sb in ((2, 1), (3, -1)) for c, sc in ((4, 1), (5, -1)) for s in (sa * sb * sc,)])
    return v, t


def unit_square() -> tuple[np.ndarray, np.ndarray]:
    return np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], float), np.array([[0, 1, 2], [0, 2, 3]])


def unit_cube() -> tuple[np.ndarray, np.ndarray]:
    v = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return v, np.array([t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))])


def refine(vertices: DataFrame, triangles: DataFrame, on_sphere: bool = False) -> Mesh:
    """Four triangles for one by edge midpoints, which move to the unit sphere if asked. Midpoint ids follow the edges'
    order, triangle ids are 4 * tid + 0..3 with the middle one last."""
    e = triangles.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))])).alias("e")).select("e.*").distinct()
    top = vertices.agg(F.max("vid")).first()[0] + 1
    from pyspark.sql import Window

    e = e.withColumn("mid", top + F.row_number().over(Window.orderBy("a", "b")) - 1)
    p = lambda s: vertices.select(F.col("vid").alias(s), *[F.col(c).alias(f"{c}{s}") for c in "xyz"])
    at = e.join(p("a"), "a").join(p("b"), "b")
    mids = [(F.col(f"{c}a") + F.col(f"{c}b")) / 2 for c in "xyz"]
    norm = F.sqrt(sum(m * m for m in mids)) if on_sphere else F.lit(1.0)
    new = at.select(F.col("mid").alias("vid"), *[(m / norm).alias(c) for m, c in zip(mids, "xyz", strict=True)])
    t = triangles
    for n, (a, b) in enumerate((("v0", "v1"), ("v1", "v2"), ("v2", "v0"))):
        key = e.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("mid").alias(f"m{n}"))
        t = t.join(key, (F.least(a, b) == F.col("_a")) & (F.greatest(a, b) == F.col("_b"))).drop("_a", "_b")
    four = [("v0", "m0", "m2"), ("m0", "v1", "m1"), ("m2", "m1", "v2"), ("m0", "m1", "m2")]
    t = t.select("tid", F.posexplode(F.array(*[F.struct(F.col(a).alias("v0"), F.col(b).alias("v1"), F.col(c).alias("v2")) for a, b, c in four])).alias("n", "t"))
    return vertices.unionByName(new), t.select((F.col("tid") * 4 + F.col("n")).alias("tid"), "t.*")


def make_grid(spark: SparkSession, name: str) -> Mesh:
    """'sphere', 'square' or 'cube' with a level: 'sphere-2' is refined twice."""
    base, _, level = name.partition("-")
    shapes = {"sphere": octahedron, "square": unit_square, "cube": unit_cube}
    if base not in shapes:
        raise ValueError(f"no grid named {base}")
    v, t = mesh(spark, *shapes[base]())
    for _ in range(int(level or 0)):
        v, t = refine(v, t, base == "sphere")
    return v, t


def translate(vertices: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return vertices.select("vid", *[(F.col(c) + float(d)).alias(c) for c, d in zip("xyz", by, strict=True)])


def scale(vertices: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return vertices.select("vid", *[(F.col(c) * float(d)).alias(c) for c, d in zip("xyz", by, strict=True)])


def rotate(vertices: DataFrame, axis: tuple[float, float, float], angle: float) -> DataFrame:
    """About an axis through the origin, by the axis-angle matrix."""
    u = np.asarray(axis, float) / np.linalg.norm(axis)
    cross = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    m = math.cos(angle) * np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * np.outer(u, u)
    return vertices.select("vid", *[sum((F.col(c) * float(m[r, n]) for n, c in enumerate("xyz")), F.lit(0.0)).alias(d) for r, d in enumerate("xyz")])


def switch_orientation(triangles: DataFrame) -> DataFrame:
    return triangles.select("tid", "v0", F.col("v2").alias("v1"), F.col("v1").alias("v2"))


def with_geometry(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with corners (x0..z2), jac (twice the area) and unit normal (nx, ny, nz)."""
    t = triangles
    for n in range(3):
        t = t.join(vertices.select(F.col("vid").alias(f"v{n}"), *[F.col(c).alias(f"{c}{n}") for c in "xyz"]), f"v{n}")
    d = lambda c, n: F.col(f"{c}{n}") - F.col(f"{c}0")
    n = [d("y", 1) * d("z", 2) - d("z", 1) * d("y", 2), d("z", 1) * d("x", 2) - d("x", 1) * d("z", 2), d("x", 1) * d("y", 2) - d("y", 1) * d("x", 2)]
    t = t.withColumn("jac", F.sqrt(sum(c * c for c in n)))
    return t.withColumns({f"n{c}": v / F.col("jac") for c, v in zip("xyz", n, strict=True)})


def vertex_normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(vid, nx, ny, nz): the normalised sum of the normals of a vertex's triangles."""
    g = with_geometry(vertices, triangles)
    s = g.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), "nx", "ny", "nz").groupBy("vid").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    norm = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    return s.select("vid", *[(F.col(f"n{c}") / norm).alias(f"n{c}") for c in "xyz"])


# ---- function spaces -------------------------------------------------------------------------------------------------


def constant_space(triangles: DataFrame) -> DataFrame:
    return triangles.select(F.col("tid").alias("dof"), "tid", F.lit(-1).alias("local"))


def linear_space(triangles: DataFrame) -> DataFrame:
    return triangles.select("tid", F.posexplode(F.array("v0", "v1", "v2")).alias("local", "dof")).select("dof", "tid", "local")


def edge_space(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """One function an inner edge, on its two triangles: (dof, tid, local, sign, length). `local` is the vertex opposite the
    edge; the sign is + in the triangle of the smaller id. dof numbers edges by their vertices."""
    from pyspark.sql import Window

    sides = [("v1", "v2", 0), ("v2", "v0", 1), ("v0", "v1", 2)]
    e = triangles.select("tid", F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(n).alias("local")) for a, b, n in sides])).alias("e")).select("tid", "e.*")
    own = Window.partitionBy("a", "b")
    inner = e.withColumn("n", F.count("*").over(own)).withColumn("first", F.min("tid").over(own)).where("n = 2")
    ids = inner.select("a", "b").distinct().withColumn("dof", (F.row_number().over(Window.orderBy("a", "b")) - 1).cast("long"))
    p = lambda s: vertices.select(F.col("vid").alias(s), *[F.col(c).alias(f"{c}{s}") for c in "xyz"])
    ids = ids.join(p("a"), "a").join(p("b"), "b").withColumn("length", F.sqrt(sum((F.col(f"{c}a") - F.col(f"{c}b")) ** 2 for c in "xyz")))
    return inner.join(ids.select("a", "b", "dof", "length"), ["a", "b"]).select("dof", "tid", "local", F.when(F.col("tid") == F.col("first"), 1.0).otherwise(-1.0).alias("sign"), "length")


def coordinates(vertices: DataFrame, triangles: DataFrame, support: DataFrame) -> DataFrame:
    """Points (dof, x, bbmin, bbmax): centroids or vertices, with the box of the support."""
    g = with_geometry(vertices, triangles)
    s = support.join(g, "tid")
    corner = lambda c: F.get(F.array(*[F.col(f"{c}{n}") for n in range(3)]), F.col("local"))
    centre = lambda c: (F.col(f"{c}0") + F.col(f"{c}1") + F.col(f"{c}2")) / 3
    point = [F.min(F.when(F.col("local") < 0, centre(c)).otherwise(corner(c))) for c in "xyz"]
    low, high = ([f(h(*[F.col(f"{c}{n}") for n in range(3)])) for c in "xyz"] for f, h in ((F.min, F.least), (F.max, F.greatest)))
    return s.groupBy("dof").agg(F.array(*point).alias("x"), F.array(*low).alias("bbmin"), F.array(*high).alias("bbmax"))


def basis(local: Column, s: Column, t: Column) -> Column:
    """Value at (s, t) of the basis function of corner `local`; 1 for the constant one (-1)."""
    return F.when(local < 0, 1.0).when(local == 0, 1 - s - t).when(local == 1, s).otherwise(t)


# ---- forms -----------------------------------------------------------------------------------------------------------


def rule(spark: SparkSession, order: int) -> DataFrame:
    p, w = q.triangle(order)
    return spark.createDataFrame([(n, float(s), float(t), float(v)) for n, ((s, t), v) in enumerate(zip(p, w, strict=True))], "q int, s double, t double, w double")


def pair_rules(spark: SparkSession, order: int) -> DataFrame:
    """(common, s1, t1, s2, t2, w) for all four cases: order^4 times at most 6 rows, whatever the mesh."""
    rows = []
    for common in range(4):
        for (s1, t1), (s2, t2), w in zip(*q.triangle_pair(common, order), strict=True):
            rows.append((common, float(s1), float(t1), float(s2), float(t2), float(w)))
    return spark.createDataFrame(rows, "common int, s1 double, t1 double, s2 double, t2 double, w double")


def mass(vertices: DataFrame, triangles: DataFrame, rows: DataFrame, columns: DataFrame, order: int = 4) -> DataFrame:
    """(i, j, v): the integral of phi_i phi_j, over shared triangles."""
    g = with_geometry(vertices, triangles).select("tid", "jac")
    x = rows.select(F.col("dof").alias("i"), "tid", F.col("local").alias("li")).join(columns.select(F.col("dof").alias("j"), "tid", F.col("local").alias("lj")), "tid").join(g, "tid")
    x = x.crossJoin(F.broadcast(rule(vertices.sparkSession, order)))
    value = F.col("jac") * F.col("w") * basis(F.col("li"), F.col("s"), F.col("t")) * basis(F.col("lj"), F.col("s"), F.col("t"))
    return x.groupBy("i", "j").agg(F.sum(value).alias("v"))


def right_hand_side(vertices: DataFrame, triangles: DataFrame, support: DataFrame, f: Callable[..., Column], order: int = 4) -> DataFrame:
    """(i, v): the integral of f(x, y, z, nx, ny, nz) phi_i."""
    x = support.join(with_geometry(vertices, triangles), "tid").crossJoin(F.broadcast(rule(vertices.sparkSession, order)))
    at = [_point(c, "", "s", "t") for c in "xyz"]
    value = F.col("jac") * F.col("w") * f(*at, F.col("nx"), F.col("ny"), F.col("nz")) * basis(F.col("local"), F.col("s"), F.col("t"))
    return x.groupBy(F.col("dof").alias("i")).agg(F.sum(value).alias("v"))


def _point(c: str, p: str, s: str, t: str, corners: tuple[str, str, str] = ("0", "1", "2")) -> Column:
    a, b, d = (F.col(f"{p}{c}{n}") for n in corners)
    return a + F.col(s) * (b - a) + F.col(t) * (d - a)


def _picked(values: Column, order: Column) -> Column:
    return F.transform(order, lambda n: F.get(values, n))


def _reordered(t: DataFrame, p: str, order: Column) -> DataFrame:
    """Corners of a pair's triangle with prefix p moved by a permutation column (array of 0..2)."""
    for c in "xyz":
        values = F.array(*[F.col(f"{p}{c}{n}") for n in range(3)])
        t = t.withColumn(f"_{c}", _picked(values, order))
    t = t.withColumn(f"{p}order", order)
    for c in "xyz":
        t = t.withColumns({f"{p}{c}{n}": F.get(F.col(f"_{c}"), F.lit(n)) for n in range(3)}).drop(f"_{c}")
    return t


def triangle_pairs(vertices: DataFrame, triangles: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Basis pairs (i, j) with both triangles' geometry (prefixes a_, b_), shared vertices moved to the front of both, and
    their number `common`. All pairs of the two supports are asked for, as in a dense block: restrict the supports first."""
    g = with_geometry(vertices, triangles)
    side = lambda s, p, i: s.select(F.col("dof").alias(i), *[F.col(c).alias(f"{p}{c}") for c in s.columns if c != "dof"]).join(g.select(*[F.col(c).alias(f"{p}{c}") for c in g.columns]), f"{p}tid")
    x = side(rows, "a_", "i").crossJoin(side(columns, "b_", "j"))
    va, vb = F.array("a_v0", "a_v1", "a_v2"), F.array("b_v0", "b_v1", "b_v2")
    shared = F.array_sort(F.array_intersect(va, vb))
    three = F.array(F.lit(0), F.lit(1), F.lit(2))

    def order(own: Column) -> Column:
        first = F.transform(shared, lambda v: (F.array_position(own, v) - 1).cast("int"))
        return F.concat(first, F.array_except(three, first))

    x = x.withColumn("common", F.size(shared)).withColumn("_oa", order(va)).withColumn("_ob", order(vb))
    x = _reordered(_reordered(x, "a_", F.col("_oa")), "b_", F.col("_ob")).drop("_oa", "_ob")
    # the basis function of an original corner is that of its new place
    place = lambda p: F.when(F.col(f"{p}local") < 0, -1).otherwise((F.array_position(F.col(f"{p}order"), F.col(f"{p}local")) - 1).cast("int"))
    return x.withColumns({"a_at": place("a_"), "b_at": place("b_")})


def form(vertices: DataFrame, triangles: DataFrame, rows: DataFrame, columns: DataFrame, kernel: Callable[[dict], Column | cx.C], order: int = 4) -> DataFrame:
    """(i, j, v) or (i, j, re, im): the double integral of kernel * phi_i * phi_j.

    kernel gets r, u (y - x as three columns), na and nb (unit normals). The quadrature rule follows the number of shared
    vertices.
    """
    x = triangle_pairs(vertices, triangles, rows, columns).join(F.broadcast(pair_rules(vertices.sparkSession, order)), "common")
    pa = [_point(c, "a_", "s1", "t1") for c in "xyz"]
    pb = [_point(c, "b_", "s2", "t2") for c in "xyz"]
    u = [b - a for a, b in zip(pa, pb, strict=True)]
    args = {"r": F.sqrt(sum(d * d for d in u)), "u": u, "x": pa, "y": pb, "na": [F.col(f"a_n{c}") for c in "xyz"], "nb": [F.col(f"b_n{c}") for c in "xyz"]}
    f = F.col("w") * F.col("a_jac") * F.col("b_jac") * basis(F.col("a_at"), F.col("s1"), F.col("t1")) * basis(F.col("b_at"), F.col("s2"), F.col("t2"))
    value = kernel(args)
    if isinstance(value, cx.C):
        return x.groupBy("i", "j").agg(*value.scaled(f).sum().named())
    return x.groupBy("i", "j").agg(F.sum(value * f).alias("v"))


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def laplace_single(a: dict) -> Column:
    return k.laplace(a["r"])


def laplace_double(a: dict) -> Column:
    """<n_y, y - x> / (4 pi r^3), with the sign of u = y - x."""
    return F.when(a["r"] > 0, k.laplace_double(_dot(a["nb"], a["u"]), a["r"])).otherwise(0.0)


def laplace_adjoint(a: dict) -> Column:
    return F.when(a["r"] > 0, k.laplace_double(-_dot(a["na"], a["u"]), a["r"])).otherwise(0.0)


def helmholtz_single(kappa: complex) -> Callable[[dict], cx.C]:
    return lambda a: k.helmholtz(kappa, a["r"])


def helmholtz_double(kappa: complex) -> Callable[[dict], cx.C]:
    return lambda a: k.helmholtz_double(kappa, _dot(a["nb"], a["u"]), a["r"])


def helmholtz_adjoint(kappa: complex) -> Callable[[dict], cx.C]:
    def of(a: dict) -> cx.C:
        v = k.helmholtz_double(kappa, _dot(a["na"], a["u"]), a["r"])
        return cx.C(-v.re, -v.im)  # (1 - i kappa r) with x - y is (i kappa r - 1) with y - x, twice negated: once here

    return of


def exponential(a: dict) -> Column:
    return F.exp(-a["r"])


def _edge_basis(p: str, pts: list[Column]) -> tuple[list[Column], Column]:
    """Value (three columns) and divergence of an edge function: sign * length / (2 A) (x - opposite vertex)."""
    f = F.col(f"{p}sign") * F.col(f"{p}length") / F.col(f"{p}jac")
    corner = lambda c: F.get(F.array(*[F.col(f"{p}{c}{n}") for n in range(3)]), F.col(f"{p}at"))
    return [f * (v - corner(c)) for v, c in zip(pts, "xyz", strict=True)], 2 * f


def maxwell_form(vertices: DataFrame, triangles: DataFrame, rows: DataFrame, columns: DataFrame, kappa: complex, eta: float, magnetic: bool = False, order: int = 4) -> DataFrame:
    """(i, j, re, im) over edge spaces. Electric: kernel * (-i kappa eta <phi, psi> - eta / (i kappa) div phi div psi).
    Magnetic: <(y - x) x phi, n x psi> with the normal-free double-layer kernel."""
    x = triangle_pairs(vertices, triangles, rows, columns).join(F.broadcast(pair_rules(vertices.sparkSession, order)), "common")
    pa = [_point(c, "a_", "s1", "t1") for c in "xyz"]
    pb = [_point(c, "b_", "s2", "t2") for c in "xyz"]
    u = [b - a for a, b in zip(pa, pb, strict=True)]
    r = F.sqrt(_dot(u, u))
    (phi, dphi), (psi, dpsi) = _edge_basis("a_", pa), _edge_basis("b_", pb)
    f = F.col("w") * F.col("a_jac") * F.col("b_jac")
    if magnetic:
        cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
        value = k.helmholtz_double(kappa, F.lit(1.0), r).scaled(_dot(cross(u, phi), cross([F.col(f"b_n{c}") for c in "xyz"], psi)))
        value = cx.C(F.when(r > 0, value.re).otherwise(0.0), F.when(r > 0, value.im).otherwise(0.0))
    else:
        ik = 1j * complex(kappa)
        a, b = -ik * eta, -eta / ik
        product, div = _dot(phi, psi), dphi * dpsi
        value = k.helmholtz(kappa, r) * cx.C(a.real * product + b.real * div, a.imag * product + b.imag * div)
    return x.groupBy("i", "j").agg(*value.scaled(f).sum().named())


def maxwell_mass(vertices: DataFrame, triangles: DataFrame, rows: DataFrame, columns: DataFrame, rotated: bool = False, order: int = 4) -> DataFrame:
    """(i, j, v): the integral of <phi_i, psi_j>, or of <phi_i, n x psi_j>, over shared triangles of edge spaces."""
    g = with_geometry(vertices, triangles)
    side = lambda s, p, i: s.select(F.col("dof").alias(i), "tid", F.col("local").alias(f"{p}at"), F.col("sign").alias(f"{p}sign"), F.col("length").alias(f"{p}length"))
    x = side(rows, "a_", "i").join(side(columns, "b_", "j"), "tid").join(g, "tid")
    for p in ("a_", "b_"):
        x = x.withColumns({f"{p}{c}": F.col(c) for c in ["jac", *[f"{c}{n}" for c in "xyz" for n in range(3)]]})
    x = x.crossJoin(F.broadcast(rule(vertices.sparkSession, order)))
    at = [_point(c, "", "s", "t") for c in "xyz"]
    (phi, _), (psi, _) = _edge_basis("a_", at), _edge_basis("b_", at)
    if rotated:
        n = [F.col("nx"), F.col("ny"), F.col("nz")]
        psi = [n[1] * psi[2] - n[2] * psi[1], n[2] * psi[0] - n[0] * psi[2], n[0] * psi[1] - n[1] * psi[0]]
    return x.groupBy("i", "j").agg(F.sum(F.col("w") * F.col("jac") * _dot(phi, psi)).alias("v"))


def maxwell_rhs(vertices: DataFrame, triangles: DataFrame, support: DataFrame, field: Callable[..., tuple[cx.C, cx.C, cx.C]], magnetic: bool = False, order: int = 4) -> DataFrame:
    """(i, re, im): the integral of <field, phi_i>, or of <n x field, phi_i>; field maps (x, y, z) to three complex columns."""
    x = support.join(with_geometry(vertices, triangles), "tid").crossJoin(F.broadcast(rule(vertices.sparkSession, order)))
    x = x.withColumns({"a_at": F.col("local"), "a_sign": F.col("sign"), "a_length": F.col("length"), **{f"a_{c}": F.col(c) for c in ["jac", *[f"{c}{n}" for c in "xyz" for n in range(3)]]}})
    at = [_point(c, "", "s", "t") for c in "xyz"]
    phi, _ = _edge_basis("a_", at)
    e = list(field(*at))
    if magnetic:
        n = [F.col("nx"), F.col("ny"), F.col("nz")]
        e = [e[2].scaled(n[1]) - e[1].scaled(n[2]), e[0].scaled(n[2]) - e[2].scaled(n[0]), e[1].scaled(n[0]) - e[0].scaled(n[1])]
    value = e[0].scaled(phi[0]) + e[1].scaled(phi[1]) + e[2].scaled(phi[2])
    return x.groupBy(F.col("dof").alias("i")).agg(*value.scaled(F.col("w") * F.col("jac")).sum().named())


def generator_integral(vertices: DataFrame, triangles: DataFrame, support: DataFrame, points: DataFrame, kernel: Callable[[Column], Column], order: int = 4) -> DataFrame:
    """(i, p, v): the integral over x of kernel(|x - y_p|) phi_i, for a few points (p, px, py, pz)."""
    x = support.join(with_geometry(vertices, triangles), "tid").crossJoin(F.broadcast(rule(vertices.sparkSession, order))).crossJoin(F.broadcast(points))
    d = [_point(c, "", "s", "t") - F.col(f"p{c}") for c in "xyz"]
    value = F.col("jac") * F.col("w") * basis(F.col("local"), F.col("s"), F.col("t")) * kernel(F.sqrt(_dot(d, d)))
    return x.groupBy(F.col("dof").alias("i"), "p").agg(F.sum(value).alias("v"))
