"""Matrices as coordinate tables (i, j, v) or, if complex, (i, j, re, im), sparse or dense, with unique (i, j).

Factors are numbers of Python, complex ones included. An operation is complex as soon as one of its operands or factors
is; real operands then have imaginary parts of 0. Products join on the inner index and sum by the outer ones, with partial sums before the shuffle. Which side is broadcast
is left to the optimizer and its size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import complexnum as cx
from . import vector
from .iterate import paired, settled

NORMAL, TRANSPOSED, ADJOINT, CONJUGATE = "N", "T", "C", "J"


def from_entries(df: DataFrame, i: str, j: str, v: Column) -> DataFrame:
    """A matrix from rows that may repeat a position: repeated entries are summed."""
    return df.groupBy(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).agg(F.sum(v).alias("v"))


def import_crs(rows: DataFrame) -> DataFrame:
    """From one row (rowptr, colind, coeff) of arrays, 0-based."""
    at = rows.select("rowptr", "colind", "coeff", F.posexplode(F.slice("rowptr", F.lit(1), F.size("rowptr") - 1)).alias("i", "a"))
    spans = at.select("i", "colind", "coeff", "a", F.get("rowptr", F.col("i") + 1).alias("b")).where("b > a")
    k = spans.select("i", "colind", "coeff", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("k"))
    return k.select(F.col("i").cast("long").alias("i"), F.get("colind", F.col("k").cast("int")).cast("long").alias("j"), F.get("coeff", F.col("k").cast("int")).alias("v"))


def import_ccs(rows: DataFrame) -> DataFrame:
    """From one row (colptr, rowind, coeff) of arrays."""
    return transpose(import_crs(rows.select(F.col("colptr").alias("rowptr"), F.col("rowind").alias("colind"), "coeff")))


def export_ccs(a: DataFrame, ncols: int, lower_only: bool = False) -> DataFrame:
    """As one row of arrays (colptr, rowind, coeff): small matrices only, since one row holds all."""
    a = a.where("i >= j") if lower_only else a
    every = a.sparkSession.range(ncols).select(F.col("id").alias("j"))
    columns = every.join(a.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e")), "j", "left").select("j", F.coalesce("e", F.array().cast("array<struct<i:long,v:double>>")).alias("e"))
    one = columns.agg(F.array_sort(F.collect_list(F.struct("j", "e"))).alias("c"))
    sizes = F.transform("c", lambda x: F.size(x["e"]).cast("long"))
    zero = F.array(F.lit(0).cast("long"))
    ends = F.aggregate(sizes, zero, lambda upto, n: F.concat(upto, F.array(F.element_at(upto, -1) + n)))
    flat = F.flatten(F.transform("c", lambda x: x["e"]))
    return one.select(ends.alias("colptr"), F.transform(flat, lambda x: x["i"]).alias("rowind"), F.transform(flat, lambda x: x["v"]).alias("coeff"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in a.columns if c not in ("i", "j")])


def conjugate(a: DataFrame) -> DataFrame:
    return a.withColumn("im", -F.col("im")) if "im" in a.columns else a


def apply_op(a: DataFrame, op: str = NORMAL) -> DataFrame:
    """The matrix as it is (N), transposed (T), adjoint (C) or conjugate (J)."""
    a = transpose(a) if op in (TRANSPOSED, ADJOINT) else a
    return conjugate(a) if op in (ADJOINT, CONJUGATE) else a


def compose(outer: str, inner: str) -> str:
    """The operation equal to `outer` after `inner`; the four form a group."""
    flip = {NORMAL: (0, 0), TRANSPOSED: (1, 0), ADJOINT: (1, 1), CONJUGATE: (0, 1)}
    t, c = (a ^ b for a, b in zip(flip[outer], flip[inner], strict=True))
    return next(op for op, x in flip.items() if x == (t, c))


def is_complex(*of: DataFrame | complex | None) -> bool:
    return any("im" in x.columns if isinstance(x, DataFrame) else isinstance(x, complex) for x in of)


def to_complex(x: DataFrame) -> DataFrame:
    """(…, re, im) for a table that may be real."""
    return x if "im" in x.columns else x.withColumn("im", F.lit(0.0)).withColumnRenamed("v", "re")


def factor(alpha: complex) -> cx.C:
    return cx.C(F.lit(float(complex(alpha).real)), F.lit(float(complex(alpha).imag)))


def values(a: DataFrame) -> list[str]:
    return ["re", "im"] if "im" in a.columns else ["v"]


def scale(alpha: complex, a: DataFrame) -> DataFrame:
    if is_complex(alpha, a):
        a = to_complex(a)
        return a.select("i", "j", *(factor(alpha) * cx.of("re", "im")).named())
    return a.select("i", "j", (F.lit(float(alpha)) * F.col("v")).alias("v"))


def add(alpha: complex, a: DataFrame, b: DataFrame) -> DataFrame:
    """b + alpha * a."""
    a = scale(alpha, a)
    if is_complex(a, b):
        a, b = to_complex(a), to_complex(b)
    both = a.unionByName(b.select("i", "j", *values(b)))
    return both.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in values(a)])


def mul_vec(a: DataFrame, x: DataFrame, alpha: complex = 1.0, beta: complex = 0.0, y: DataFrame | None = None, op: str = NORMAL) -> DataFrame:
    """alpha * op(a) x + beta * y; (i, re, im) if anything is complex. beta = 0 ignores y."""
    a = apply_op(a, op)
    y = y if beta else None
    if is_complex(a, x, alpha, beta, y):
        z = (cx.of("a.re", "a.im") * cx.of("x.re", "x.im")).sum()
        rows = to_complex(a).alias("a").join(to_complex(x).alias("x"), F.col("a.j") == F.col("x.i"))
        out = rows.groupBy(F.col("a.i").alias("i")).agg(*z.named()).select("i", *(factor(alpha) * cx.of("re", "im")).named())
        return vector.add(beta, y, out) if y is not None else out
    rows = a.alias("a").join(x.alias("x"), F.col("a.j") == F.col("x.i"))
    out = rows.groupBy(F.col("a.i").alias("i")).agg((F.lit(float(alpha)) * F.sum(F.col("a.v") * F.col("x.v"))).alias("v"))
    return vector.add(beta, y, out) if y is not None else out


def triangle(a: DataFrame, shape: str = "lower", unit: bool = False) -> DataFrame:
    """The lower or upper triangle; with a unit diagonal, stored diagonal values are replaced by 1."""
    part = a.where("i >= j" if shape == "lower" else "i <= j")
    ones = {c: F.when(F.col("i") == F.col("j"), 0.0 if c == "im" else 1.0).otherwise(F.col(c)) for c in values(a)}
    return part.withColumns(ones) if unit else part


def matmul_triangle(a: DataFrame, b: DataFrame, side: str = "left", shape: str = "lower", unit: bool = False, alpha: complex = 1.0, op: str = NORMAL) -> DataFrame:
    """alpha * op(tri(a)) b, or, with the triangle on the right, alpha * b op(tri(a))."""
    t = triangle(a, shape, unit)
    return matmul(t, b, alpha, op_a=op) if side == "left" else matmul(b, t, alpha, op_b=op)


def mul_vec_triangle(a: DataFrame, x: DataFrame, shape: str = "lower", unit: bool = False) -> DataFrame:
    return mul_vec(triangle(a, shape, unit), x)


def matmul(a: DataFrame, b: DataFrame, alpha: complex = 1.0, beta: complex = 0.0, c: DataFrame | None = None, op_a: str = NORMAL, op_b: str = NORMAL) -> DataFrame:
    """alpha * op(a) op(b) + beta * c."""
    a, b = apply_op(a, op_a), apply_op(b, op_b)
    if is_complex(a, b, alpha):
        x = to_complex(a).select("i", F.col("j").alias("k"), F.col("re").alias("ar"), F.col("im").alias("ai"))
        y = to_complex(b).select(F.col("i").alias("k"), "j", F.col("re").alias("br"), F.col("im").alias("bi"))
        z = (cx.of("ar", "ai") * cx.of("br", "bi")).sum()
        out = scale(alpha, x.join(y, "k").groupBy("i", "j").agg(*z.named()))
        return add(beta, c, out) if beta and c is not None else out
    rows = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb")), "k")
    out = rows.groupBy("i", "j").agg((F.lit(float(alpha)) * F.sum(F.col("va") * F.col("vb"))).alias("v"))
    return add(beta, c, out) if beta and c is not None else out


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    if is_complex(a, b):
        both = to_complex(a).alias("a").join(to_complex(b).alias("b"), ["i", "j"])
        return both.select("i", "j", *(cx.of("a.re", "a.im") * cx.of("b.re", "b.im")).named())
    return a.alias("a").join(b.alias("b"), ["i", "j"]).select("i", "j", (F.col("a.v") * F.col("b.v")).alias("v"))


def scale_columns(a: DataFrame, d: DataFrame) -> DataFrame:
    """a * diag(d)."""
    if is_complex(a, d):
        rows = to_complex(a).alias("a").join(to_complex(d).alias("d"), F.col("a.j") == F.col("d.i"))
        return rows.select(F.col("a.i").alias("i"), F.col("a.j").alias("j"), *(cx.of("a.re", "a.im") * cx.of("d.re", "d.im")).named())
    return a.alias("a").join(d.alias("d"), F.col("a.j") == F.col("d.i")).select(F.col("a.i").alias("i"), F.col("a.j").alias("j"), (F.col("a.v") * F.col("d.v")).alias("v"))


def scale_rows(d: DataFrame, a: DataFrame) -> DataFrame:
    """diag(d) * a."""
    return transpose(scale_columns(transpose(a), d))


def outer(x: DataFrame, y: DataFrame) -> DataFrame:
    """x y^T: (i, j, v) or (i, j, re, im), a row for each pair of entries."""
    if is_complex(x, y):
        x, y = to_complex(x), to_complex(y)
        pairs = paired(x.select("i", F.col("re").alias("ar"), F.col("im").alias("ai")), y.select(F.col("i").alias("j"), F.col("re").alias("br"), F.col("im").alias("bi")))
        return pairs.select("i", "j", *(cx.of("ar", "ai") * cx.of("br", "bi")).named())
    pairs = paired(x.select("i", F.col("v").alias("va")), y.select(F.col("i").alias("j"), F.col("v").alias("vb")))
    return pairs.select("i", "j", (F.col("va") * F.col("vb")).alias("v"))


def add_rank1(a: DataFrame, alpha: complex, x: DataFrame, y: DataFrame, conjugated: bool = True) -> DataFrame:
    """a + alpha * x y^H, or x y^T unless conjugated. Rows and columns without entries of a need no sum, so only pairs of
    the others are grouped with a."""
    total = lambda v: settled(v.groupBy("i").agg(*[F.sum(c).alias(c) for c in values(v)]))
    a, x, y = settled(a), total(x), total(vector.conj(y) if conjugated else y)

    def parted(v: DataFrame, side: str) -> list[DataFrame]:
        own = a.select(F.col(side).alias("_own")).distinct()
        return [settled(v.join(own, F.col("i").eqNullSafe(F.col("_own")), how)) for how in ("left_semi", "left_anti")]

    (x1, x2), (y1, y2) = parted(x, "i"), parted(y, "j")
    met = add(alpha, outer(x1, y1), a)
    free = [scale(alpha, outer(x2, y)), scale(alpha, outer(x1, y2))]
    if "im" in met.columns:
        free = [to_complex(f) for f in free]
    return met.unionByName(free[0]).unionByName(free[1])


def max_index(a: DataFrame) -> DataFrame:
    """(i, j) of the largest modulus, the lowest position on ties."""
    size = F.hypot("re", "im") if is_complex(a) else F.abs("v")
    return a.agg(F.min_by(F.struct("i", "j"), F.struct(-size, "i", "j")).alias("p")).select("p.i", "p.j")


def norm_frobenius(a: DataFrame) -> DataFrame:
    modulus = F.hypot("re", "im") if "im" in a.columns else F.abs("v")
    return a.agg(F.sqrt(F.coalesce(F.sum(modulus**2), F.lit(0.0))).alias("v"))


def diff_norm_frobenius(a: DataFrame, b: DataFrame) -> DataFrame:
    return norm_frobenius(add(-1.0, b, a))


def norm_1(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("v"))


def norm_max_row(a: DataFrame) -> DataFrame:
    return norm_1(transpose(a))


def norms(a: DataFrame) -> DataFrame:
    """frobenius, one and inf in one row, by one aggregation over rows and one over columns."""
    size = F.abs("v")
    rows = a.groupBy("i").agg(F.sum(size).alias("s"), F.sum(size**2).alias("q")).agg(F.sqrt(F.coalesce(F.sum("q"), F.lit(0.0))).alias("frobenius"), F.coalesce(F.max("s"), F.lit(0.0)).alias("inf"))
    return rows.crossJoin(norm_1(a).select(F.coalesce("v", F.lit(0.0)).alias("one")))


def make_symmetric(a: DataFrame) -> DataFrame:
    """The lower triangle mirrored to the upper one."""
    low = a.where("i >= j")
    return low.unionByName(transpose(low.where("i > j")))


def make_hermitian(a: DataFrame) -> DataFrame:
    low = a.where("i >= j")
    return low.unionByName(conjugate(transpose(low.where("i > j"))))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", *values(a))


def real_part(a: DataFrame) -> DataFrame:
    """The real matrix of real parts; a real matrix is its own."""
    return a.select("i", "j", F.col(values(a)[0]).alias("v"))


def imaginary_part(a: DataFrame) -> DataFrame:
    """The real matrix of imaginary parts; of a real matrix, zeros on its pattern."""
    return a.select("i", "j", (F.col("im") if is_complex(a) else F.lit(0.0)).alias("v"))


def entry(a: DataFrame, i: int, j: int) -> DataFrame:
    return a.where((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def has_entry(a: DataFrame, i: int, j: int) -> bool:
    return a.where((F.col("i") == i) & (F.col("j") == j)).limit(1).count() > 0


def set_entry(a: DataFrame, i: int, j: int, v: float) -> DataFrame:
    """The matrix with a stored entry changed; the pattern is fixed, so a position off it is an error."""
    if not has_entry(a, i, j):
        raise KeyError(f"({i}, {j}) is not in the sparsity pattern")
    return a.withColumn("v", F.when((F.col("i") == i) & (F.col("j") == j), float(v)).otherwise(F.col("v")))


def add_entry(a: DataFrame, i: int, j: int, v: float) -> DataFrame:
    if not has_entry(a, i, j):
        raise KeyError(f"({i}, {j}) is not in the sparsity pattern")
    return a.withColumn("v", F.when((F.col("i") == i) & (F.col("j") == j), F.col("v") + float(v)).otherwise(F.col("v")))


def sort_entries(a: DataFrame) -> DataFrame:
    return a.repartitionByRange("i").sortWithinPartitions("i", "j")


def permute(a: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """b[rp[i], cp[j]] = a[i, j], for permutations (e, i)."""
    if rows is not None:
        a = a.join(rows.select(F.col("e").alias("i"), F.col("i").alias("_new")), "i").drop("i").withColumnRenamed("_new", "i")
    if columns is not None:
        a = a.join(columns.select(F.col("e").alias("j"), F.col("i").alias("_new")), "j").drop("j").withColumnRenamed("_new", "j")
    return a.select("i", "j", *values(a))


def symmetry(a: DataFrame, eps: float = 0.0) -> DataFrame:
    """How many positions differ from their mirror image by more than eps: 0 for a symmetric matrix."""
    both = a.select("i", "j", "v").unionByName(transpose(a).select("i", "j", (-F.col("v")).alias("v")))
    return both.groupBy("i", "j").agg(F.sum("v").alias("d")).agg(F.count(F.when(F.abs("d") > eps, 1)).alias("n"))


def entries_per_row(a: DataFrame, nrows: int) -> DataFrame:
    """avg (rounded down) and max entries in a row."""
    per = a.groupBy("i").agg(F.count("*").alias("n"))
    return per.agg((F.coalesce(F.sum("n"), F.lit(0)) / F.lit(nrows)).cast("long").alias("average"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def diagonal_zeros(a: DataFrame, nrows: int, eps: float = 0.0) -> DataFrame:
    """How many diagonal entries are absent or at most eps in modulus."""
    return a.where((F.col("i") == F.col("j")) & (F.abs("v") > eps)).agg((F.lit(nrows) - F.count("*")).alias("n"))


def dominance(a: DataFrame) -> DataFrame:
    """Per row: its diagonal's modulus and the sum of the others'."""
    size = F.abs("v")
    return a.groupBy("i").agg(F.sum(F.when(F.col("i") == F.col("j"), size).otherwise(0.0)).alias("diag"), F.sum(F.when(F.col("i") != F.col("j"), size).otherwise(0.0)).alias("off"))


def is_diagonally_dominant(a: DataFrame, weak: bool = False) -> DataFrame:
    test = F.col("diag") >= F.col("off") if weak else F.col("diag") > F.col("off")
    return dominance(a).agg(F.coalesce(F.bool_and(test), F.lit(True)).alias("dominant"))


def dominance_gap(a: DataFrame) -> DataFrame:
    """The largest excess of off-diagonal over diagonal sums, 0 at least."""
    return dominance(a).agg(F.greatest(F.lit(0.0), F.max(F.col("off") - F.col("diag"))).alias("v"))


def dominance_summary(a: DataFrame) -> DataFrame:
    """strict, weak and gap (the largest excess of off-diagonal sums) by one aggregation over rows."""
    every = lambda test: F.coalesce(F.bool_and(test), F.lit(True))
    return dominance(a).agg(every(F.col("diag") > F.col("off")).alias("strict"), every(F.col("diag") >= F.col("off")).alias("weak"), F.greatest(F.lit(0.0), F.max(F.col("off") - F.col("diag"))).alias("gap"))


def check(a: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Counts of structural faults: out of range, repeated, null or NaN, and stored zeros."""
    c = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    flat = a.agg(c(~F.col("i").between(0, nrows - 1) | ~F.col("j").between(0, ncols - 1)).alias("out_of_range"), c(F.col("v").isNull() | F.isnan("v")).alias("undefined"), c(F.col("v") == 0).alias("zeros"))
    repeats = a.groupBy("i", "j").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    return flat.crossJoin(repeats)


def restrict(a: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """The sub-matrix of closed index ranges, re-based to 0."""
    inside = a.where(F.col("i").between(*rows) & F.col("j").between(*columns))
    return inside.select((F.col("i") - rows[0]).alias("i"), (F.col("j") - columns[0]).alias("j"), *values(a))


def restrict_permuted(a: DataFrame, rows: tuple[int, int], row_perm: DataFrame, columns: tuple[int, int], column_perm: DataFrame) -> DataFrame:
    return restrict(permute(a, row_perm, column_perm), rows, columns)


def count_in(a: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    return a.where(F.col("i").between(*rows) & F.col("j").between(*columns)).agg(F.count("*").alias("n"))


def pattern_histogram(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.count("*").alias("entries")).groupBy("entries").agg(F.count("*").alias("row_count"))


def copy_structure(a: DataFrame) -> DataFrame:
    return a.select("i", "j", F.lit(0.0).alias("v"))


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def random(spark, nrows: int, ncols: int, seed: int | None = None, normal: bool = False) -> DataFrame:
    """A dense random matrix, uniform in [-1, 1) or normal."""
    at = spark.range(nrows * ncols).select(F.expr(f"id div {ncols}").alias("i"), (F.col("id") % ncols).alias("j"))
    return at.select("i", "j", (F.randn(seed) if normal else F.rand(seed) * 2 - 1).alias("v"))


def low_rank_norm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frobenius norm of a b^T for factors (i, k, v), from two small Gram matrices instead of the product."""
    gram = lambda f: matmul(f.select("i", F.col("k").alias("j"), "v"), f.select("i", F.col("k").alias("j"), "v"), op_a=TRANSPOSED)
    return hadamard(gram(a), gram(b)).agg(F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.sum("v"), F.lit(0.0)))).alias("v"))


def low_rank_apply(a: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """a (b^T x) for factors (i, k, v): two sparse products over the rank, never the matrix."""
    t = mul_vec(b.select(F.col("k").alias("i"), F.col("i").alias("j"), "v"), x)
    return mul_vec(a.select("i", F.col("k").alias("j"), "v"), t)


def spectral_norm(a: DataFrame, iterations: int = 30, tolerance: float = 1e-10, seed: int = 1) -> float:
    """The largest singular value, by power iteration on a^T a; each step is two sparse products and one small row."""
    x = a.select(F.col("j").alias("i")).distinct().select("i", (F.rand(seed) + 0.5).alias("v"))
    from .iterate import settled

    x, last = settled(x), 0.0
    for _ in range(iterations):
        y = mul_vec(a, x)
        z = settled(mul_vec(a, y, op=TRANSPOSED))
        n = vector.norm2(z).first()["v"]
        if n == 0:
            return 0.0
        x, value = vector.scale(1 / n, z), n**0.5
        x0 = settled(x)
        x = x0
        if abs(value - last) <= tolerance * value:
            last = value
            break
        last = value
    # Rayleigh quotient of the last unit vector
    return vector.norm2(mul_vec(a, x)).first()["v"]


def row_neighbours(blocks: DataFrame) -> DataFrame:
    """For blocks (lvl, row_first, col_first, block_id): the next and previous one in each block row and block column."""
    row = Window.partitionBy("lvl", "row_first").orderBy("col_first")
    column = Window.partitionBy("lvl", "col_first").orderBy("row_first")
    at = lambda f, w: f("block_id").over(w)
    return blocks.withColumns({"next_in_row": at(F.lead, row), "previous_in_row": at(F.lag, row), "next_in_column": at(F.lead, column), "previous_in_column": at(F.lag, column)})
