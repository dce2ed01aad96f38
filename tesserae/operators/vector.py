"""Vectors (i, v): every operator is a projection, an aggregate or one join on the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import complexnum as cx


def fill(x: DataFrame, f: float) -> DataFrame:
    return x.select("i", F.lit(float(f)).alias("v"))


def fill_random(x: DataFrame, seed: int | None = None) -> DataFrame:
    """Uniform in [-500, 500); the same seed and partitioning give the same values, no seed gives new ones."""
    return x.select("i", (F.rand(seed) * 1000 - 500).alias("v"))


def total(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def stable_total(x: DataFrame, digits: int = 10) -> DataFrame:
    """The sum in exact decimal arithmetic of `digits` places, so that no order of summation matters.

    Sorting by magnitude, as one would on one machine, needs the whole vector in one place; exact partial sums don't.
    """
    return x.agg(F.coalesce(F.sum(F.round("v", digits).cast(f"decimal(38,{digits})")), F.lit(0)).cast("double").alias("v"))


def scale(alpha: complex, x: DataFrame) -> DataFrame:
    """alpha * x; a zero factor also clears NaN and infinities. Complex if the factor or the vector is."""
    if "im" in x.columns or isinstance(alpha, complex):
        z, a = cx.of("re", "im") if "im" in x.columns else cx.real(F.col("v")), complex(alpha)
        z = z * cx.C(F.lit(a.real), F.lit(a.imag)) if a else cx.C(F.lit(0.0), F.lit(0.0))
        return x.select("i", *z.named())
    return fill(x, 0.0) if alpha == 0 else x.select("i", (F.lit(float(alpha)) * F.col("v")).alias("v"))


copy = scale


def conj(x: DataFrame) -> DataFrame:
    """The identity for reals; for (i, re, im) the conjugate."""
    return x.select("i", "re", (-F.col("im")).alias("im")) if "im" in x.columns else x


def swap(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    return y, x


def max_index(x: DataFrame) -> DataFrame:
    """The index of the largest modulus, the lowest on ties; no row's index for an empty vector is null."""
    return x.agg(F.min_by("i", F.struct(-F.abs("v"), "i")).alias("i"))


def min_index(x: DataFrame) -> DataFrame:
    return x.agg(F.min_by("i", F.struct(F.abs("v"), "i")).alias("i"))


def add(alpha: complex, x: DataFrame, y: DataFrame) -> DataFrame:
    """y + alpha * x over the union of their indices, by one aggregation."""
    x = scale(alpha, x)
    if "im" in x.columns or "im" in y.columns:
        x, y = (t if "im" in t.columns else t.select("i", F.col("v").alias("re"), F.lit(0.0).alias("im")) for t in (x, y))
        return x.unionByName(y.select("i", "re", "im")).groupBy("i").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return x.unionByName(y.select("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))


def dotu(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum of x_i * y_i, without conjugation."""
    if "im" in x.columns:
        z = cx.of("x.re", "x.im") * cx.of("y.re", "y.im")
        return x.alias("x").join(y.alias("y"), "i").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for c, n in zip(z, ("re", "im"), strict=True)])
    return x.alias("x").join(y.alias("y"), "i").agg(F.coalesce(F.sum(F.col("x.v") * F.col("y.v")), F.lit(0.0)).alias("v"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """Sum of conj(x_i) * y_i."""
    return dotu(conj(x), y)


def stable_dotu(x: DataFrame, y: DataFrame, digits: int = 10) -> DataFrame:
    return stable_total(x.alias("x").join(y.alias("y"), "i").select("i", (F.col("x.v") * F.col("y.v")).alias("v")), digits)


def _modulus(x: DataFrame) -> Column:
    return F.hypot("re", "im") if "im" in x.columns else F.abs("v")


def norm2(x: DataFrame) -> DataFrame:
    return x.agg(F.sqrt(F.coalesce(F.sum(_modulus(x) ** 2), F.lit(0.0))).alias("v"))


def norm_inf(x: DataFrame) -> DataFrame:
    return x.agg(F.coalesce(F.max(_modulus(x)), F.lit(0.0)).alias("v"))


def entry(x: DataFrame, i: int) -> DataFrame:
    """The value at i, 0 where none is stored."""
    return x.where(F.col("i") == i).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def set_entry(x: DataFrame, i: int, v: float) -> DataFrame:
    one = x.sparkSession.createDataFrame([(i, float(v))], "i long, v double")
    return x.where(F.col("i") != i).unionByName(one)


def add_entry(x: DataFrame, i: int, v: float) -> DataFrame:
    return add(1.0, x.sparkSession.createDataFrame([(i, float(v))], "i long, v double"), x)


def sub_vector(x: DataFrame, first: int, last: int) -> DataFrame:
    return x.where(F.col("i").between(first, last))


def permute(x: DataFrame, perm: DataFrame) -> DataFrame:
    """y[p[i]] = x[i], for a permutation (e, i)."""
    return x.withColumnRenamed("i", "e").join(perm, "e").drop("e").select("i", *[c for c in x.columns if c != "i"])


def permute_inverse(x: DataFrame, perm: DataFrame) -> DataFrame:
    """y[i] = x[p[i]]."""
    return x.join(perm, "i").select(F.col("e").alias("i"), *[c for c in x.columns if c != "i"])


def invert_permutation(perm: DataFrame) -> DataFrame:
    return perm.select(F.col("i").alias("e"), F.col("e").alias("i"))


def real_part(x: DataFrame) -> DataFrame:
    return x.select("i", F.col("re").alias("v"))


def imaginary_part(x: DataFrame) -> DataFrame:
    return x.select("i", F.col("im").alias("v"))


def modulus(x: DataFrame) -> DataFrame:
    return x.select("i", _modulus(x).alias("v"))


def convert(x: DataFrame, kind: str) -> DataFrame:
    """Values as 'float' or 'double'."""
    return x.select("i", *[F.col(c).cast(kind).alias(c) for c in x.columns if c != "i"])


def to_blocked(x: DataFrame, clusters: DataFrame) -> DataFrame:
    """Split along the leaf clusters (cid, first, last, is_leaf) of a tree: (blk, i, v).

    The leaves' ranges don't overlap, so each index falls in one: a leaf's range is cut into bins of its own width class,
    which makes the range join an equality join.
    """
    leaves = clusters.where("is_leaf").select(F.col("cid").alias("blk"), "first", "last")
    width = leaves.agg(F.coalesce(F.max(F.col("last") - F.col("first") + 1), F.lit(1)).alias("w")).first()["w"]
    bins = leaves.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    rows = x.withColumn("bin", F.floor(F.col("i") / width)).join(bins, "bin").where(F.col("i").between(F.col("first"), F.col("last")))
    return rows.select(F.col("blk").cast("int").alias("blk"), "i", "v")


def to_scalar(x: DataFrame) -> DataFrame:
    return x.drop("blk")


def with_block(x: DataFrame, blk: int, part: DataFrame) -> DataFrame:
    """A block vector with one block set or replaced."""
    return x.where(F.col("blk") != blk).unionByName(part.select(F.lit(blk).cast("int").alias("blk"), "i", "v"))


def reduce_sum(parts: list[DataFrame]) -> DataFrame:
    """The sum of copies of a vector held apart."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first.groupBy("i").agg(F.sum("v").alias("v"))


def byte_size(x: DataFrame) -> DataFrame:
    return x.agg((F.count("*") * (8 * (len(x.columns) - 1))).alias("bytes"))
