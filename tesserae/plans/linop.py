"""Lazy linear operators: a tree that emits one DataFrame plan when applied.

Textbook semantics throughout: products apply right to left with all scales, an adjoint or transpose reverses them, a
product of one factor applies it once, and applying adds nothing to the target unless asked by apply_add.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coo, vector


class Operator:
    """Something that maps vectors (i, v) to vectors."""

    nrows: int
    ncols: int

    def apply(self, x: DataFrame, op: str = coo.NORMAL) -> DataFrame:
        raise NotImplementedError

    def apply_add(self, alpha: float, x: DataFrame, y: DataFrame, op: str = coo.NORMAL) -> DataFrame:
        return vector.add(alpha, self.apply(x, op), y)

    def is_self_adjoint(self) -> bool:
        return False

    def domain_dim(self, op: str = coo.NORMAL) -> int:
        return self.ncols if op in (coo.NORMAL, coo.CONJUGATE) else self.nrows

    def range_dim(self, op: str = coo.NORMAL) -> int:
        return self.nrows if op in (coo.NORMAL, coo.CONJUGATE) else self.ncols

    def __add__(self, other: "Operator") -> "Operator":
        return matrix_sum((1.0, coo.NORMAL, self), (1.0, coo.NORMAL, other))

    def __matmul__(self, other: "Operator") -> "Operator":
        return matrix_product((1.0, coo.NORMAL, self), (1.0, coo.NORMAL, other))


#: Rows of a vector that every task may hold.
HELD_ROWS = 2_000_000


@dataclass
class Matrix(Operator):
    """A coordinate matrix as an operator. With `still`, for matrices with far more entries than rows and columns, vectors of
    at most HELD_ROWS go to where the entries are, so that these are not shuffled at each application."""

    entries: DataFrame
    nrows: int
    ncols: int
    self_adjoint: bool = False
    still: bool = False

    def apply(self, x: DataFrame, op: str = coo.NORMAL) -> DataFrame:
        return coo.mul_vec(self.entries, F.broadcast(x) if self.still and self.domain_dim(op) <= HELD_ROWS else x, op=op)

    def is_self_adjoint(self) -> bool:
        return self.self_adjoint


@dataclass
class Blocks(Operator):
    """A hierarchical matrix as an operator."""

    table: DataFrame
    nrows: int
    ncols: int
    self_adjoint: bool = False

    def apply(self, x: DataFrame, op: str = coo.NORMAL) -> DataFrame:
        from ..operators import blocks

        return blocks.mul_vec(self.table, x, transpose=op in (coo.TRANSPOSED, coo.ADJOINT))

    def is_self_adjoint(self) -> bool:
        return self.self_adjoint


@dataclass
class Rank1(Operator):
    """alpha * x y^T of two vectors, for real ones. The matrix is never formed: applying it is a dot product and a scaling."""

    x: DataFrame
    y: DataFrame
    nrows: int
    ncols: int
    alpha: float = 1.0
    self_adjoint: bool = False

    def apply(self, x: DataFrame, op: str = coo.NORMAL) -> DataFrame:
        left, right = (self.x, self.y) if op in (coo.NORMAL, coo.CONJUGATE) else (self.y, self.x)
        dot = right.alias("y").join(x.alias("x"), "i").agg(F.coalesce(F.sum(F.col("y.v") * F.col("x.v")), F.lit(0.0)).alias("_dot"))
        return left.crossJoin(F.broadcast(dot)).select("i", (F.lit(float(self.alpha)) * F.col("v") * F.col("_dot")).alias("v"))

    def is_self_adjoint(self) -> bool:
        return self.self_adjoint


@dataclass
class Permuted(Operator):
    """P^-1 A Q: an operator in internal numbering applied to vectors in external numbering."""

    inner: Operator
    row_perm: DataFrame
    col_perm: DataFrame

    def __post_init__(self) -> None:
        self.nrows, self.ncols = self.inner.nrows, self.inner.ncols

    def apply(self, x: DataFrame, op: str = coo.NORMAL) -> DataFrame:
        before, after = (self.col_perm, self.row_perm) if op in (coo.NORMAL, coo.CONJUGATE) else (self.row_perm, self.col_perm)
        return vector.permute_inverse(self.inner.apply(vector.permute(x, before), op), after)


Term = tuple[float, str, Operator]


@dataclass
class Sum(Operator):
    terms: list[Term]

    def __post_init__(self) -> None:
        _, op, first = self.terms[0]
        self.nrows, self.ncols = first.range_dim(op), first.domain_dim(op)
        if any((t.range_dim(o), t.domain_dim(o)) != (self.nrows, self.ncols) for _, o, t in self.terms):
            raise ValueError("the terms of a sum must have equal dimensions")

    def apply(self, x: DataFrame, op: str = coo.NORMAL) -> DataFrame:
        if all(isinstance(t, Matrix) for _, _, t in self.terms):  # one join for all terms
            merged = None
            for f, o, t in self.terms:
                part = coo.scale(f, coo.apply_op(t.entries, coo.compose(op, o)))  # type: ignore[attr-defined]
                merged = part if merged is None else merged.unionByName(part)
            return coo.mul_vec(merged, x)
        parts = [vector.scale(f, t.apply(x, coo.compose(op, o))) for f, o, t in self.terms]
        return vector.reduce_sum(parts)

    def is_self_adjoint(self) -> bool:
        return all(t.is_self_adjoint() for _, _, t in self.terms)


@dataclass
class Product(Operator):
    """f0 op0(A0) * f1 op1(A1) * ...; the product of the matrices is never formed."""

    terms: list[Term]

    def __post_init__(self) -> None:
        self.nrows, self.ncols = self.terms[0][2].range_dim(self.terms[0][1]), self.terms[-1][2].domain_dim(self.terms[-1][1])
        for (_, o, a), (_, p, b) in zip(self.terms[:-1], self.terms[1:], strict=True):
            if a.domain_dim(o) != b.range_dim(p):
                raise ValueError("the factors of a product must fit")

    def apply(self, x: DataFrame, op: str = coo.NORMAL) -> DataFrame:
        order = self.terms if op in (coo.TRANSPOSED, coo.ADJOINT) else self.terms[::-1]
        for f, o, t in order:
            x = t.apply(x, coo.compose(op, o))
            x = x if f == 1 else vector.scale(f, x)
        return x

    def is_self_adjoint(self) -> bool:
        return len(self.terms) == 1 and self.terms[0][2].is_self_adjoint()


def matrix_sum(*terms: Term) -> Sum:
    return Sum(list(terms))


def matrix_product(*terms: Term) -> Product:
    return Product(list(terms))


def identity(spark, n: int) -> Matrix:
    return Matrix(coo.identity(spark, n), n, n, True)


def diagonal(d: DataFrame, n: int) -> Matrix:
    return Matrix(d.select("i", F.col("i").alias("j"), "v"), n, n, True)
