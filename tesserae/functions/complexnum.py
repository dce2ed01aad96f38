"""Complex numbers as pairs of columns; Spark has no such type."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class C(NamedTuple):
    """A complex expression. Reals lift to it with an imaginary part of 0."""

    re: Column
    im: Column

    def __add__(self, o: "C") -> "C":  # type: ignore[override]
        return C(self.re + o.re, self.im + o.im)

    def __sub__(self, o: "C") -> "C":
        return C(self.re - o.re, self.im - o.im)

    def __mul__(self, o: "C") -> "C":  # type: ignore[override]
        return C(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def conj(self) -> "C":
        return C(self.re, -self.im)

    def abs(self) -> Column:
        return F.hypot(self.re, self.im)

    def scaled(self, f: Column) -> "C":
        return C(self.re * f, self.im * f)

    def sum(self) -> "C":
        return C(F.sum(self.re), F.sum(self.im))

    def named(self, re: str = "re", im: str = "im") -> list[Column]:
        return [self.re.alias(re), self.im.alias(im)]


def of(re: str | Column, im: str | Column) -> C:
    return C(F.col(re) if isinstance(re, str) else re, F.col(im) if isinstance(im, str) else im)


def real(x: Column) -> C:
    return C(x, F.lit(0.0))


def cexp(x: C) -> C:
    return C(F.exp(x.re) * F.cos(x.im), F.exp(x.re) * F.sin(x.im))
