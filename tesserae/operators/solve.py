"""Krylov and stationary solvers as driver loops over distributed vectors.

A is a lazy operator (plans.linop); vectors are (i, v). Each step fuses its dot products into one aggregation where it
can, and checkpoints the vectors it carries, so lineage doesn't grow and a lost executor costs one step at most. Only
scalars reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.linop import Operator
from . import coo, vector
from .iterate import settled


@dataclass
class Stop:
    """Stopping criteria; they combine by +, the stricter of each."""

    steps: int = 100
    relative: float = 1e-8
    absolute: float = 1e-14
    growth: float = 1e6

    def __add__(self, o: "Stop") -> "Stop":
        return Stop(max(self.steps, o.steps), min(self.relative, o.relative), min(self.absolute, o.absolute), max(self.growth, o.growth))


def max_steps(n: int) -> Stop:
    return Stop(n, 0.0, 0.0)


def relative_reduction(eps: float) -> Stop:
    return Stop(relative=eps, absolute=0.0)


def absolute_reduction(eps: float) -> Stop:
    return Stop(relative=0.0, absolute=eps)


@dataclass
class Info:
    """How a solve went: status 'iterating' (out of steps), 'converged', 'diverged' or 'failed', and all residual norms."""

    stop: Stop = field(default_factory=Stop)
    history: list[float] = field(default_factory=list)
    status: str = "iterating"

    @property
    def steps(self) -> int:
        return len(self.history) - 1

    @property
    def rate(self) -> float:
        h = self.history
        return (h[-1] / h[0]) ** (1 / (len(h) - 1)) if len(h) > 1 and h[0] > 0 else 0.0

    def done(self, residual: float) -> bool:
        self.history.append(residual)
        first = self.history[0]
        if self.steps >= self.stop.steps:
            return True
        if residual < self.stop.absolute or residual < self.stop.relative * first:
            self.status = "converged"
            return True
        if residual > self.stop.growth * first:
            self.status = "diverged"
            return True
        return False

    def failed(self) -> None:
        self.status = "failed"

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(n, r) for n, r in enumerate(self.history)], "it int, res double")

    def gnuplot(self) -> str:
        return "".join(f"{n} {r:.12e}\n" for n, r in enumerate(self.history))

    def __str__(self) -> str:
        return f"{self.status} after {self.steps} steps, rate {self.rate:.3e}, residual {self.history[-1] if self.history else 0:.3e}"


Weighted = tuple[float, DataFrame]


def combine(*terms: Weighted) -> DataFrame:
    """The sum of scaled vectors by one aggregation, written."""
    parts = [x.select("i", (F.lit(float(f)) * F.col("v")).alias("v")) for f, x in terms if f != 0]
    if not parts:
        return settled(terms[0][1].select("i", F.lit(0.0).alias("v")))
    return settled(reduce(lambda a, b: a.unionByName(b), parts).groupBy("i").agg(F.sum("v").alias("v")))


def dots(*pairs: tuple[DataFrame, DataFrame]) -> list[float]:
    """Several dot products in one job."""
    out = None
    for n, (x, y) in enumerate(pairs):
        row = (x.select((F.col("v") * F.col("v")).alias("p")) if x is y else x.alias("x").join(y.alias("y"), "i").select((F.col("x.v") * F.col("y.v")).alias("p"))).agg(F.lit(n).alias("n"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("v"))
        out = row if out is None else out.unionByName(row)
    found = {r["n"]: r["v"] for r in out.collect()}
    return [found[n] for n in range(len(pairs))]


def norm(x: DataFrame) -> float:
    return dots((x, x))[0] ** 0.5


def _prepared(w: Operator | None, x: DataFrame) -> DataFrame:
    return x if w is None else settled(w.apply(x))


def _start(b: DataFrame, w: Operator | None, x0: DataFrame | None) -> DataFrame:
    return settled(x0) if x0 is not None else _prepared(w, settled(b))


def _residual(a: Operator, x: DataFrame, b: DataFrame) -> DataFrame:
    return combine((1.0, b), (-1.0, a.apply(x)))


def linear_iteration(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None, damping: float = 1.0) -> tuple[DataFrame, Info]:
    """x -= damping * W (A x - b); Richardson's iteration for W = I. At least one step is made."""
    info, x = Info(stop or Stop()), _start(b, w, x0)
    r = _residual(a, x, b)
    info.history.append(norm(r))
    while True:
        x = combine((1.0, x), (damping, _prepared(w, r)))
        r = _residual(a, x, b)
        if info.done(norm(r)):
            return x, info


def cg(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None) -> tuple[DataFrame, Info]:
    """Conjugate gradients, preconditioned by W."""
    info, x = Info(stop or Stop()), _start(b, w, x0)
    r = _residual(a, x, b)
    q = _prepared(w, r)
    p, (rho, rr) = q, dots((r, q), (r, r))
    if info.done(rr**0.5):
        return x, info
    while True:
        ap = settled(a.apply(p))
        (pap,) = dots((p, ap))
        if pap == 0:
            info.failed()
            return x, info
        alpha = rho / pap
        x, r = combine((1.0, x), (alpha, p)), combine((1.0, r), (-alpha, ap))
        q = _prepared(w, r)
        new, rr = dots((r, q), (r, r))
        if info.done(rr**0.5):
            return x, info
        p, rho = combine((1.0, q), (new / rho, p)), new


def cgs(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None) -> tuple[DataFrame, Info]:
    """Conjugate gradients squared."""
    info, x = Info(stop or Stop()), _start(b, w, x0)
    r = _residual(a, x, b)
    if info.done(norm(r)):
        return x, info
    r0, p, u = r, r, r
    (rho,) = dots((r0, r))
    while True:
        v = settled(a.apply(_prepared(w, p)))
        (sigma,) = dots((r0, v))
        if sigma == 0:
            info.failed()
            return x, info
        alpha = rho / sigma
        t = combine((1.0, u), (-alpha, v))
        y = _prepared(w, combine((1.0, u), (1.0, t)))
        x, r = combine((1.0, x), (alpha, y)), combine((1.0, r), (-alpha, a.apply(y)))
        new, rr = dots((r0, r), (r, r))
        if info.done(rr**0.5):
            return x, info
        beta, rho = new / rho, new
        u = combine((1.0, r), (beta, t))
        p = combine((1.0, u), (beta, t), (beta * beta, p))


def bicgstab(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None) -> tuple[DataFrame, Info]:
    """Stabilised bi-conjugate gradients, with a stopping test in the middle of a step too."""
    tiny = np.finfo(float).eps ** 2
    info, x = Info(stop or Stop()), _start(b, w, x0)
    r = _residual(a, x, b)
    if info.done(norm(r)):
        return x, info
    r0, p = r, r
    (rho,) = dots((r0, r))
    while True:
        pw = _prepared(w, p)
        ap = settled(a.apply(pw))
        (d,) = dots((r0, ap))
        if abs(d) < tiny or abs(rho) < tiny:
            info.failed()
            return x, info
        alpha = rho / d
        s = combine((1.0, r), (-alpha, ap))
        if info.done(norm(s)):
            return combine((1.0, x), (alpha, pw)), info
        sw = _prepared(w, s)
        t = settled(a.apply(sw))
        ts, tt = dots((t, s), (t, t))
        omega = ts / tt if tt else 0.0
        if abs(omega) < tiny:
            info.failed()
            return combine((1.0, x), (alpha, pw)), info
        x, r = combine((1.0, x), (alpha, pw), (omega, sw)), combine((1.0, s), (-omega, t))
        new, rr = dots((r0, r), (r, r))
        if info.done(rr**0.5):
            return x, info
        p, rho = combine((1.0, r), (new / rho * alpha / omega, p), (-new / rho * alpha, ap)), new


def minres(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None) -> tuple[DataFrame, Info]:
    """Minimal residuals for self-adjoint A (and W, positive): Lanczos with rotations."""
    info, x = Info(stop or Stop()), _start(b, w, x0)
    v = _residual(a, x, b)
    z = _prepared(w, v)
    gamma = max(0.0, dots((z, v))[0]) ** 0.5
    eta, s0, s1, c0, c1 = gamma, 0.0, 0.0, 1.0, 1.0
    if info.done(gamma):
        return x, info
    old_v, old_gamma = None, 1.0
    w0 = w1 = None
    while True:
        z = combine((1 / gamma, z))
        az = settled(a.apply(z))
        (delta,) = dots((az, z))
        terms = [(1.0, az), (-delta / gamma, v)]
        if old_v is not None:
            terms.append((-gamma / old_gamma, old_v))
        new_v = combine(*terms)
        new_z = _prepared(w, new_v)
        new_gamma = max(0.0, dots((new_z, new_v))[0]) ** 0.5
        a0, a1 = c1 * delta - c0 * s1 * gamma, 0.0
        a1 = (a0 * a0 + new_gamma * new_gamma) ** 0.5
        a2, a3 = s1 * delta + c0 * c1 * gamma, s0 * gamma
        if a1 == 0:
            info.failed()
            return x, info
        c0, c1, s0, s1 = c1, a0 / a1, s1, new_gamma / a1
        terms = [(1 / a1, z)]
        terms += [(-a3 / a1, w0)] if w0 is not None else []
        terms += [(-a2 / a1, w1)] if w1 is not None else []
        w0, w1 = w1, combine(*terms)
        x, eta = combine((1.0, x), (c1 * eta, w1)), -s1 * eta
        if info.done(abs(eta)):
            return x, info
        if new_gamma == 0:
            info.status = "converged"
            return x, info
        old_v, v, z, old_gamma, gamma = v, new_v, new_z, gamma, new_gamma


def gmres(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None, restart: int = 20) -> tuple[DataFrame, Info]:
    """Restarted GMRES (preconditioned from the left): modified Gram-Schmidt, the small Hessenberg matrix on the driver."""
    info, x = Info(stop or Stop()), _start(b, w, x0)
    while True:
        r = _prepared(w, _residual(a, x, b))
        beta = norm(r)
        if (not info.history and info.done(beta)) or beta == 0:
            info.status = "converged" if beta == 0 else info.status
            return x, info
        basis = [combine((1 / beta, r))]
        h, g = np.zeros((restart + 1, restart)), np.zeros(restart + 1)
        g[0], turns, over = beta, [], False
        for j in range(restart):
            v = _prepared(w, settled(a.apply(basis[j])))
            for i in range(j + 1):
                h[i, j] = dots((basis[i], v))[0]
                v = combine((1.0, v), (-h[i, j], basis[i]))
            h[j + 1, j] = norm(v)
            below = h[j + 1, j]
            for i, (c, s) in enumerate(turns):
                h[i, j], h[i + 1, j] = c * h[i, j] + s * h[i + 1, j], -s * h[i, j] + c * h[i + 1, j]
            d = np.hypot(h[j, j], h[j + 1, j])
            c, s = (h[j, j] / d, h[j + 1, j] / d) if d else (1.0, 0.0)
            turns.append((c, s))
            h[j, j], h[j + 1, j], g[j], g[j + 1] = d, 0.0, c * g[j], -s * g[j]
            over = info.done(abs(g[j + 1]))
            if over or below <= 1e-14 * beta:
                break
            basis.append(combine((1 / below, v)))
        k = len(turns)
        y = np.linalg.lstsq(h[:k, :k], g[:k], rcond=None)[0]
        x = combine((1.0, x), *[(float(c), v) for c, v in zip(y, basis, strict=False)])
        if over:
            return x, info


def tfqmr(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None) -> tuple[DataFrame, Info]:
    """Transpose-free quasi-minimal residuals; the norm reported is the quasi-residual's bound."""
    info, x = Info(stop or Stop()), _start(b, w, x0)
    r = _prepared(w, _residual(a, x, b))
    tau = norm(r)
    if info.done(tau):
        return x, info
    op = lambda z: _prepared(w, settled(a.apply(z)))
    r0 = y = z = r
    v = u = op(y)
    d, theta, eta = None, 0.0, 0.0
    (rho,) = dots((r0, r))
    m = 0
    while True:
        (sigma,) = dots((r0, v))
        if sigma == 0 or rho == 0:
            info.failed()
            return x, info
        alpha = rho / sigma
        y2 = combine((1.0, y), (-alpha, v))
        u2 = op(y2)
        for yy, uu in ((y, u), (y2, u2)):
            m += 1
            z = combine((1.0, z), (-alpha, uu))
            d = combine((1.0, yy), (theta * theta * eta / alpha, d)) if d is not None else yy
            theta = norm(z) / tau
            c = 1 / (1 + theta * theta) ** 0.5
            tau, eta = tau * theta * c, c * c * alpha
            x = combine((1.0, x), (eta, d))
            if info.done(tau * (m + 1) ** 0.5):
                return x, info
        (new,) = dots((r0, z))
        beta, rho = new / rho, new
        y = combine((1.0, z), (beta, y2))
        u3 = op(y)
        v, u = combine((1.0, u3), (beta, u2), (beta * beta, v)), u3


def kaczmarz(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None) -> tuple[DataFrame, Info]:
    """Cyclic column relaxation: x_i -= <r, a_i> / <a_i, a_i> with a_i = W A e_i, the columns in the order of indices.

    Sequential by nature, so a sweep runs in one task, over the columns as they stream by in order; between sweeps x and
    the residual are tables. A must be a coordinate matrix (of any number of entries), or a sum of such and of products of
    two vectors, and x must fit one task. Products of vectors are never formed: a column is its entries and a factor for
    each product's left vector u, and what a step needs of these are the dots <r, u>, which are carried along.
    """
    from ..plans import linop

    info, x = Info(stop or Stop()), _start(b, w, x0)
    entries, products = _parts(a)
    if w is not None:  # the columns of W A
        if not isinstance(w, linop.Matrix):
            raise TypeError("the preconditioner must be a coordinate matrix too")
        entries = coo.matmul(w.entries, entries)
    products = [(_prepared(w, u), y) for u, y in products]
    us = [u for u, _ in products]
    pairs = [(k, m) for k in range(len(us)) for m in range(k, len(us))]
    gram = np.zeros((len(us), len(us)))
    for (k, m), v in zip(pairs, dots(*[(us[k], us[m]) for k, m in pairs]) if pairs else [], strict=True):
        gram[k, m] = gram[m, k] = v
    zero = F.lit(0.0)
    for k, u in enumerate(us):
        entries = entries.join(u.select("i", F.col("v").alias(f"u{k}")), "i", "left")
    at = lambda k: F.coalesce(F.sum(F.col("v") * F.coalesce(f"u{k}", zero)), zero).alias(f"s{k}")
    columns = entries.groupBy("j").agg(F.collect_list("i").alias("rows"), F.collect_list("v").alias("values"), F.collect_list(F.array(*[F.coalesce(f"u{k}", zero) for k in range(len(us))]).cast("array<double>")).alias("lefts"), *[at(k) for k in range(len(us))])
    for k, (_, y) in enumerate(products):
        columns = columns.join(y.where("v != 0").select(F.col("i").alias("j"), F.col("v").alias(f"f{k}")), "j", "full")
    numbers = [F.array(*[F.coalesce(f"{c}{k}", zero) for k in range(len(us))]).cast("array<double>").alias(name) for c, name in (("s", "with_lefts"), ("f", "factors"))]
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    columns = columns.select("j", empty("rows", "long"), empty("values", "double"), F.flatten(empty("lefts", "array<double>")).alias("lefts"), *numbers)
    columns = settled(columns.repartitionByRange(1, "j").sortWithinPartitions("j"))
    while True:
        left = _residual(a, x, b)
        if info.done(norm(left)):
            return x, info
        r = combine((-1.0, _prepared(w, left)))
        begin = r.select("i", "v").unionByName(x.select((-F.col("i") - 1).alias("i"), "v"))  # x under negative indices
        lead = begin.agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("state"))
        ru = np.array(dots(*[(r, u) for u in us]) if us else [])

        def sweep(frames, ru=ru):
            # r is `state` at its indices and moved * u for each product; rg are its dots with all u
            state, rg, moved = None, ru.copy(), np.zeros(len(ru))
            for f in frames:
                for j, rows, values, lefts, su, factors, given in zip(f.j, f.rows, f["values"], f.lefts, f.with_lefts, f.factors, f.state, strict=True):
                    if given is not None:
                        state = dict(given)
                        continue
                    rows, values, su, factors = [int(k) for k in rows], np.asarray(values, float), np.asarray(su, float), np.asarray(factors, float)
                    lefts = np.asarray(lefts, float).reshape(len(rows), len(ru))
                    aa = float(values @ values + 2 * (factors @ su) + factors @ gram @ factors)
                    if not aa:
                        continue
                    here = np.array([state.get(k, 0.0) for k in rows]) + lefts @ moved
                    step = -float(values @ here + factors @ rg) / aa
                    for k, v in zip(rows, values, strict=True):
                        state[k] = state.get(k, 0.0) + step * v
                    moved += step * factors
                    rg += step * (su + gram @ factors)
                    state[-int(j) - 1] = state.get(-int(j) - 1, 0.0) + step
            if state:
                new = [(-k - 1, v) for k, v in state.items() if k < 0]
                yield pd.DataFrame(new, columns=["i", "v"])

        none = F.lit(None)
        kinds = {"j": "long", "rows": "array<long>", "values": "array<double>", "lefts": "array<double>", "with_lefts": "array<double>", "factors": "array<double>"}
        rows_ = lead.select(*[none.cast(kind).alias(c) for c, kind in kinds.items()], "state").unionByName(columns.withColumn("state", none.cast("map<bigint,double>")))
        ordered = rows_.coalesce(1).sortWithinPartitions(F.col("j").asc_nulls_first())
        x = settled(ordered.mapInPandas(sweep, "i long, v double"))


def _parts(a: Operator) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The entries of a, and its products u y^T as pairs of vectors."""
    from ..plans import linop

    entries, products = [], []
    for f, op, t in a.terms if isinstance(a, linop.Sum) else [(1.0, coo.NORMAL, a)]:
        if isinstance(t, linop.Matrix):
            entries.append(coo.scale(f, coo.apply_op(t.entries, op)).select("i", "j", "v"))
        elif isinstance(t, linop.Rank1):
            u, y = (t.x, t.y) if op in (coo.NORMAL, coo.CONJUGATE) else (t.y, t.x)
            products.append((u.select("i", "v"), y.select("i", (F.lit(float(f * t.alpha)) * F.col("v")).alias("v"))))
        else:
            raise TypeError("column relaxation needs the columns of coordinate matrices and products of vectors")
    if not entries:
        entries = [products[0][0].where("false").select("i", F.col("i").alias("j"), "v")]
    if len(entries) == 1:
        return entries[0], products
    return reduce(lambda p, q: p.unionByName(q), entries).groupBy("i", "j").agg(F.sum("v").alias("v")), products


def auto(a: Operator, b: DataFrame, w: Operator | None = None, stop: Stop | None = None, x0: DataFrame | None = None) -> tuple[DataFrame, Info]:
    """MINRES if A (and W) are self-adjoint, else GMRES."""
    return (minres if a.is_self_adjoint() and (w is None or w.is_self_adjoint()) else gmres)(a, b, w, stop, x0)


def jacobi(diagonal: DataFrame, n: int) -> Operator:
    """The inverse of a diagonal as a preconditioner."""
    from ..plans import linop

    return linop.diagonal(diagonal.select("i", (1 / F.col("v")).alias("v")), n)


SOLVERS = {"linear": linear_iteration, "richardson": linear_iteration, "cg": cg, "cgs": cgs, "bicgstab": bicgstab, "minres": minres, "gmres": gmres, "tfqmr": tfqmr, "kaczmarz": kaczmarz, "auto": auto}
__all__ = ["SOLVERS", "Info", "Stop", "vector"]
