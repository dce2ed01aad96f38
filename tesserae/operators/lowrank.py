"""Truncation accuracies and low-rank blocks m = a b^H, kept as column-major factors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .dense import pack, qr_pivoted, unpack

MACHINE = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Accuracy:
    """How many singular values to keep. `rank` 0 and `most` None mean no bound; norm is 'spectral' or 'frobenius'."""

    relative: float = 0.0
    absolute: float = 0.0
    rank: int = 0
    most: int | None = None
    norm: str = "spectral"

    def cut(self, sigma: np.ndarray) -> int:
        """The rank kept for descending singular values."""
        sigma = np.asarray(sigma, float)
        if not len(sigma) or sigma[0] == 0:
            return 0
        k = len(sigma)
        if self.rank:
            k = min(k, self.rank)
        if self.most is not None:
            k = min(k, self.most)
        if self.norm == "frobenius":
            bound = max(self.relative * float(np.sqrt((sigma**2).sum())), self.absolute)
            rest = 0.0
            while k > 0 and np.sqrt(rest + sigma[k - 1] ** 2) <= bound:
                rest += sigma[k - 1] ** 2
                k -= 1
            return k
        bound = MACHINE * sigma[0] if self.rank else max(self.relative * sigma[0], self.absolute)
        small = np.flatnonzero(sigma[:k] < bound)
        return int(small[0]) if len(small) else k


def fixed_rank(k: int) -> Accuracy:
    return Accuracy(rank=k)


def fixed_precision(eps: float, absolute: float = 0.0) -> Accuracy:
    return Accuracy(relative=eps, absolute=absolute)


relative_precision = fixed_precision


def absolute_precision(eps: float) -> Accuracy:
    return Accuracy(absolute=eps)


EXACT, MACHINE_PRECISION = Accuracy(), Accuracy(relative=MACHINE)

Factors = tuple[np.ndarray, np.ndarray]


def _folded(u: np.ndarray, s: np.ndarray, v: np.ndarray) -> Factors:
    """The singular values go to the shorter side."""
    return (u * s, v) if len(u) < len(v) else (u, v * s)


def approx_svd(m: np.ndarray, acc: Accuracy) -> Factors:
    u, s, vh = np.linalg.svd(m, full_matrices=False)
    k = acc.cut(s)
    return _folded(u[:, :k], s[:k], vh[:k].conj().T)


def approx_rrqr(m: np.ndarray, acc: Accuracy) -> Factors:
    """By pivoted QR, whose diagonal stands for the singular values."""
    if m.shape[0] < m.shape[1]:
        b, a = approx_rrqr(m.conj().T, acc)
        return a, b
    q, r, order = qr_pivoted(m, acc.cut)
    b = np.zeros((m.shape[1], len(r)), r.dtype)
    b[order] = r.conj().T
    return q, b


def column_basis(m: np.ndarray, acc: Accuracy, block: int = 8, seed: int = 0) -> np.ndarray:
    """An orthonormal basis of the range up to the accuracy, grown by random samples of a block of columns."""
    rng, (n, cols) = np.random.default_rng(seed), m.shape
    q, rest = np.zeros((n, 0), m.dtype), np.array(m)
    norm = np.linalg.norm(m)
    limit = min(n, cols, acc.rank or n, n if acc.most is None else acc.most)
    while q.shape[1] < limit:
        if np.linalg.norm(rest) <= max(acc.relative * norm, acc.absolute, MACHINE * norm) / 10:
            break
        x, _ = np.linalg.qr(rest @ rng.standard_normal((cols, min(block, limit - q.shape[1]))))
        x -= q @ (q.conj().T @ x)
        x, _ = np.linalg.qr(x)
        q, rest = np.hstack([q, x]), rest - x @ (x.conj().T @ rest)
    return q


def approx_random(m: np.ndarray, acc: Accuracy, seed: int = 0) -> Factors:
    wide = Accuracy(acc.relative, acc.absolute, acc.rank + 8 if acc.rank else 0, acc.most, acc.norm)
    q = column_basis(m, wide, seed=seed)
    a, b = approx_svd(q.conj().T @ m, acc)
    return q @ a, b


def truncate_svd(a: np.ndarray, b: np.ndarray, acc: Accuracy) -> Factors:
    """Recompress a b^H by QR of both factors and an SVD of the small product."""
    used = (np.abs(a).sum(0) != 0) & (np.abs(b).sum(0) != 0)
    a, b = a[:, used], b[:, used]
    k = a.shape[1]
    if k == 0 or (acc.rank and k <= acc.rank):
        return a, b
    if k >= min(len(a), len(b)):
        return approx_svd(a @ b.conj().T, acc)
    (qa, ra), (qb, rb) = np.linalg.qr(a), np.linalg.qr(b)
    u, s, vh = np.linalg.svd(ra @ rb.conj().T)
    k = acc.cut(s)
    return _folded(qa @ u[:, :k], s[:k], qb @ vh[:k].conj().T)


def truncate_rrqr(a: np.ndarray, b: np.ndarray, acc: Accuracy) -> Factors:
    if a.shape[1] >= min(len(a), len(b)):
        return approx_rrqr(a @ b.conj().T, acc)
    qb, rb = np.linalg.qr(b)
    x, y = approx_rrqr(a @ rb.conj().T, acc)
    return x, qb @ y


def truncate_random(a: np.ndarray, b: np.ndarray, acc: Accuracy) -> Factors:
    if a.shape[1] >= min(len(a), len(b)):
        return approx_random(a @ b.conj().T, acc)
    qb, rb = np.linalg.qr(b)
    x, y = approx_random(a @ rb.conj().T, acc)
    return x, qb @ y


APPROX: dict[str, Callable[[np.ndarray, Accuracy], Factors]] = {"svd": approx_svd, "rrqr": approx_rrqr, "random": approx_random}
TRUNCATE: dict[str, Callable[[np.ndarray, np.ndarray, Accuracy], Factors]] = {"svd": truncate_svd, "rrqr": truncate_rrqr, "random": truncate_random}


def add_rank(a: np.ndarray, b: np.ndarray, alpha: complex, x: np.ndarray, y: np.ndarray, acc: Accuracy | None = None, method: str = "svd") -> Factors:
    """a b^H + alpha x y^H: the factors side by side, recompressed if an accuracy is given."""
    left, right = np.hstack([a, alpha * x]), np.hstack([b, y])
    return TRUNCATE[method](left, right, acc) if acc else (left, right)


def add_dense(a: np.ndarray, b: np.ndarray, alpha: complex, d: np.ndarray, acc: Accuracy, method: str = "svd") -> Factors:
    return APPROX[method](a @ b.conj().T + alpha * d, acc)


def from_dense(d: np.ndarray, acc: Accuracy | None = None, method: str = "svd") -> Factors:
    """Exact without an accuracy: the identity stands for the smaller side."""
    if acc is not None:
        return APPROX[method](d, acc)
    n, m = d.shape
    return (np.eye(n), d.conj().T) if n <= m else (d, np.eye(m))


def frobenius(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(max(0.0, np.sum((a.conj().T @ a) * (b.conj().T @ b).conj()).real)))


def singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Those of a b^H, from the triangles of both factors."""
    return np.linalg.svd(np.linalg.qr(a, mode="r") @ np.linalg.qr(b, mode="r").conj().T, compute_uv=False)


def compress_blocks(blocks: DataFrame, acc: Accuracy, keep: list[str], method: str = "svd") -> DataFrame:
    """Dense blocks (nrows, ncols, d) to low-rank ones: keep, nrows, ncols, rank, a, b, and the Frobenius error."""
    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", nrows long, ncols long, rank int, a array<double>, b array<double>, error double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, n, m in zip(f.d, f.nrows, f.ncols, strict=True):
                x = unpack(d, n, m)
                a, b = APPROX[method](x, acc)
                rows.append((n, m, a.shape[1], pack(a), pack(b), float(np.linalg.norm(x - a @ b.T))))
            yield f[keep].reset_index(drop=True).join(pd.DataFrame(rows, columns=["nrows", "ncols", "rank", "a", "b", "error"]))

    return blocks.mapInPandas(run, schema)


def truncate_blocks(blocks: DataFrame, acc: Accuracy, keep: list[str], method: str = "svd") -> DataFrame:
    """Low-rank blocks (nrows, ncols, rank, a, b) recompressed."""
    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", nrows long, ncols long, rank int, a array<double>, b array<double>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for a, b, n, m, k in zip(f.a, f.b, f.nrows, f.ncols, f["rank"], strict=True):
                x, y = TRUNCATE[method](unpack(a, n, k), unpack(b, m, k), acc)
                rows.append((n, m, x.shape[1], pack(x), pack(y)))
            yield f[keep].reset_index(drop=True).join(pd.DataFrame(rows, columns=["nrows", "ncols", "rank", "a", "b"]))

    return blocks.mapInPandas(run, schema)
