"""Dense block kernels: numpy on one block at a time, in Arrow batches, plus tall matrices whose rows lie in partitions.

A block is a row with `nrows`, `ncols` and a column-major payload `d`; blocks are of bounded size (leaves of a hierarchy),
so each fits a task. Tall matrices (i, row array) are reduced by TSQR or by their Gram matrix, which is small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpack(d, nrows: int, ncols: int) -> np.ndarray:
    return np.asarray(d, float).reshape((int(nrows), int(ncols)), order="F")


def pack(m: np.ndarray) -> list[float]:
    return np.asarray(m, float).ravel(order="F").tolist()


def map_blocks(blocks: DataFrame, kernel: Callable[[np.ndarray], dict], schema: str, keep: list[str]) -> DataFrame:
    """Apply a kernel to each block; it returns a dict of the columns named by schema."""
    spark_schema = ", ".join([f"{c} {dict(blocks.dtypes)[c]}" for c in keep] + [schema])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [kernel(unpack(d, n, m)) for d, n, m in zip(f.d, f.nrows, f.ncols, strict=True)]
            yield f[keep].assign(**{c: [x[c] for x in found] for c in names})

    return blocks.mapInPandas(run, spark_schema)


# ---- factorisations of one block -------------------------------------------------------------------------------------


def lu(a: np.ndarray) -> np.ndarray:
    """L (unit, below the diagonal) and U in one matrix, without pivoting; a vanishing pivot is an error."""
    a = np.array(a, complex if np.iscomplexobj(a) else float)
    tiny = np.finfo(float).eps ** 4
    for k in range(len(a)):
        if abs(a[k, k]) < tiny:
            raise ZeroDivisionError(f"pivot {k} vanishes")
        a[k + 1 :, k] /= a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a


def cholesky(a: np.ndarray, hermitian: bool = True) -> np.ndarray:
    """The lower factor of a = L L^H, or, for complex symmetric a, of a = L L^T."""
    if hermitian or not np.iscomplexobj(a):
        return np.linalg.cholesky(a)
    low = np.zeros_like(a)
    for k in range(len(a)):
        low[k, k] = np.sqrt(a[k, k] - low[k, :k] @ low[k, :k])
        low[k + 1 :, k] = (a[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
    return low


def ldl(a: np.ndarray, hermitian: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Unit lower L and diagonal d of a = L diag(d) L^H, or L^T if not hermitian."""
    n = len(a)
    low, d = np.eye(n, dtype=a.dtype), np.zeros(n, a.dtype)
    for k in range(n):
        right = low[k, :k].conj() if hermitian else low[k, :k]
        d[k] = a[k, k] - (low[k, :k] * d[:k]) @ right
        low[k + 1 :, k] = (a[k + 1 :, k] - (low[k + 1 :, :k] * d[:k]) @ right) / d[k]
    return low, d


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a x = b for one or many right-hand sides, with row pivoting."""
    return np.linalg.solve(a, np.asarray(b))


def solve_triangular(t: np.ndarray, b: np.ndarray, lower: bool = True, unit: bool = False, side: str = "left") -> np.ndarray:
    """x of t x = b, or of x t = b from the right."""
    if side == "right":
        return solve_triangular(t.T, b.T, not lower, unit).T
    t = np.tril(t) if lower else np.triu(t)
    if unit:
        t = t - np.diag(np.diag(t)) + np.eye(len(t))
    return np.linalg.solve(t, b)


def invert_triangular(t: np.ndarray, lower: bool = True, unit: bool = False) -> np.ndarray:
    return solve_triangular(t, np.eye(len(t)), lower, unit)


def qr_pivoted(a: np.ndarray, rank: Callable[[np.ndarray], int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q, r and column order with a[:, order] = q r and a falling diagonal of r; `rank` maps that diagonal to a cut."""
    a = np.array(a, complex if np.iscomplexobj(a) else float)
    n, m = a.shape
    k = min(n, m)
    order, q = np.arange(m), np.zeros((n, k), a.dtype)
    r = np.zeros((k, m), a.dtype)
    for j in range(k):
        p = j + int(np.argmax((np.abs(a[:, j:]) ** 2).sum(0)))
        for x in (a, r):
            x[:, [j, p]] = x[:, [p, j]]
        order[[j, p]] = order[[p, j]]
        norm = np.linalg.norm(a[:, j])
        if norm == 0:
            q, r = q[:, :j], r[:j]
            break
        v = a[:, j] / norm
        v -= q[:, :j] @ (q[:, :j].conj().T @ v)  # once more against the earlier ones
        q[:, j] = v / np.linalg.norm(v)
        r[j, j:] = q[:, j].conj() @ a[:, j:]
        a[:, j:] -= np.outer(q[:, j], r[j, j:])
    if rank is not None:
        cut = rank(np.abs(np.diag(r)))
        q, r = q[:, :cut], r[:cut]
    return q, r, order


def tsqr_local(a: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """QR of a tall block by halving its rows."""
    n, m = a.shape
    if n <= max(rows, 2 * m):
        return np.linalg.qr(a)
    h = n // 2
    (q0, r0), (q1, r1) = tsqr_local(a[:h], rows), tsqr_local(a[h:], rows)
    q, r = np.linalg.qr(np.vstack([r0, r1]))
    return np.vstack([q0 @ q[: len(r0)], q1 @ q[len(r0) :]]), r


def lq(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, r = np.linalg.qr(a.conj().T)
    return r.conj().T, q.conj().T


def condition(a: np.ndarray) -> float:
    """Largest over smallest non-zero singular value; 0 for a matrix without any."""
    s = np.linalg.svd(a, compute_uv=False)
    s = s[s != 0]
    return float(s[0] / s[-1]) if len(s) else 0.0


def pseudo_inverse(a: np.ndarray, rank: Callable[[np.ndarray], int] | None = None) -> np.ndarray:
    u, s, v = np.linalg.svd(a, full_matrices=False)
    k = rank(s) if rank else int((s != 0).sum())
    keep = s[:k] != 0
    return (v[:k][keep].conj().T / s[:k][keep]) @ u[:, :k][:, keep].conj().T


def eigen_hermitian(a: np.ndarray, first: int | None = None, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues ascending with eigenvectors, of all or of a closed range of them."""
    w, v = np.linalg.eigh(a)
    span = slice(first, None if last is None else last + 1)
    return w[span], v[:, span]


def eigen_tridiagonal(diag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))


# ---- the same over tables of blocks ----------------------------------------------------------------------------------


def singular_values(blocks: DataFrame, keep: list[str]) -> DataFrame:
    return map_blocks(blocks, lambda m: {"sigma": np.linalg.svd(m, compute_uv=False).tolist()}, "sigma array<double>", keep)


def condition_numbers(blocks: DataFrame, keep: list[str]) -> DataFrame:
    return map_blocks(blocks, lambda m: {"cond": condition(m)}, "cond double", keep)


def inverted(blocks: DataFrame, keep: list[str]) -> DataFrame:
    return map_blocks(blocks, lambda m: {"d": pack(np.linalg.inv(m))}, "d array<double>", keep)


def lu_factors(blocks: DataFrame, keep: list[str]) -> DataFrame:
    return map_blocks(blocks, lambda m: {"d": pack(lu(m))}, "d array<double>", keep)


def cholesky_factors(blocks: DataFrame, keep: list[str]) -> DataFrame:
    return map_blocks(blocks, lambda m: {"d": pack(cholesky(m))}, "d array<double>", keep)


def to_coo(blocks: DataFrame) -> DataFrame:
    """Entries (i, j, v) of dense blocks with row_first and col_first."""
    e = blocks.select("row_first", "col_first", "nrows", F.posexplode("d").alias("p", "v"))
    return e.select((F.col("row_first") + F.col("p") % F.col("nrows")).alias("i"), (F.col("col_first") + F.floor(F.col("p") / F.col("nrows"))).alias("j"), "v")


def from_coo(a: DataFrame, size: int) -> DataFrame:
    """Square tiles of a matrix as dense blocks (block rows bi, columns bj); absent entries are 0."""
    tiled = a.withColumns({"bi": F.floor(F.col("i") / size), "bj": F.floor(F.col("j") / size)})
    own = tiled.select("bi", "bj", ((F.col("j") % size) * size + F.col("i") % size).cast("int").alias("p"), "v")
    entries = own.groupBy("bi", "bj").agg(F.map_from_entries(F.collect_list(F.struct("p", "v"))).alias("e"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda p: F.coalesce(F.try_element_at("e", p), F.lit(0.0)))
    return entries.select("bi", "bj", (F.col("bi") * size).alias("row_first"), (F.col("bj") * size).alias("col_first"), F.lit(size).alias("nrows"), F.lit(size).alias("ncols"), cells.alias("d"))


# ---- tall matrices ---------------------------------------------------------------------------------------------------


def gram(rows: DataFrame, column: str) -> DataFrame:
    """(i, j, v) of R^T R for one array column: one product of matrices a task, then sums of d*d partial entries."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
                x = flat.reshape(batch.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = (k.ravel() for k in np.indices(total.shape))
            yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    return rows.where(F.col(column).isNotNull()).select(column).mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def tall_r(rows: DataFrame, column: str) -> np.ndarray:
    """R of the QR factorisation of a tall matrix: local QR in each partition, then of the stacked triangles, by levels.

    Each level stacks a bounded number of m x m triangles in a task, so no task or driver holds more than that.
    """
    schema = "part long, r array<array<double>>"

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        r = None
        for f in frames:
            if len(f):
                x = np.stack(f[column].map(np.asarray)).astype(float)
                r = np.linalg.qr(x if r is None else np.vstack([r, x]), mode="r")
        if r is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [[row.tolist() for row in r]]})

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.array([np.asarray(row) for row in r]) for r in f.r])
        return pd.DataFrame({"part": [int(f.part.iloc[0]) // 16], "r": [[row.tolist() for row in np.linalg.qr(stacked, mode="r")]]})

    level = rows.select(column).mapInPandas(local, schema)
    parts = rows.rdd.getNumPartitions()
    while parts > 16:
        level = level.groupBy(F.floor(F.col("part") / 16)).applyInPandas(merge, schema)
        parts = -(-parts // 16)
    found = [np.array([np.asarray(row) for row in x["r"]]) for x in level.collect()]
    if not found:
        return np.zeros((0, 0))
    r = np.linalg.qr(np.vstack(found), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[: len(r), None]


def tall_singular_values(rows: DataFrame, column: str) -> np.ndarray:
    return np.linalg.svd(tall_r(rows, column), compute_uv=False)


def tall_orthogonal(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, q): the rows of Q = A R^-1, row by row."""
    inverse = np.linalg.pinv(tall_r(rows, column))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                q = np.stack(f[column].map(np.asarray)).astype(float) @ inverse
                yield pd.DataFrame({key: f[key], "q": list(q)})

    return rows.select(key, column).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, q array<double>")
