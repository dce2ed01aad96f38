"""Block and hierarchical matrices: one row a block, its structure relational, its payload an array.

Kinds: 'blocked' (has sub-blocks), 'dense' (payload d), 'rk' (factors a, b and rank), 'zero', 'sparse', 'ghost'. For the
forms 'symmetric' and 'hermitian' only blocks on and below the diagonal are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import coo, vector


def nrows() -> Column:
    return F.col("row_last") - F.col("row_first") + 1


def ncols() -> Column:
    return F.col("col_last") - F.col("col_first") + 1


def dense_entries(blocks: DataFrame) -> DataFrame:
    """(block_id, i, j, v) of dense blocks."""
    e = blocks.where("kind = 'dense'").select("block_id", "row_first", "col_first", nrows().alias("n"), F.posexplode("d").alias("p", "v"))
    return e.select("block_id", (F.col("row_first") + F.col("p") % F.col("n")).alias("i"), (F.col("col_first") + F.floor(F.col("p") / F.col("n"))).alias("j"), "v")


def factor_entries(blocks: DataFrame, side: str) -> DataFrame:
    """(block_id, row_first, i, k, v) of the factor 'a' (by row index) or 'b' (by column index) of low-rank blocks. A
    mirrored block shares its id with its original, so row_first tells them apart."""
    first, n = ("row_first", nrows()) if side == "a" else ("col_first", ncols())
    e = blocks.where("kind = 'rk'").select("block_id", "row_first", F.col(first).alias("first"), n.alias("n"), F.posexplode(side).alias("p", "v"))
    return e.select("block_id", "row_first", (F.col("first") + F.col("p") % F.col("n")).alias("i"), F.floor(F.col("p") / F.col("n")).alias("k"), "v")


def to_coo(blocks: DataFrame) -> DataFrame:
    """All entries of the leaves of an unsymmetric matrix, low-rank ones multiplied out."""
    a, b = factor_entries(blocks, "a"), factor_entries(blocks, "b")
    rk = a.alias("a").join(b.alias("b"), ["block_id", "row_first", "k"]).groupBy("block_id", "row_first", F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))
    return dense_entries(blocks).unionByName(rk.drop("row_first")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def mirrored(blocks: DataFrame) -> DataFrame:
    """The blocks of a symmetric matrix with those above the diagonal added; unsymmetric blocks stay alone."""
    over = blocks.where("form <> 'unsymmetric' and (row_first <> col_first or row_last <> col_last)")
    flipped = over.select(
        F.col("block_id"), "parent_id", F.col("bj").alias("bi"), F.col("bi").alias("bj"), "lvl",
        F.col("col_first").alias("row_first"), F.col("col_last").alias("row_last"), F.col("row_first").alias("col_first"), F.col("row_last").alias("col_last"),
        "kind", "form", "rank", transposed_payload().alias("d"), F.col("b").alias("a"), F.col("a").alias("b"),
    )
    return blocks.unionByName(flipped)


def transposed_payload() -> Column:
    """The column-major payload of the transposed block."""
    n, m = nrows().cast("int"), ncols().cast("int")
    return F.when(F.col("d").isNotNull(), F.transform(F.sequence(F.lit(0), n * m - 1), lambda p: F.get("d", (p % m) * n + F.floor(p / m).cast("int"))))


def transposed(blocks: DataFrame) -> DataFrame:
    return blocks.select(
        "block_id", "parent_id", F.col("bj").alias("bi"), F.col("bi").alias("bj"), "lvl",
        F.col("col_first").alias("row_first"), F.col("col_last").alias("row_last"), F.col("row_first").alias("col_first"), F.col("row_last").alias("col_last"),
        "kind", "form", "rank", transposed_payload().alias("d"), F.col("b").alias("a"), F.col("a").alias("b"),
    )


def mul_vec(blocks: DataFrame, x: DataFrame, alpha: float = 1.0, beta: float = 0.0, y: DataFrame | None = None, transpose: bool = False) -> DataFrame:
    """alpha * A x + beta * y over all leaves: dense ones entry by entry, low-rank ones over their rank index."""
    every = mirrored(blocks)
    every = transposed(every) if transpose else every
    d = dense_entries(every).alias("d").join(x.alias("x"), F.col("d.j") == F.col("x.i")).groupBy(F.col("d.i").alias("i")).agg(F.sum(F.col("d.v") * F.col("x.v")).alias("v"))
    a, b = factor_entries(every, "a"), factor_entries(every, "b")
    t = b.alias("b").join(x.alias("x"), F.col("b.i") == F.col("x.i")).groupBy("block_id", "row_first", "k").agg(F.sum(F.col("b.v") * F.col("x.v")).alias("t"))
    r = a.join(t, ["block_id", "row_first", "k"]).groupBy("i").agg(F.sum(F.col("v") * F.col("t")).alias("v"))
    out = vector.scale(alpha, d.unionByName(r).groupBy("i").agg(F.sum("v").alias("v")))
    return vector.add(beta, y, out) if beta and y is not None else out


def matmul(a: DataFrame, b: DataFrame, alpha: float = 1.0) -> DataFrame:
    """alpha * a b as coordinates (i, j, v), for leaves of unsymmetric matrices with fitting inner ranges.

    Dense leaves enter by their entries. A low-rank leaf u v^T enters through its factors: with index p of its rank, the
    product takes v^T b or a u first, so no low-rank leaf is multiplied out before the product.
    """
    da, db = dense_entries(a).select("i", "j", "v"), dense_entries(b).select("i", "j", "v")
    # a rank index of a leaf is an inner index of its own: (block_id, row_first, k)
    rank = F.struct("block_id", "row_first", "k")
    u, v = ({s: factor_entries(x, s).select(F.col("i").alias("x"), rank.alias("p"), "v") for s in "ab"} for x in (a, b))

    def inner(x: DataFrame, y: DataFrame, on: str, keep: list[str]) -> DataFrame:
        both = x.withColumnRenamed("v", "vx").join(y.withColumnRenamed("v", "vy"), on)
        return both.groupBy(*keep).agg(F.sum(F.col("vx") * F.col("vy")).alias("v"))

    left, right = da.withColumnRenamed("j", "m"), db.withColumnRenamed("i", "m")
    parts = [inner(left, right, "m", ["i", "j"])]
    # rank rows of a with all of b: first v^T b as (p, j), then u
    pa = u["b"].withColumnRenamed("x", "m")
    pb = v["a"].withColumnRenamed("x", "m")
    ab = inner(pa, right, "m", ["p", "j"])
    parts.append(inner(u["a"].withColumnRenamed("x", "i"), ab, "p", ["i", "j"]))
    # dense a with rank rows of b: first a u as (i, p), then v^T
    aq = inner(left, pb, "m", ["i", "p"])
    vb = v["b"].withColumnRenamed("x", "j")
    parts.append(inner(aq, vb, "p", ["i", "j"]))
    # rank rows of both: (p, q) first
    pq = inner(pa.withColumnRenamed("p", "q"), pb, "m", ["q", "p"])
    uq = inner(u["a"].withColumnRenamed("x", "i").withColumnRenamed("p", "q"), pq, "q", ["i", "p"])
    parts.append(inner(uq, vb, "p", ["i", "j"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i", "j").agg((F.lit(float(alpha)) * F.sum("v")).alias("v"))


def permuted(blocks: DataFrame, rows: list[int] | None = None, columns: list[int] | None = None) -> DataFrame:
    """Dense leaves of one size with entry (r, c) of each moved to (rows[r], columns[c])."""
    n, m = nrows().cast("int"), ncols().cast("int")
    inverse = lambda p: None if p is None else F.array(*[F.lit(p.index(k)) for k in range(len(p))])
    ri, ci = inverse(rows), inverse(columns)
    source = lambda p: (F.get(ci, F.floor(p / n).cast("int")) if ci is not None else F.floor(p / n).cast("int")) * n + (F.get(ri, p % n) if ri is not None else p % n)
    return blocks.withColumn("d", F.when(F.col("kind") == "dense", F.transform(F.sequence(F.lit(0), n * m - 1), lambda p: F.get("d", source(p)))).otherwise(F.col("d")))


def row(blocks: DataFrame, i: int) -> DataFrame:
    """(j, v) of row i, from the leaves that hold it."""
    return to_coo(blocks.where(F.lit(i).between(F.col("row_first"), F.col("row_last")))).where(F.col("i") == i).select("j", "v")


def column(blocks: DataFrame, j: int) -> DataFrame:
    """(i, v) of column j, from the leaves that hold it."""
    return to_coo(blocks.where(F.lit(j).between(F.col("col_first"), F.col("col_last")))).where(F.col("j") == j).select("i", "v")


def scale(alpha: float, blocks: DataFrame) -> DataFrame:
    f = F.lit(float(alpha))
    return blocks.withColumns({"d": F.transform("d", lambda v: f * v), "a": F.transform("a", lambda v: f * v)})


def add_block(target: DataFrame, alpha: float, source: DataFrame) -> DataFrame:
    """target + alpha * source where their ranges overlap: an interval join on row and column bins of the target's grid.

    Entries of `source` (i, j, v) inside a target block are added to its entries; others are ignored.
    """
    own = dense_entries(target)
    width = target.agg(F.max(F.greatest(nrows(), ncols())).alias("w")).first()["w"] or 1
    bins = target.where("kind = 'dense'").select("block_id", "row_first", "row_last", "col_first", "col_last",
        F.explode(F.sequence(F.floor(F.col("row_first") / width), F.floor(F.col("row_last") / width))).alias("rb"))
    bins = bins.withColumn("cb", F.explode(F.sequence(F.floor(F.col("col_first") / width), F.floor(F.col("col_last") / width))))
    e = source.withColumns({"rb": F.floor(F.col("i") / width), "cb": F.floor(F.col("j") / width)}).join(bins, ["rb", "cb"])
    e = e.where(F.col("i").between(F.col("row_first"), F.col("row_last")) & F.col("j").between(F.col("col_first"), F.col("col_last")))
    return own.unionByName(e.select("block_id", "i", "j", (alpha * F.col("v")).alias("v"))).groupBy("block_id", "i", "j").agg(F.sum("v").alias("v"))


def entry(blocks: DataFrame, i: int, j: int) -> DataFrame:
    """The entry at (i, j) of the leaf that holds it; for symmetric forms above the diagonal, of its mirror image."""
    return to_coo(mirrored(blocks.where(_holds(i, j) | (_holds(j, i) & (F.col("form") != "unsymmetric"))))).where((F.col("i") == i) & (F.col("j") == j)).agg(F.coalesce(F.max("v"), F.lit(0.0)).alias("v"))


def _holds(i: int, j: int) -> Column:
    return F.lit(i).between(F.col("row_first"), F.col("row_last")) & F.lit(j).between(F.col("col_first"), F.col("col_last"))


# ---- structure -------------------------------------------------------------------------------------------------------


def leaves(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind <> 'blocked'")


def is_small(limit: int) -> Column:
    """Both sides at most `limit`."""
    return (nrows() <= limit) & (ncols() <= limit)


def on_diagonal() -> Column:
    return (F.col("row_first") == F.col("col_first")) & (F.col("row_last") == F.col("col_last"))


def in_lower_left(strictly: bool = False) -> Column:
    below = F.col("row_first") > F.col("col_last")
    return below if strictly else below | on_diagonal()


def in_upper_right(strictly: bool = False) -> Column:
    above = F.col("col_first") > F.col("row_last")
    return above if strictly else above | on_diagonal()


def pattern(blocks: DataFrame) -> DataFrame:
    """Per parent, which patterns its non-zero sub-blocks make: diagonal, lower left, upper right, flat (one row or column
    of blocks), domain decomposition (3 x 3 or more, off-diagonal blocks only in the last row and column), zero."""
    live = F.col("kind") != "zero"
    top = blocks.groupBy("parent_id").agg(F.max("bi").alias("mi"), F.max("bj").alias("mj"))
    x = blocks.join(top, "parent_id")
    every = lambda test: F.bool_and(~live | test)
    return x.groupBy("parent_id").agg(
        every(F.col("bi") == F.col("bj")).alias("is_diag"),
        every(F.col("bi") >= F.col("bj")).alias("is_lower_left"),
        every(F.col("bi") <= F.col("bj")).alias("is_upper_right"),
        (F.max("mi").eqNullSafe(F.lit(0)) | F.max("mj").eqNullSafe(F.lit(0))).alias("is_flat"),
        ((F.max("mi") >= 2) & (F.max("mi") == F.max("mj")) & every((F.col("bi") == F.col("bj")) | (F.col("bi") == F.col("mi")) | (F.col("bj") == F.col("mj")))).alias("is_dd"),
        F.bool_and(~live).alias("is_zero"),
    )


def statistics(blocks: DataFrame) -> DataFrame:
    c = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    diag = F.min(F.when(on_diagonal() & (F.col("kind") != "blocked"), F.col("lvl")))
    return blocks.agg(F.count("*").alias("nblocks"), F.count(F.when(F.col("kind") != "blocked", 1)).alias("leaves"), c("rk").alias("lowrank"), c("dense").alias("dense"), F.max("block_id").alias("max_id"), (F.max("lvl") + 1).alias("nlevel"), diag.alias("first_diag_leaf_level"))


def byte_size(blocks: DataFrame) -> DataFrame:
    """Bytes of the payloads: 8 a coefficient; symmetric forms count what is stored."""
    return blocks.agg(F.coalesce(F.sum(F.when(F.col("kind") == "dense", nrows() * ncols()).when(F.col("kind") == "rk", F.col("rank") * (nrows() + ncols())).otherwise(0)) * 8, F.lit(0)).alias("bytes"))


def containing(blocks: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """The blocks that hold a block index set, the smallest first."""
    inside = (F.col("row_first") <= rows[0]) & (F.col("row_last") >= rows[1]) & (F.col("col_first") <= columns[0]) & (F.col("col_last") >= columns[1])
    return blocks.where(inside).orderBy(F.col("lvl").desc())


def product_blocks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of leaves whose product contributes, with the index set of the destination."""
    x = a.select(F.col("block_id").alias("a_id"), "row_first", "row_last", F.col("col_first").alias("k0"), F.col("col_last").alias("k1"))
    y = b.select(F.col("block_id").alias("b_id"), F.col("row_first").alias("k0"), F.col("row_last").alias("k1"), "col_first", "col_last")
    return x.join(y, ["k0", "k1"]).select("a_id", "b_id", "row_first", "row_last", "col_first", "col_last")


def with_block(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks with some set or replaced, by (parent_id, bi, bj)."""
    key = ["parent_id", "bi", "bj"]
    return blocks.join(new.select(*key), key, "left_anti").unionByName(new)


def without_block(blocks: DataFrame, parent: int, bi: int, bj: int) -> DataFrame:
    return blocks.where(~((F.col("parent_id") == parent) & (F.col("bi") == bi) & (F.col("bj") == bj)))


def diagonal(blocks: DataFrame) -> DataFrame:
    """The diagonal (i, v), from the leaves that touch it."""
    touching = blocks.where("row_first <= col_last and col_first <= row_last")
    return coo.diagonal(to_coo(touching))


def copy_structure(blocks: DataFrame) -> DataFrame:
    """The same blocks with zero payloads and rank 0."""
    zero = F.transform("d", lambda _: F.lit(0.0))
    none = F.array().cast("array<double>")
    return blocks.withColumns({"d": zero, "a": F.when(F.col("kind") == "rk", none), "b": F.when(F.col("kind") == "rk", none), "rank": F.when(F.col("kind") == "rk", F.lit(0))})
