"""Geometric cluster trees, level by level.

A tree is (cid, parent, lvl, first, last, is_leaf, is_domain, bbmin, bbmax) over internal indices, with a permutation
(e, i) from dofs. Every level is one pass over the points: each point carries its cluster and a sort key, a split is a
column of 0 and 1, and counts give the sons' ranges. Ids are 2 * parent + 1 and + 2, as in a heap, so no counter is shared.
Ties are broken by dof. Levels are checkpointed. Under the geometric split the tree below a cluster of at most HELD_POINTS
points is built where they are gathered, since a level costs several jobs whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import ranks, settled

#: Points of a cluster that is not split, and of one below which a task builds the tree.
LEAF_SIZE, HELD_POINTS = 60, 250_000


def bounding_box(points: DataFrame, by: list[str], dim: int) -> DataFrame:
    """(by..., bbmin, bbmax, n) of the points (x) of each group."""
    at = lambda k: F.get("x", F.lit(k)).cast("double")
    box = lambda f: F.array(*[f(at(k)) for k in range(dim)])
    return points.groupBy(*by).agg(box(F.min).alias("bbmin"), box(F.max).alias("bbmax"), F.count("*").alias("n"))


def support_box(support: DataFrame, by: list[str], dim: int) -> DataFrame:
    """The same for points with boxes of their own (bbmin, bbmax)."""
    at = lambda c, k: F.get(c, F.lit(k))
    return support.groupBy(*by).agg(F.array(*[F.min(at("bbmin", k)) for k in range(dim)]).alias("bbmin"), F.array(*[F.max(at("bbmax", k)) for k in range(dim)]).alias("bbmax"), F.count("*").alias("n"))


Split = Callable[[DataFrame, int, int], DataFrame]


def _axis(points: DataFrame, lvl: int, dim: int, adaptive: bool) -> Column:
    """The axis to split: the longest side (first on ties), or the level modulo the dimension."""
    if not adaptive:
        return F.lit(lvl % dim)
    sides = F.zip_with("bbmax", "bbmin", lambda a, b: a - b)
    return (F.array_position(sides, F.array_max(sides)) - 1).cast("int")


def geometric(adaptive: bool = True) -> Split:
    """At the middle of the box; points at or below it go left."""

    def split(points: DataFrame, lvl: int, dim: int) -> DataFrame:
        axis = _axis(points, lvl, dim, adaptive)
        mid = (F.get("bbmin", axis) + F.get("bbmax", axis)) / 2
        return points.withColumn("side", F.when(F.get("x", axis) <= mid, 0).otherwise(1))

    split.adaptive = adaptive
    return split


def _below(points: DataFrame, lvl: int, dim: int, adaptive: bool, leaf_size: int, least_level: int, max_level: int) -> tuple[DataFrame, DataFrame]:
    """The clusters from level lvl on, as build collects them, and (e, i) of their points, under the geometric split: one group
    a cluster of points."""

    def grow(group: pa.Table) -> pa.Table:
        # in the order of dofs, which a split keeps
        group = group.take(pc.sort_indices(group, sort_keys=[("dof", "ascending")], null_placement="at_start"))
        dof = group.column("dof")
        x = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(dof), dim)
        rows, own = [], []
        todo = [(lvl, group.column("cid")[0].as_py(), group.column("parent")[0].as_py(), group.column("first")[0].as_py(), np.arange(len(dof)))]
        while todo:
            level, cid, parent, first, at = todo.pop()
            low, high = x[at].min(0), x[at].max(0)
            leaf = (len(at) <= leaf_size and level >= least_level) or level == max_level or len(at) == 1
            if not leaf:
                axis = int(np.argmax(high - low)) if adaptive else level % dim
                left = x[at, axis] <= (low[axis] + high[axis]) / 2
                leaf = bool(left.all() or not left.any())
            if not leaf:
                todo.append((level + 1, 2 * cid + 1, cid, first, at[left]))
                todo.append((level + 1, 2 * cid + 2, cid, first + int(left.sum()), at[~left]))
            rows.append((cid, parent, first, False, low.tolist(), high.tolist(), len(at), level, leaf))
            own.append(dof.take(pa.array(at)).combine_chunks() if leaf else None)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int32(), pa.bool_()], strict=True)]
        ends = np.cumsum([0, *(0 if o is None else len(o) for o in own)])
        held = pa.concat_arrays([o for o in own if o is not None])
        return pa.table([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)], [c.split()[0] for c in kinds.split(", ")] + ["own"])

    kinds = "cid long, parent long, first long, is_domain boolean, bbmin array<double>, bbmax array<double>, n long, lvl int, is_leaf boolean"
    rows = points.select("dof", "x", "cid", "parent", "first").groupBy("cid").applyInArrow(grow, f"{kinds}, own array<{points.schema['dof'].dataType.simpleString()}>")
    found = settled(rows)
    return found.drop("own"), found.select("first", F.posexplode("own").alias("at", "e")).select("e", (F.col("first") + F.col("at")).cast("long").alias("i"))


def cardinality(adaptive: bool = True) -> Split:
    """The lower half by count goes left: one distributed sort a level, cut at exact ranks."""

    def split(points: DataFrame, lvl: int, dim: int) -> DataFrame:
        axis = _axis(points, lvl, dim, adaptive)
        ranked = ranks(points.withColumn("_key", F.get("x", axis)), ["cid"], ["_key", "dof"], "_rank")
        return ranked.withColumn("side", F.when(F.col("_rank") <= F.floor(F.col("n") / 2), 0).otherwise(1)).drop("_rank", "_key")

    return split


def principal(by_count: bool = False) -> Split:
    """Across the main direction of the points, at their centre; where one side would be empty, at the middle of the
    projections, or with by_count at their median."""

    def split(points: DataFrame, lvl: int, dim: int) -> DataFrame:
        at = lambda k: F.get("x", F.lit(k))
        means = [F.avg(at(k)).alias(f"m{k}") for k in range(dim)]
        moments = [F.avg(at(a) * at(b)).alias(f"c{a}_{b}") for a in range(dim) for b in range(a + 1)]
        stats = points.groupBy("cid").agg(*means, *moments)

        def directions(frames):
            for f in frames:
                out = []
                for row in f.to_dict("records"):
                    m = np.array([row[f"m{k}"] for k in range(dim)])
                    c = np.array([[row[f"c{max(a, b)}_{min(a, b)}"] for b in range(dim)] for a in range(dim)]) - np.outer(m, m)
                    v = np.linalg.eigh(c)[1][:, -1]
                    v = v * (1 if v[np.argmax(np.abs(v))] >= 0 else -1)
                    out.append((v.tolist(), m.tolist()))
                f["dir"], f["mean"] = [o[0] for o in out], [o[1] for o in out]
                yield f[["cid", "dir", "mean"]]

        found = stats.mapInPandas(directions, "cid long, dir array<double>, mean array<double>")
        x = points.join(found, "cid")
        proj = F.aggregate(F.zip_with(F.zip_with("x", "mean", lambda a, m: a - m), "dir", lambda a, d: a * d), F.lit(0.0), lambda s, v: s + v)
        x = x.withColumn("_p", proj)
        if by_count:
            x = ranks(x, ["cid"], ["_p", "dof"], "_rank")
            side = F.when(F.col("_rank") <= F.floor(F.col("n") / 2), 0).otherwise(1)
        else:
            ends = x.groupBy("cid").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))
            x = x.join(ends, "cid")
            low, high = F.col("_low"), F.col("_high")
            at_centre = (low <= 0) & (high > 0)
            side = F.when(F.col("_p") <= F.when(at_centre, 0.0).otherwise((low + high) / 2), 0).otherwise(1)
        return x.withColumn("side", side).drop("_p", "dir", "mean", "_rank", "_low", "_high")

    return split


def automatic(ratio: float = 0.9) -> Split:
    """Geometric, but by count in clusters where that is too uneven."""
    geo, card = geometric(), cardinality()

    def split(points: DataFrame, lvl: int, dim: int) -> DataFrame:
        g = geo(points, lvl, dim).withColumnRenamed("side", "_geo")
        tilt = g.groupBy("cid").agg(F.abs(F.sum(1 - 2 * F.col("_geo"))).alias("_tilt"))
        both = card(g.join(tilt, "cid"), lvl, dim)
        return both.withColumn("side", F.when(F.col("_tilt") / F.col("n") > ratio, F.col("side")).otherwise(F.col("_geo"))).drop("_geo", "_tilt")

    return split


def least_cut(edges: DataFrame) -> Split:
    """By count along the axis that cuts the least edge weight (src, dst, w)."""

    def split(points: DataFrame, lvl: int, dim: int) -> DataFrame:
        sides = points
        for k in range(dim):
            ranked = ranks(sides.withColumn("_key", F.get("x", F.lit(k))), ["cid"], ["_key", "dof"], "_rank")
            sides = ranked.withColumn(f"_s{k}", F.when(F.col("_rank") <= F.floor(F.col("n") / 2), 0).otherwise(1)).drop("_rank", "_key")
        own = sides.select("dof", "cid", *[f"_s{k}" for k in range(dim)])
        e = edges.join(own.select(F.col("dof").alias("src"), F.col("cid").alias("c0"), *[F.col(f"_s{k}").alias(f"a{k}") for k in range(dim)]), "src")
        e = e.join(own.select(F.col("dof").alias("dst"), F.col("cid").alias("c1"), *[F.col(f"_s{k}").alias(f"b{k}") for k in range(dim)]), "dst").where("c0 = c1")
        cut = lambda k: F.sum(F.when(F.col(f"a{k}") != F.col(f"b{k}"), F.col("w")).otherwise(0.0))
        best = e.groupBy(F.col("c0").alias("cid")).agg(F.array_min(F.array(*[F.struct(cut(k).alias("cut"), F.lit(k).alias("axis")) for k in range(dim)]))["axis"].alias("axis"))
        x = sides.join(best, "cid", "left").withColumn("axis", F.coalesce("axis", F.lit(0)))
        return x.withColumn("side", F.get(F.array(*[F.col(f"_s{k}") for k in range(dim)]), F.col("axis"))).drop("axis", *[f"_s{k}" for k in range(dim)])

    return split


def build(points: DataFrame, split: Split | None = None, leaf_size: int = LEAF_SIZE, least_level: int = 0, max_level: int = 38, interface: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A binary cluster tree of points (dof, x): (clusters, permutation).

    A cluster becomes a leaf at or below leaf_size, once at least_level is reached, or if a split leaves one side empty.
    With `interface` edges (src, dst), the points of the right side that touch the left one form a third son, so that the
    first two are domains without contact (nested dissection). Ids have room for 62 levels, or 38 with an interface.
    """
    split = split or geometric()
    if max_level > (62 if interface is None else 38):
        raise ValueError("cluster ids have no room for so many levels")
    dim = points.select(F.size("x")).first()[0]
    now = settled(points.select("dof", F.transform("x", lambda v: v.cast("double")).alias("x"), F.lit(0).cast("long").alias("cid"), F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("first"), F.lit(interface is not None).alias("is_domain")))
    clusters, placed, base = [], [], 3 if interface is not None else 2
    # whole and finite coordinates, so that boxes are the same in numpy
    held = interface is None and hasattr(split, "adaptive") and now.where(F.col("x").isNull() | (F.size("x") != dim) | F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).isEmpty()
    deeper = None
    for lvl in range(max_level + 1):
        if held and now.groupBy("cid").count().agg(F.max("count")).first()[0] <= HELD_POINTS:
            deeper = _below(now, lvl, dim, split.adaptive, leaf_size, least_level, max_level)
            break
        boxes = bounding_box(now, ["cid", "parent", "first", "is_domain"], dim)
        here = settled(boxes.withColumn("lvl", F.lit(lvl)).withColumn("is_leaf", (F.col("n") <= leaf_size) & F.lit(lvl >= least_level) | F.lit(lvl == max_level) | (F.col("n") == 1)))
        live = now.join(here.where("not is_leaf").select("cid", "n", "bbmin", "bbmax"), "cid")
        sided = split(live, lvl, dim).select("dof", "x", "cid", "first", "is_domain", "side")
        if interface is not None:
            sided = _with_interface(sided, interface)
        sided = settled(sided)
        counts = sided.groupBy("cid").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"n{s}") for s in range(3)])
        stuck = counts.where(F.greatest("n0", "n1", "n2") == F.col("n0") + F.col("n1") + F.col("n2")).select("cid").withColumn("stuck", F.lit(True))
        level = settled(here.join(stuck, "cid", "left").withColumn("is_leaf", F.col("is_leaf") | F.coalesce("stuck", F.lit(False))).drop("stuck"))
        clusters.append(level)
        done = now.join(level.where("is_leaf").select("cid"), "cid", "left_semi").select("dof", "cid", "first")
        placed.append(done)
        going = sided.join(counts, "cid").join(level.where("not is_leaf").select("cid"), "cid", "left_semi")
        start = F.when(F.col("side") == 0, 0).when(F.col("side") == 1, F.col("n0")).otherwise(F.col("n0") + F.col("n1"))
        now = settled(going.select("dof", "x", (F.col("cid") * base + 1 + F.col("side")).alias("cid"), F.col("cid").alias("parent"), (F.col("first") + start).alias("first"), (F.col("is_domain") & (F.col("side") < 2)).alias("is_domain")))
        if not now.limit(1).count():
            break
    if deeper and not clusters:
        tree, order = deeper[0], None
    else:
        tree, order = clusters[0], placed[0]
    for c, p in zip(clusters[1:], placed[1:], strict=True):
        tree, order = tree.unionByName(c), order.unionByName(p)
    if deeper and clusters:
        tree = tree.unionByName(deeper[0])
    tree = tree.select("cid", "parent", "lvl", "first", (F.col("first") + F.col("n") - 1).alias("last"), "is_leaf", "is_domain", "bbmin", "bbmax")
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("dof")) - 1
    order = order and order.select(F.col("dof").alias("e"), (F.col("first") + rank).cast("long").alias("i"))
    if deeper:
        order = order.unionByName(deeper[1]) if order else deeper[1]
    return settled(tree), settled(order)


def _with_interface(sided: DataFrame, edges: DataFrame) -> DataFrame:
    own = sided.select("dof", "cid", "side")
    e = edges.join(own.select(F.col("dof").alias("src"), F.col("cid").alias("c0"), F.col("side").alias("s0")), "src").join(own.select(F.col("dof").alias("dst"), F.col("cid").alias("c1"), F.col("side").alias("s1")), "dst")
    touching = e.where("c0 = c1 and s0 = 1 and s1 = 0").select(F.col("src").alias("dof")).distinct().withColumn("_touch", F.lit(True))
    return sided.join(touching, "dof", "left").withColumn("side", F.when(F.col("_touch"), 2).otherwise(F.col("side"))).drop("_touch")


def block_low_rank(points: DataFrame, order_by: list[Column], leaf_size: int = LEAF_SIZE, levels: int = 2) -> DataFrame:
    """Multi-level block low-rank clusters: points in a spatial order, cut into ranges of leaf_size, merged upwards to
    sizes n * alpha^l with alpha = (leaf_size / n)^(1 / levels). Rows (dof, i, c1, ..., c_levels)."""
    n = points.count()
    alpha = (leaf_size / n) ** (1 / levels) if n > leaf_size else 1.0
    ranked = ranks(points, [], [*order_by, F.col("dof")], "_rank").withColumn("i", (F.col("_rank") - 1).cast("long"))
    for lvl in range(1, levels + 1):
        size = max(leaf_size, round(n * alpha**lvl))
        ranked = ranked.withColumn(f"c{lvl}", F.floor(F.col("i") / size))
    return ranked.select("dof", "i", *[f"c{k}" for k in range(1, levels + 1)])


def hilbert_key(points: DataFrame, bits: int = 16) -> DataFrame:
    """points with `key`, the place of each on a Hilbert curve through the cube around all of them."""
    dim = points.select(F.size("x")).first()[0]
    box = bounding_box(points.withColumn("_g", F.lit(0)), ["_g"], dim).first()
    low, side = np.array(box["bbmin"]), max(max(h - a for a, h in zip(box["bbmin"], box["bbmax"], strict=True)), 1e-300)
    bits = min(bits, 62 // dim)

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f.x.map(np.asarray)).astype(float)
            cells = np.clip(((x - low) / side * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
            yield f.assign(key=hilbert_index(cells, bits))

    kinds = ", ".join(f"{c} {t}" for c, t in points.dtypes)
    return points.mapInPandas(run, f"{kinds}, key long")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer cells (n, dim), by Gray-code exchange and inversion of the axes bit by bit."""
    x = cells.T.copy()
    dim = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for k in range(dim):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if k:
                x[k] ^= swap
    for k in range(1, dim):
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = np.where((x[dim - 1] & q) != 0, t ^ (q - 1), t)
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dim):
            out = out << 1 | (x[k] >> b & 1)
    return out


def space_filling(points: DataFrame, leaf_size: int = LEAF_SIZE, bits: int = 16) -> tuple[DataFrame, DataFrame]:
    """A cluster tree by halving along a Hilbert curve; boxes are those of the points."""
    keyed = hilbert_key(points, bits)
    flat = keyed.select("dof", F.array(F.col("key").cast("double")).alias("x"))
    tree, perm = build(flat, cardinality(), leaf_size)
    boxes = cluster_boxes(points, tree, perm)
    return tree.drop("bbmin", "bbmax").join(boxes, "cid"), perm


def cluster_boxes(points: DataFrame, tree: DataFrame, perm: DataFrame) -> DataFrame:
    """(cid, bbmin, bbmax) of all clusters: leaves from the points, then upwards by their parents."""
    dim = points.select(F.size("x")).first()[0]
    from .vector import to_blocked

    at = points.join(perm.withColumnRenamed("e", "dof"), "dof")
    leaf = to_blocked(at.select("i", F.col("dof").alias("v")), tree).select(F.col("blk").cast("long").alias("cid"), F.col("v").alias("dof"))
    boxes = bounding_box(points.join(leaf, "dof"), ["cid"], dim).drop("n")
    found, depth = boxes, tree.agg(F.max("lvl")).first()[0] or 0
    for lvl in range(depth - 1, -1, -1):
        up = found.join(tree.where(F.col("lvl") == lvl + 1).select("cid", "parent"), "cid")
        merged = support_box(up.drop("cid").withColumnRenamed("parent", "cid"), ["cid"], dim).drop("n")
        found = settled(found.unionByName(merged))
    return found


def statistics(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count("*").alias("nnodes"), F.max("lvl").cast("long").alias("depth"), F.count(F.when(F.col("is_leaf"), 1)).alias("leaves"))


def flattened(tree: DataFrame) -> DataFrame:
    """All leaves as sons of the root."""
    root = tree.where("lvl = 0").withColumn("is_leaf", F.lit(False))
    return root.unionByName(tree.where("is_leaf and lvl > 0").withColumns({"parent": F.lit(0).cast("long"), "lvl": F.lit(1)}))


# ---- index sets (first, last) ----------------------------------------------------------------------------------------


def size_of(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(0), last - first + 1)


def is_in(first: Column, last: Column, i: Column) -> Column:
    return i.between(first, last)


def is_subset(f1: Column, l1: Column, f2: Column, l2: Column) -> Column:
    return (f1 >= f2) & (l1 <= l2)


def left_of(l1: Column, f2: Column) -> Column:
    return l1 < f2


def intersection(f1: Column, l1: Column, f2: Column, l2: Column) -> tuple[Column, Column]:
    return F.greatest(f1, f2), F.least(l1, l2)


def hull(f1: Column, l1: Column, f2: Column, l2: Column) -> tuple[Column, Column]:
    return F.least(f1, f2), F.greatest(l1, l2)
