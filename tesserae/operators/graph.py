"""Graphs as edge tables (src, dst, w), symmetric and without loops; algebraic clustering and nested dissection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import ranks, settled


def from_matrix(a: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """The symmetrised pattern of a square matrix without diagonal and without the masked nodes (node)."""
    e = a.where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    e = e.union(e.select("dst", "src")).distinct()
    if mask is not None:
        e = e.join(mask.select(F.col("node").alias("src")), "src", "left_anti").join(mask.select(F.col("node").alias("dst")), "dst", "left_anti")
    return e.select("src", "dst", F.lit(1.0).alias("w"))


def weighted(a: DataFrame, mode: str = "linear", levels: int = 1000) -> DataFrame:
    """The same with weights from the larger modulus of a pair's entries, scaled to whole numbers 1..levels, linearly or by
    logarithms."""
    m = a.where("i <> j").select("i", "j", F.abs("v").alias("m"))
    both = m.union(m.select("j", "i", "m")).groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.max("m").alias("m")).where("m > 0")
    value = F.log("m") if mode == "log" else F.col("m")
    span = both.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    share = (value - F.col("low")) / F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    return both.crossJoin(F.broadcast(span)).select("src", "dst", (1 + F.floor(share * (levels - 1))).cast("double").alias("w"))


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def min_degree_node(e: DataFrame) -> DataFrame:
    return degrees(e).agg(F.min_by("node", F.struct("degree", "node")).alias("node"), F.min("degree").alias("degree"))


def max_degree_node(e: DataFrame) -> DataFrame:
    return degrees(e).agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("node"), F.max("degree").alias("degree"))


def min_edge_weight(e: DataFrame) -> DataFrame:
    return e.agg(F.min("w").alias("w"))


def restrict(e: DataFrame, keep: DataFrame) -> DataFrame:
    """The induced sub-graph on nodes (node); names stay."""
    return e.join(keep.select(F.col("node").alias("src")), "src", "left_semi").join(keep.select(F.col("node").alias("dst")), "dst", "left_semi")


def connected_components(e: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """(node, component = smallest node reachable), with isolated nodes if `every` (node) names them.

    Alternating stars: neighbours are linked with the smallest node around until nothing changes; rounds are few, and each
    is a join and an aggregation that no large group enters whole.
    """
    now, before = settled(e.where("src > dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = settled(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    every = nodes(e) if every is None else every.select("node").union(nodes(e)).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def distances(e: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(node, distance) by breadth-first search from nodes (node), level by level."""
    seen = settled(start.select("node", F.lit(0).alias("distance")).distinct())
    front, d = seen, 0
    while most is None or d < most:
        d += 1
        reached = e.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = settled(reached.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return settled(seen)


def diameter(e: DataFrame, start: int) -> tuple[int, int]:
    """A lower bound by two sweeps: the distance from a farthest node to its own farthest one, and that node."""
    node, far = start, 0
    for _ in range(2):
        d = distances(e, e.sparkSession.createDataFrame([(node,)], "node long"))
        node, far = d.orderBy(F.col("distance").desc(), "node").first()
    return far, node


def edge_cut(e: DataFrame, sides: DataFrame) -> DataFrame:
    """Summed weight of edges between different sides of (node, side), each edge once."""
    x = e.where("src < dst").join(sides.select(F.col("node").alias("src"), F.col("side").alias("s0")), "src").join(sides.select(F.col("node").alias("dst"), F.col("side").alias("s1")), "dst")
    return x.agg(F.coalesce(F.sum(F.when(F.col("s0") != F.col("s1"), F.col("w")).otherwise(0.0)), F.lit(0.0)).alias("cut"))


def vertex_separator(e: DataFrame, sides: DataFrame) -> DataFrame:
    """Nodes of the larger of two sides (node, side) that touch the other one; on equal sizes, of side 1.

    Removing them leaves no edge between the sides. It does not depend on an order of visits.
    """
    counts = sides.groupBy("side").count().orderBy(F.col("count").desc(), F.col("side").desc()).limit(1).select(F.col("side").alias("big"))
    x = e.join(sides.select(F.col("node").alias("src"), F.col("side").alias("s0")), "src").join(sides.select(F.col("node").alias("dst"), F.col("side").alias("s1")), "dst")
    return x.where("s0 <> s1").crossJoin(F.broadcast(counts)).where("s0 = big").select(F.col("src").alias("node")).distinct()


def to_dot(e: DataFrame) -> DataFrame:
    """Lines of a GraphViz file, one for each edge."""
    return e.where("src < dst").select(F.format_string("  %d -- %d [weight=%s];", "src", "dst", F.col("w").cast("string")).alias("value"))


# ---- partitioning ----------------------------------------------------------------------------------------------------


def bisect_by_levels(e: DataFrame, every: DataFrame) -> DataFrame:
    """(node, side): breadth-first levels from a node at the rim; the nearer half by count is side 0.

    Ordered by (level, node), so the parts are as connected as the graph allows. Components are put one after another.
    """
    parts = connected_components(e, every)
    starts = parts.select("component").distinct()
    found = distances(e, starts.select(F.col("component").alias("node")))
    # from the farthest node of each component, a second sweep gives longer and thinner levels
    far = found.join(parts, "node").groupBy("component").agg(F.max_by("node", F.struct("distance", "node")).alias("node"))
    level = distances(e, far.select("node")).join(parts, "node")
    n = level.count()
    ranked = ranks(level, [], ["component", "distance", "node"])
    return ranked.select("node", F.when(F.col("rank") <= n // 2, 0).otherwise(1).alias("side"))


def bisect_spectral(e: DataFrame, every: DataFrame, iterations: int = 40) -> DataFrame:
    """(node, side) by the sign order of an approximate Fiedler vector."""
    live = every.select("node").distinct().withColumn("cid", F.lit(0).cast("long"))
    live = live.crossJoin(F.broadcast(live.agg(F.count("*").alias("n"))))
    return spectral_parts(e.withColumn("cid", F.lit(0).cast("long")), live, iterations).select("node", "side")


def pack_in_bins(sizes: list[int], bins: int = 2, steps: int = 20) -> list[int]:
    """Bins for items so that the fullest is nearly least: the capacity is bisected, and each is tried by putting items in
    falling size into the first bin with room. Returns a bin for each item."""
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])

    def fit(capacity: float) -> list[int] | None:
        room, where = [capacity] * bins, [0] * len(sizes)
        for k in order:
            b = next((b for b in range(bins) if room[b] >= sizes[k]), None)
            if b is None:
                return None
            room[b] -= sizes[k]
            where[k] = b
        return where

    total = sum(sizes)
    low, high = max([total / bins, *sizes]) if sizes else 0, 2 * max([total / bins, *sizes]) if sizes else 0
    best = fit(high) or [k % bins for k in range(len(sizes))]
    for _ in range(steps):
        mid = (low + high) / 2
        if (found := fit(mid)) is not None:
            best, high = found, mid
        else:
            low = mid
    return best


def partition_components(e: DataFrame, every: DataFrame) -> DataFrame | None:
    """If there is more than one component: (node, side) with whole components in two bins of near equal size.

    Components are collected by size only where there are few; many small ones are dealt by a running sum of sizes.
    """
    parts = settled(connected_components(e, every))
    sizes = parts.groupBy("component").agg(F.count("*").alias("n"))
    few = sizes.orderBy(F.col("n").desc(), "component").limit(1001).collect()
    if len(few) < 2:
        return None
    if len(few) <= 1000:
        bins = pack_in_bins([r["n"] for r in few])
        sides = e.sparkSession.createDataFrame([(r["component"], b) for r, b in zip(few, bins, strict=True)], "component long, side int")
    else:
        total = parts.count()
        upto = F.sum("n").over(Window.orderBy(F.col("n").desc(), "component").rowsBetween(Window.unboundedPreceding, 0))
        sides = sizes.select("component", F.when(upto <= total / 2, 0).otherwise(1).alias("side"))
    return parts.join(sides, "component").select("node", "side")


def check_flow(a: DataFrame, sides: DataFrame) -> bool:
    """Whether left should be swapped with right: more weight points from left to right than back."""
    x = a.where("i <> j").join(sides.select(F.col("node").alias("i"), F.col("side").alias("si")), "i").join(sides.select(F.col("node").alias("j"), F.col("side").alias("sj")), "j")
    w = F.abs("v")
    lr, rl = x.agg(F.coalesce(F.sum(F.when((F.col("si") == 0) & (F.col("sj") == 1), w)), F.lit(0.0)), F.coalesce(F.sum(F.when((F.col("si") == 1) & (F.col("sj") == 0), w)), F.lit(0.0))).first()
    return lr > rl


def high_degree(e: DataFrame, factor: float) -> DataFrame:
    """Nodes whose degree is above factor times the mean, to be clustered apart."""
    d = degrees(e)
    return d.crossJoin(F.broadcast(d.agg(F.avg("degree").alias("mean")))).where(F.col("degree") > factor * F.col("mean")).select("node")


def within(e: DataFrame, sides: DataFrame) -> DataFrame:
    """The edges inside the parts of (node, cid), each with its cid: one pass for all parts of a level."""
    x = e.join(sides.select(F.col("node").alias("src"), F.col("cid")), "src").join(sides.select(F.col("node").alias("dst"), F.col("cid").alias("_c")), "dst")
    return x.where("cid = _c").select("src", "dst", "w", "cid")


def bisect_parts(inner: DataFrame, live: DataFrame) -> DataFrame:
    """(node, cid, side) for all clusters (node, cid, n) of a level at once: breadth-first levels inside each component of
    each cluster, components one after another, and the nearer half by count is side 0. With several components of nearly
    equal size the cut falls between them by itself."""
    parts = settled(connected_components(inner, live.select("node")))
    own = live.join(parts, "node")
    found = distances(inner, parts.select(F.col("component").alias("node")).distinct())
    far = found.join(parts, "node").groupBy("component").agg(F.max_by("node", F.struct("distance", "node")).alias("node"))
    levels = distances(inner, far.select("node"))
    # larger components first, so that whole ones fill the first half
    sizes = parts.groupBy("component").agg(F.count("*").alias("_size"))
    ranked = ranks(own.join(sizes, "component").join(levels, "node"), ["cid"], [F.col("_size").desc(), "component", "distance", "node"])
    return ranked.select("node", "cid", F.when(F.col("rank") <= F.floor(F.col("n") / 2), 0).otherwise(1).alias("side"))


def spectral_parts(inner: DataFrame, live: DataFrame, iterations: int = 40) -> DataFrame:
    """The same by the order of an approximate Fiedler vector of each cluster: power iteration on shifted Laplacians of all
    clusters together, with each cluster's constant vector taken out."""
    deg = inner.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    base = live.join(deg, "node", "left").select("node", "cid", "n", F.coalesce("d", F.lit(0.0)).alias("d"))
    shifts = base.groupBy("cid").agg((2 * F.greatest(F.max("d"), F.lit(1.0))).alias("shift"))
    x = settled(base.join(shifts, "cid").withColumn("v", F.pmod(F.xxhash64("node"), F.lit(1000)) / 1000.0 - 0.5))
    for _ in range(iterations):
        near = inner.join(x.select(F.col("node").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("s"))
        y = x.join(near, "node", "left").withColumn("v", (F.col("shift") - F.col("d")) * F.col("v") + F.coalesce("s", F.lit(0.0))).drop("s")
        y = settled(y)
        means = y.groupBy("cid").agg(F.avg("v").alias("_m"), F.sqrt(F.sum(F.col("v") ** 2)).alias("_n"))
        x = y.join(means, "cid").withColumn("v", (F.col("v") - F.col("_m")) / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0)).drop("_m", "_n")
    ranked = ranks(settled(x), ["cid"], ["v", "node"])
    return ranked.select("node", "cid", F.when(F.col("rank") <= F.floor(F.col("n") / 2), 0).otherwise(1).alias("side"))


def separators(inner: DataFrame, sides: DataFrame) -> DataFrame:
    """sides (node, cid, side) with side 2 for the nodes of each cluster's larger side (on equal sizes, side 1) that touch
    the other one."""
    counts = sides.groupBy("cid").agg(F.sum("side").alias("_right"), F.count("*").alias("_all"))
    big = counts.select("cid", F.when(2 * F.col("_right") >= F.col("_all"), 1).otherwise(0).alias("_big"))
    touch = inner.join(sides.select(F.col("node").alias("src"), F.col("side").alias("_s")), "src").join(sides.select(F.col("node").alias("dst"), F.col("side").alias("_t")), "dst")
    touch = touch.where("_s <> _t").select(F.col("src").alias("node")).distinct().withColumn("_touch", F.lit(True))
    x = sides.join(big, "cid").join(touch, "node", "left")
    return x.select("node", "cid", F.when((F.col("side") == F.col("_big")) & F.col("_touch"), 2).otherwise(F.col("side")).alias("side"))


def algebraic_tree(e: DataFrame, every: DataFrame, leaf_size: int = 60, dissect: bool = False, spectral: bool = False, max_level: int = 38) -> tuple[DataFrame, DataFrame]:
    """Cluster tree (cid, parent, lvl, first, last, is_leaf, is_domain) and permutation from a graph alone.

    All clusters of a level are divided together, so a level costs as many jobs as one cluster's search, whatever the
    number of clusters. With `dissect`, a cluster's vertex separator becomes a third son and the other two are domains.
    A cluster is a leaf at or below leaf_size, or if a division leaves it whole; ids have room for 38 levels, and clusters
    that are still too large there are an error.
    """
    base = 3 if dissect else 2
    now = settled(every.select("node").distinct().select("node", *[F.lit(0).cast("long").alias(c) for c in ("cid", "parent", "first")], F.lit(dissect).alias("is_domain")))
    clusters, placed = [], []
    for lvl in range(max_level + 1):
        here = now.groupBy("cid", "parent", "first", "is_domain").agg(F.count("*").alias("n"))
        here = settled(here.withColumns({"lvl": F.lit(lvl), "is_leaf": F.col("n") <= leaf_size}))
        live = settled(now.join(here.where("not is_leaf").select("cid", "n"), "cid"))
        if not live.limit(1).count():
            clusters.append(here)
            placed.append(now.select("node", "cid", "first"))
            break
        if lvl == max_level:
            raise ValueError(f"clusters of more than {leaf_size} nodes are left at level {max_level}")
        inner = settled(within(e, live))
        sides = settled((spectral_parts if spectral else bisect_parts)(inner, live.select("node", "cid", "n")))
        sides = settled(separators(inner, sides)) if dissect else sides
        counts = sides.groupBy("cid").agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"n{s}") for s in range(3)])
        going = counts.where(F.greatest("n0", "n1", "n2") < F.col("n0") + F.col("n1") + F.col("n2"))
        level = settled(here.join(going.select("cid", F.lit(True).alias("_go")), "cid", "left").withColumn("is_leaf", F.col("_go").isNull()).drop("_go"))
        clusters.append(level)
        placed.append(now.join(level.where("is_leaf").select("cid"), "cid", "left_semi").select("node", "cid", "first"))
        start = F.when(F.col("side") == 0, 0).when(F.col("side") == 1, F.col("n0")).otherwise(F.col("n0") + F.col("n1"))
        sons = sides.join(going, "cid").join(level.select("cid", "first", "is_domain"), "cid")
        now = settled(sons.select("node", (F.col("cid") * base + 1 + F.col("side")).alias("cid"), F.col("cid").alias("parent"), (F.col("first") + start).alias("first"), (F.col("is_domain") & (F.col("side") < 2)).alias("is_domain")))
    tree, order = clusters[0], placed[0]
    for c, p in zip(clusters[1:], placed[1:], strict=True):
        tree, order = tree.unionByName(c), order.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("cid").orderBy("node")) - 1
    tree = tree.select("cid", "parent", "lvl", "first", (F.col("first") + F.col("n") - 1).alias("last"), "is_leaf", "is_domain")
    return settled(tree), settled(order.select(F.col("node").alias("e"), (F.col("first") + rank).cast("long").alias("i")))
