"""Block-cluster trees: pairs of clusters, refined level by level until admissible or small.

A level is one join of the frontier with the sons of both trees on parent ids; an admissibility condition is a predicate
on the two clusters' columns (prefixes r_ and c_).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .iterate import RANKED_ROWS, ranks, settled

#: Pairs that one task refines.
PAIRS_A_TASK = 4096

Condition = Callable[[], Column]


def _box(p: str) -> tuple[Column, Column]:
    return F.col(f"{p}_bbmin"), F.col(f"{p}_bbmax")


def off_diagonal() -> Column:
    return F.col("r_cid") != F.col("c_cid")


def strong(eta: float = 2.0, largest: bool = False, period: list[float] | None = None) -> Condition:
    """The smaller (or larger) diameter is at most eta times the distance; never for one cluster with itself, always for
    two different domains."""

    def test() -> Column:
        r, c = _box("r"), _box("c")
        size = (F.greatest if largest else F.least)(g.diameter(*r), g.diameter(*c))
        d = g.periodic_distance(*r, *c, period) if period else g.distance(*r, *c)
        return off_diagonal() & ((F.col("r_is_domain") & F.col("c_is_domain")) | (size <= eta * d))

    return test


def weak(overlaps: int = 0, tolerance: float = 0.0, eta: float = 2.0) -> Condition:
    """The boxes overlap in at most so many axes (touching is no overlap), or the strong condition holds."""

    def test() -> Column:
        return off_diagonal() & ((g.overlap_dim(*_box("r"), *_box("c"), tolerance) <= overlaps) & (g.distance(*_box("r"), *_box("c")) >= 0) | strong(eta)())

    return test


def high_low_frequency(kappa: float, max_waves: float, eta: float = 2.0) -> Condition:
    """Only where the smaller box spans at most max_waves wave lengths per axis; then the larger diameter counts."""

    def test() -> Column:
        side = lambda p: F.array_max(g.subtract(*reversed(_box(p))))
        low = F.least(side("r"), side("c")) * kappa <= max_waves
        return low & strong(eta, largest=True)()

    return test


def build(rows: DataFrame, columns: DataFrame, admissible: Condition, least_level: int = 0, same_level: bool = True, max_level: int = 40) -> DataFrame:
    """(bid, parent, lvl, row_cid, col_cid, adm, is_leaf) of two cluster trees.

    A pair is a leaf if it is admissible at or below least_level, or if (same_level) either cluster is a leaf, or if both
    are. Otherwise it is refined to the pairs of sons; without same_level a leaf stays while the other side is refined.
    """
    def side(tree: DataFrame, p: str) -> DataFrame:
        columns_ = [c for c in ("cid", "parent", "is_leaf", "is_domain", "bbmin", "bbmax", "first", "last") if c in tree.columns]
        return settled(tree.select(*[F.col(c).alias(f"{p}_{c}") for c in columns_], F.col("lvl").alias(f"{p}_lvl")))

    r, c = side(rows, "r"), side(columns, "c")
    front = r.where("r_lvl = 0").crossJoin(c.where("c_lvl = 0")).withColumn("up", F.lit(0).cast("long"))
    top, most = 0, 1  # ids used so far, and the most pairs that the next level can have
    every = None
    for lvl in range(max_level + 1):
        adm = admissible() & F.lit(lvl >= least_level)
        small = (F.col("r_is_leaf") | F.col("c_is_leaf")) if same_level else (F.col("r_is_leaf") & F.col("c_is_leaf"))
        tested = front.withColumn("adm", adm).withColumn("is_leaf", F.col("adm") | small)
        # a level's pairs are numbered by their clusters, behind all levels before
        order = ["r_cid", "c_cid"]
        if most <= RANKED_ROWS:  # known without counting them
            found = tested.withColumn("bid", F.row_number().over(Window.orderBy(*order)))
        else:
            found = ranks(settled(tested), [], order, "bid")
        judged = settled(found.withColumns({"bid": F.col("bid").cast("long") + (top - 1), "lvl": F.lit(lvl)}))
        made, going = judged.agg(F.count("*"), F.count(F.when(~F.col("is_leaf"), 1))).first()
        out = judged.select("bid", "up", "lvl", F.col("r_cid").alias("row_cid"), F.col("c_cid").alias("col_cid"), "adm", "is_leaf")
        every = out if every is None else every.unionByName(out)
        if not going:
            break
        top, most = top + made, going * 9  # at most three sons on each side
        sons = judged.where("not is_leaf").select(F.col("bid").alias("up"), F.col("r_cid").alias("rp"), F.col("c_cid").alias("cp"), F.col("r_is_leaf").alias("rl"), F.col("c_is_leaf").alias("cl"))
        if going > PAIRS_A_TASK:  # numbering left them in one task
            sons = sons.repartition(-(-going // PAIRS_A_TASK))
        x = sons.join(r, F.when(F.col("rl"), F.col("r_cid") == F.col("rp")).otherwise((F.col("r_parent") == F.col("rp")) & (F.col("r_lvl") > 0))) if not same_level else sons.join(r.where("r_lvl > 0"), F.col("r_parent") == F.col("rp"))
        x = x.join(c, F.when(F.col("cl"), F.col("c_cid") == F.col("cp")).otherwise((F.col("c_parent") == F.col("cp")) & (F.col("c_lvl") > 0))) if not same_level else x.join(c.where("c_lvl > 0"), F.col("c_parent") == F.col("cp"))
        front = x.select(*r.columns, *c.columns, "up")
    return settled(every.select("bid", F.col("up").alias("parent"), "lvl", "row_cid", "col_cid", "adm", "is_leaf"))


def sparsity_constant(tree: DataFrame, admissible: bool | None = None) -> DataFrame:
    """The most leaves (all, admissible or inadmissible ones) of a row or column cluster."""
    leaf = tree.where("is_leaf")
    leaf = leaf if admissible is None else leaf.where(F.col("adm") == F.lit(admissible))
    count = lambda c: leaf.groupBy(c).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return count("row_cid").union(count("col_cid")).agg(F.max("n").alias("c_sp"))


def to_blocks(tree: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Leaf index ranges: block_id, adm, row_first, row_last, col_first, col_last."""
    r = rows.select(F.col("cid").alias("row_cid"), F.col("first").alias("row_first"), F.col("last").alias("row_last"))
    c = columns.select(F.col("cid").alias("col_cid"), F.col("first").alias("col_first"), F.col("last").alias("col_last"))
    return tree.where("is_leaf").join(r, "row_cid").join(c, "col_cid").select(F.col("bid").alias("block_id"), "adm", "row_first", "row_last", "col_first", "col_last")


def graph_admissible(pairs: DataFrame, rows: DataFrame, edges: DataFrame, perm: DataFrame, distance: int = 1, most_edges: int = 0) -> DataFrame:
    """Weak algebraic admissibility of cluster pairs (row_cid, col_cid): no path of at most `distance` edges between them,
    or at most most_edges of such links. Edges name dofs; the result has `links` and `adm`."""
    own = edges.join(perm.select(F.col("e").alias("src"), F.col("i").alias("si")), "src").join(perm.select(F.col("e").alias("dst"), F.col("i").alias("di")), "dst").select("si", "di").distinct()
    reach = own
    for _ in range(distance - 1):
        step = reach.select("si", F.col("di").alias("m")).join(own.select(F.col("si").alias("m"), "di"), "m").select("si", "di")
        reach = settled(reach.union(step).distinct())
    x = pairs.join(rows.select(F.col("cid").alias("row_cid"), F.col("first").alias("rf"), F.col("last").alias("rl")), "row_cid")
    x = x.join(rows.select(F.col("cid").alias("col_cid"), F.col("first").alias("cf"), F.col("last").alias("cl")), "col_cid")
    width = x.agg(F.max(F.col("rl") - F.col("rf") + 1)).first()[0] or 1
    binned = x.withColumn("bin", F.explode(F.sequence(F.floor(F.col("rf") / width), F.floor(F.col("rl") / width))))
    hit = binned.join(reach.withColumn("bin", F.floor(F.col("si") / width)), "bin").where("si between rf and rl and di between cf and cl")
    links = hit.groupBy("row_cid", "col_cid").agg(F.count("*").alias("links"))
    out = pairs.join(links, ["row_cid", "col_cid"], "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return out.withColumn("adm", (F.col("row_cid") != F.col("col_cid")) & (F.col("links") <= most_edges))


def graph_distance_admissible(edges: DataFrame, left: DataFrame, right: DataFrame, eta: float = 2.0) -> bool:
    """Standard algebraic admissibility of two node sets: their distance is at least the smaller diameter over eta."""
    from . import graph

    sizes = []
    for s in (left, right):
        inner = graph.restrict(edges, s)
        start = s.agg(F.min("node")).first()[0]
        sizes.append(graph.diameter(inner, start)[0])
    need = -(-min(sizes) // eta) if min(sizes) else 1
    near = graph.distances(edges, left, int(need) - 1) if need > 1 else left.select("node")
    return near.join(right.select("node"), "node", "left_semi").limit(1).count() == 0


def statistics(tree: DataFrame) -> DataFrame:
    return tree.agg(F.count("*").alias("nnodes"), F.max("lvl").cast("long").alias("depth"), F.count(F.when(F.col("is_leaf"), 1)).alias("leaves"), F.count(F.when(F.col("adm"), 1)).alias("admissible"))


def flattened(tree: DataFrame) -> DataFrame:
    """All leaves as sons of the root."""
    root = tree.where("lvl = 0").select("bid").first()[0]
    return tree.where("lvl = 0").withColumn("is_leaf", F.lit(False)).unionByName(tree.where("is_leaf and lvl > 0").withColumns({"parent": F.lit(root), "lvl": F.lit(1)}))
