"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order fixed by a digest of its id, gets a virtual finish time: the source's
tokens up to and including it, over the source's weight. Each further epoch of a source follows on its first. Sorting all
copies by virtual finish time interleaves the sources in proportion to their weights, and a source that has no copies left
simply drops out, which shares its excess by weight. The mix is that order cut where the total budget is reached.

No task sees a whole source: a source's running sum goes over digest buckets (their totals form a small table), and the
cut is found by dividing the range of finish times, whose bucket totals are at most SPLIT rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offsets, word_count, written

#: Ranges of virtual time that one pass of the cut search counts, and the rows below which a range is simply sorted.
SPLIT, SORTED_ROWS = 4096, 200_000


def source_targets(sources: DataFrame, budget: float, epochs: int) -> DataFrame:
    """sources (source, weight, source_size) with target: shares of budget by weight, none above epochs * source_size.

    The windows run over one row a source. Sources fill up in ascending order of capacity over weight; a source is full
    if its capacity is within its share of what the fuller ones leave. Zero weight or size gives a target of 0.
    """
    by = Window.orderBy(F.col("_ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    earlier, later = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    cap = (F.lit(epochs) * F.col("source_size")).cast("double")
    ranked = (
        sources.withColumn("_cap", cap)
        .withColumn("_ratio", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")))
        .withColumn("_left", F.lit(float(budget)) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(later))
        .withColumn("_full", F.col("_cap") * F.col("_weights") <= F.col("weight") * F.col("_left"))
    )
    level = Window.partitionBy()
    # the first source that is not full has the largest level, and all later ones share by it
    share = F.coalesce(F.max(F.when(~F.col("_full"), F.col("_left") / F.col("_weights"))).over(level), F.lit(0.0))
    return ranked.select("source", "weight", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * share).alias("target"))


def fair_queue(sized: DataFrame, targets: DataFrame, budget: float, epochs: int, label: str = "mix") -> tuple[DataFrame, tuple]:
    """sized (doc_id, source, size, order_key, ...) with its finish times. Returns (the written queue, the cut).

    Columns added: source_size, target, weight, and cum (the source's tokens up to this document). A document's copy of
    epoch e finishes at (e * source_size + cum) / weight; it is taken if (finish, weight rank, e, order_key) is at or
    before the cut. Copies of size 0 take nothing. Ties are broken by source, epoch, digest.
    """
    ranked = targets.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    rows = sized.join(ranked, sized["source"].eqNullSafe(ranked["source"])).drop(ranked["source"])
    rows = rows.withColumn("_bucket", F.substring("order_key", 1, 3))
    offsets = running_offsets(rows, ["source_rank"], "_bucket", F.col("size"), "_before")
    within = Window.partitionBy("source_rank", "_bucket").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.sum("size").over(within)).join(offsets, ["source_rank", "_bucket"])
    rows = written(rows.withColumn("cum", F.col("_before") + F.col("_in")).drop("_bucket", "_before", "_in"), label)
    copies = rows.where("size > 0 and weight > 0").select(F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "source_rank", "order_key", "size", "cum", "source_size", "weight")
    copies = copies.select(finish(F.col("epoch")).alias("finish"), "source_rank", "epoch", "order_key", "size")
    return rows, cut_at(copies, budget)


def finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("cum")).cast("double") / F.col("weight").cast("double")


def cut_at(copies: DataFrame, budget: float) -> tuple | None:
    """The last (finish, source_rank, epoch, order_key) whose running size is within budget; None if there is none."""
    left, low, high = budget, *copies.agg(F.min("finish"), F.max("finish")).first()
    if low is None:
        return None
    best = None
    while True:
        inside = copies.where(F.col("finish").between(low, high))
        width = (high - low) / SPLIT
        if width <= 0 or inside.count() <= SORTED_ROWS:
            break
        part = F.least(F.floor((F.col("finish") - low) / width), F.lit(SPLIT - 1))
        by = inside.groupBy(part.alias("part")).agg(F.sum("size").alias("size"), F.min("finish").alias("low"), F.max("finish").alias("high"))
        totals = by.withColumn("upto", F.sum("size").over(Window.orderBy("part")))
        crossing = totals.where(F.col("upto") > left).orderBy("part").select("low", "high", (F.col("upto") - F.col("size")).alias("before")).first()
        if crossing is None:
            low = high
            break
        if (crossing["low"], crossing["high"]) == (low, high):
            break
        low, high, left = crossing["low"], crossing["high"], left - crossing["before"]
    order = ["finish", "source_rank", "epoch", "order_key"]
    inside = copies.where(F.col("finish").between(low, high)).withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    best = inside.where(F.col("upto") <= left).orderBy(*[F.col(c).desc() for c in order]).select(*order).first()
    if best is None:  # the crossing range begins with a copy that is too long: all before it are taken
        last = copies.where(F.col("finish") < low).orderBy(*[F.col(c).desc() for c in order]).select(*order).first()
        return tuple(last) if last else None
    return tuple(best)


def copies_taken(cut: tuple | None, epochs: int) -> Column:
    """How many of a document's copies lie at or before the cut."""
    if cut is None:
        return F.lit(0)
    at = F.struct(*[F.lit(x) for x in cut])
    one = lambda e: F.when((F.col("weight") > 0) & (F.struct(finish(F.lit(e)), F.col("source_rank"), F.lit(e), F.col("order_key")) <= at), 1).otherwise(0)
    return sum((one(e) for e in range(epochs)), F.lit(0))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2, size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document of docs (doc_id, text, source): doc_id, size, source_size, target, taken, copies, finish.

    Weights repeat over the sources in code point order, null last. A null text has size 0, is never taken and has 0
    copies; an empty table gives no rows. Other columns of docs are ignored. Rows with equal doc_id share their place in
    the shuffle, longer ones last. Equal inputs give equal results. Columns named by `carry` come along.
    """
    sized = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order_key"), *carry)
    sized = written(sized, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = source_targets(sources, share * total, epochs)
    rows, cut = fair_queue(sized, targets, share * total, epochs)
    copies = F.when(F.col("size") > 0, copies_taken(cut, epochs)).otherwise(0).cast("long")
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * copies).alias("taken"), copies.alias("copies"), finish(F.lit(0)).alias("finish"), *carry)
