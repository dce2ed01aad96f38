"""What iterations need: lineage that ends, in a place that outlives executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; a temporary folder serves only where none is set and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tesserae-"))
    return _own[0]


def scratch(spark, name: str) -> str:
    """A path in the shared folder that nobody else uses, ending in name."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of df in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: for tables that are too large for checkpoints, which are not compressed."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a group that one task may sort for its ranks.
RANKED_ROWS = 1_000_000


def ranks(df: DataFrame, by: list[str], order: list, name: str = "rank", limit: int | None = None) -> DataFrame:
    """df with each row's rank (from 1) within its group, by the order given, which should leave no ties.

    Groups of at most RANKED_ROWS are ranked by a window. Beyond that the rows are range-partitioned by group and order,
    which settles them in pieces; a piece's offset is the sum of the earlier pieces' counts in its group, so no task
    sorts more than a piece.
    """
    limit = RANKED_ROWS if limit is None else limit
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    pieces = max(2, -(-df.count() // limit))
    keys = [F.col(c) for c in by] + [F.expr(o) if isinstance(o, str) else o for o in order]
    cut = settled(df.repartitionByRange(pieces, *keys).withColumn("_piece", F.spark_partition_id()))
    counts = cut.groupBy(*by, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*by, "_piece").orderBy(*order))
    return cut.withColumn("_here", here).join(offsets, [*by, "_piece"]).withColumn(name, F.col("_before") + F.col("_here")).drop("_piece", "_here", "_before", "_n")


#: Pairs that one task makes, and rows of a side that every task may hold.
PAIRS_A_TASK, HELD_ROWS = 1 << 22, 1_000_000


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of left with all of right, neither of them shuffled by a key: left is dealt out so that a task makes about
    PAIRS_A_TASK pairs, however few files it came from, and right is held by every task if it has at most HELD_ROWS."""
    m, n = left.count(), right.count()
    dealt = left.repartition(max(1, min(m, -(-m * n // PAIRS_A_TASK))))
    return dealt.crossJoin(F.broadcast(right) if n <= HELD_ROWS else right)


def rounded(x: Column, digits: int) -> Column:
    """round(x, digits), half away from zero as in SQL, without a decimal number for each of very many rows."""
    unit = F.lit(10.0**digits)
    quick = F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit + 0.0  # no negative zero
    return F.when(F.abs(x) * unit < 1e15, quick).otherwise(F.round(x, digits))
