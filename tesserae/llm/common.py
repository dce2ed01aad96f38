"""Shared helpers: the shared folder, written intermediate tables, distributed prefix sums and connected components.

Null handling used by every operator here: a null text is an empty text; a null doc_id is an ordinary value that sorts
first. Rows that agree in doc_id and text are one document for all decisions and each keeps its own output row.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if all runs in one process,
    and an error on a cluster, whose machines don't share such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="tesserae-"))
    return _own_folder[0]


def written(df: DataFrame, label: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation. Options
    go to the writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def let_go(spark: SparkSession) -> None:
    """The driver's collector is asked to run, since the shuffle files of finished writes go with it."""
    spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete written tables whose last reader has itself been written, and let shuffle files go."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        let_go(tables[0].sparkSession)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what one Arrow batch holds, so that whole texts of any length fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The maximal runs of non-space characters as an array; empty for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_offsets(df: DataFrame, group: list[str], bucket: str, amount: Column, name: str) -> DataFrame:
    """Per (group, bucket), the sum of `amount` over the group's earlier buckets: one row a bucket, so the window is small."""
    totals = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(name))


def range_bucket(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are <= value (null: 0), by a search on two levels of literal arrays."""
    if not bounds:
        return F.lit(0)
    step = 64
    kind = lambda xs: F.array(*[F.lit(x) for x in xs])
    if len(bounds) <= step:
        return F.coalesce(F.size(F.filter(kind(bounds), lambda b: b <= value)), F.lit(0))
    coarse = F.size(F.filter(kind(bounds[::step]), lambda b: b <= value))
    fine = F.size(F.filter(F.slice(kind(bounds), (F.greatest(coarse, F.lit(1)) - 1) * step + 1, F.lit(step)), lambda b: b <= value))
    return F.when(value.isNull() | (coarse == 0), F.lit(0)).otherwise((coarse - 1) * step + fine)


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list:
    """At most parts-1 ascending cut points of a numeric column; the list is as long as the number of partitions asked for."""
    if parts < 2:
        return []
    cut = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"]
    return sorted(set(cut or []))


#: Edges whose components one task finds: two longs each.
HELD_EDGES = 200_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a, b, and for each the smallest node that it is linked with. Each root is hung below the smallest
    root next to it, and all nodes below their roots, until no edge has two roots."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        p, q = root[x], root[y]
        least = np.minimum(p, q)
        np.minimum.at(root, p, least)
        np.minimum.at(root, q, least)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, nodes: DataFrame | None = None, label: str = "components", held: int = HELD_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component = smallest node reachable).

    At most `held` distinct edges are solved in one task, since a round costs jobs and files whatever its size. More go by
    large-star and small-star rounds: in each, every node is linked with the smallest of its neighbours, so long chains
    shrink by halves and no group of neighbours is gathered as an array. Each round is written, which cuts the lineage.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    if now.count() <= held:

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if whole := list(batches):
                ends = [np.concatenate([batch.column(k).to_numpy() for batch in whole]) for k in range(2)]
                yield pa.record_batch([pa.array(x) for x in smallest_reachable(*ends)], ["node", "component"])

        found = written(now.coalesce(1).mapInArrow(solve, "node long, component long"), label)
        dropped(now)
        return found if nodes is None else nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    before = None
    while True:
        # large star: neighbours larger than the node go to the smallest neighbour
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        earlier, now = now, written(small, label)
        dropped(earlier)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if nodes is None:
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
        return found.unionByName(roots)
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Rows of a few fixed-width columns below which a counted table is broadcast.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows; give it written tables of few fixed-width columns."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
