"""Block-cluster trees write each level once and refine many pairs in more tasks than one."""

from pyspark.sql import functions as F

from tesserae.operators import block_cluster as bc
from tesserae.operators import cluster


def test_each_level_is_written_once(spark, monkeypatch):
    points = spark.range(64).select(F.col("id").alias("dof"), F.array(F.col("id").cast("double")).alias("x"))
    tree, _ = cluster.build(points, leaf_size=8)
    plain = sorted(tuple(r) for r in bc.build(tree, tree, bc.strong(2.0)).collect())
    calls, settled = [], bc.settled
    monkeypatch.setattr(bc, "settled", lambda df: calls.append(df) or settled(df))
    monkeypatch.setattr(bc, "PAIRS_A_TASK", 3)
    found = sorted(tuple(r) for r in bc.build(tree, tree, bc.strong(2.0)).collect())
    assert found == plain and [r[0] for r in found] == list(range(len(found)))
    levels = 1 + max(r[2] for r in found)
    assert levels == 4 and len(calls) == levels + 3  # and two sides and the whole
