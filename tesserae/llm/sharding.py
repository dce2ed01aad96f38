"""Sharding by weighted rendezvous hashing of stable record keys.

A record scores every shard from a digest of its key and the shard's number; the best score wins. A new shard changes
nothing between the old ones, so only records that it wins move, and they all move into it. Weights scale the scores:
with u uniform in (0, 1), the smallest -ln(u) / weight wins with a probability proportional to the weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_offsets


def score(key: Column, shard: int, weight: float) -> Column:
    """Smaller is better; 52 bits of the digest are used, so a score is exact in a double before the logarithm."""
    digest = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{shard}"))), 1, 13), 16, 10).cast("double")
    return -F.log((digest + 1) / F.lit(float(2**52 + 1))) / F.lit(float(weight))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The winning shard of a key; shards of weight 0 are never chosen, ties go to the lower shard."""
    scores = [F.struct(score(key, k, w).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*scores))["shard"]


def shard(docs: DataFrame, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """Place docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    law 'key': doc_id and the shard count decide; grown_shard is the shard with one more. Slots number a shard's rows
    from 0 without gaps, in the order of a digest of id and checksum; they are counted through digest buckets, so no task
    holds a shard. A null doc_id is one key of its own; a null text has size 1 and checksum 0. Equal rows get slots of
    their own. An empty table gives no rows; further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("_key"))
    pairs = [F.struct(score(F.col("_key"), k, w).alias("score"), F.lit(k).alias("shard")) for k, w in enumerate(weights) if w > 0]
    best = F.array_min(F.array(*pairs))
    grown = F.struct(score(F.col("_key"), len(weights), grown_weight).alias("score"), F.lit(len(weights)).alias("shard"))
    placed = sized.withColumn("_best", best).withColumn("_grown", F.least(F.col("_best"), grown))
    placed = placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("_best.shard").alias("shard"), F.col("_grown.shard").alias("grown_shard"), F.md5(F.concat_ws("|", "_key", "text_crc32", "size")).alias("_order"))
    placed = placed.withColumn("_bucket", F.substring("_order", 1, 3))
    offsets = running_offsets(placed, ["shard"], "_bucket", F.lit(1), "_before")
    place = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_order"))
    rows = placed.withColumn("_place", place).join(offsets, ["shard", "_bucket"])
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_place") - 1).cast("long").alias("slot"), "grown_shard")
