"""Structured Streaming over coordinate updates: running products and windowed norms, as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_product(entries: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of A x where entries of A (i, j, v) arrive as a stream and repeat to add up; output mode 'complete' or 'update'."""
    rows = entries.join(x.select(F.col("i").alias("j"), F.col("v").alias("vx")), "j")
    return rows.groupBy("i").agg(F.sum(F.col("v") * F.col("vx")).alias("v"))


def windowed_norms(events: DataFrame, time: str, value: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per time window and key: count, sum of squares and the largest modulus; later events than `late` are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by)
    return w.agg(F.count("*").alias("n"), F.sum(F.col(value) ** 2).alias("squares"), F.max(F.abs(value)).alias("largest")).select(F.col("w.start").alias("start"), by, "n", "squares", "largest")
