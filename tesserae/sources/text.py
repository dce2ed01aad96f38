"""Text files with line numbers, read in parallel; .gz and .bz2 are opened by Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of a file, or of a folder's part files in the order of their names, numbered from 0.

    Lines are counted per block of a file, and a block's offset is the sum of the earlier blocks' counts (one row a
    block), so no task sees a whole file.
    """
    raw = spark.read.text(path).select(F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at")).alias("block"), F.monotonically_increasing_id().alias("k"), "value")
    counts = raw.groupBy("block").agg(F.count("*").alias("c"))
    offsets = counts.select("block", F.coalesce(F.sum("c").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ranked = raw.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("k")) - 1)
    return ranked.join(F.broadcast(offsets), "block").select((F.col("offset") + F.col("r")).alias("n"), "value")


def fields(value: Column | str = "value") -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")


def number(parts: Column, k: int, kind: str = "double") -> Column:
    """Field k as a number; Fortran's exponent letter D is read as E."""
    return F.regexp_replace(F.get(parts, F.lit(k)), "[dD]", "E").cast(kind)


def head(spark: SparkSession, path: str, lines: int) -> list[str]:
    """The first lines of a file, or of a folder's first part files, for headers. Only lines at the files' beginnings are
    ranked, and a file's lines are read no further than asked for."""
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    names = [r["file"] for r in spark.read.text(path).select(F.col("_metadata.file_name").alias("file")).distinct().orderBy("file").collect()]
    found: list[str] = []
    for name in names:
        rows = spark.read.text(path).select(at.alias("at"), "value").where(F.col("at.file") == name).orderBy("at").limit(lines - len(found))
        found += [r["value"] for r in rows.collect()]
        if len(found) >= lines:
            break
    return found


def write_lines(df: DataFrame, path: str, header: list[str] | None = None, order: list[str] | None = None) -> None:
    """The column `value` as text files in the folder path, sorted by `order`, with header lines first."""
    spark = df.sparkSession
    body = df.select(F.lit(1).alias("_part"), *[c for c in df.columns])
    if header:
        lines = spark.createDataFrame([(0, n, v) for n, v in enumerate(header)], "_part int, _n long, value string")
        body = lines.unionByName(body.withColumn("_n", F.lit(None).cast("long")), allowMissingColumns=True)
        body.orderBy("_part", "_n", *(order or [])).select("value").write.mode("overwrite").text(path)
    else:
        (body.orderBy(*order) if order else body).select("value").write.mode("overwrite").text(path)
