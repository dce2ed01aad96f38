"""Document fingerprints: threshold-scaled sketches of word shingles.

A document's shingles are its runs of five words (with fewer words: all of them as one). A shingle is kept if its digest,
read as a fraction, is below a fixed one: here if its first hex digit is among KEEP. Sketches of any two documents are
comparable whatever their lengths, the sketch of a union is the union of the sketches, and the share of one sketch in
another estimates containment without bias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quantile_bounds, range_bucket, words

#: A shingle is kept if its digest's first hex digit is below this: 2 of 16, or one in eight.
KEEP, SHINGLE, DIGITS = "2", 5, 8


def sketch(text: Column) -> Column:
    """The kept digests of a text's shingles, distinct and ascending, as an array of DIGITS hex digits; null is empty."""
    def shingles(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.md5(F.array_join(F.slice(w, i, F.lit(SHINGLE)), " ")))
        return F.when(F.size(w) >= SHINGLE, runs).when(F.size(w) > 0, F.array(F.md5(F.array_join(w, " ")))).otherwise(F.array().cast("array<string>"))

    # the words are bound as a lambda's variable, so that the text is split once and not for every shingle
    kept = F.filter(F.transform(F.array(words(text)), shingles)[0], lambda h: h < KEEP)
    return F.array_sort(F.array_distinct(F.transform(kept, lambda h: F.substring(h, 1, DIGITS))))


def fingerprint(kept: Column, n_words: Column) -> Column:
    """The sketch as text: the number of words, then the digests; the digests of two such texts merge by union."""
    return F.concat_ws(":", n_words.cast("string"), F.array_join(kept, ""))


def likeness(a: Column, b: Column, equal: Column) -> Column:
    """Containment of the smaller sketch in the larger; 1 for equal texts, 0 if either sketch is empty otherwise."""
    least = F.least(F.size(a), F.size(b))
    return F.when(equal, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (doc_id, text) with kept (the sketch) and digest, and the next row's text, kept and digest, in ascending doc_id
    order, cyclic.

    Rows are cut into ranges of ids of about equal counts; within a range the next row is a window function, and the last
    row of a range gets the first of the next range from a table of one row a range. Only texts move; each is sketched
    where it arrives, and the ranges' first ones once more. A null id comes first; equal ids follow their texts' order.
    """
    bounds = quantile_bounds(docs, "doc_id", ranges)
    ranged = docs.withColumn("_range", range_bucket(F.col("doc_id"), bounds))
    sketched = lambda text: (sketch(text).alias("kept"), F.md5(text).alias("digest"))
    first = ranged.groupBy("_range").agg(F.min(F.struct("doc_id", "text")).alias("f"))
    first = first.select("_range", F.struct("f.doc_id", "f.text", *sketched(F.col("f.text"))).alias("_first"))
    ranged = ranged.repartition("_range").select("*", *sketched(F.col("text")))
    order = Window.orderBy("_range")
    wrapped = F.first("_first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = first.select("_range", F.coalesce(F.lead("_first").over(order), wrapped).alias("_head"))
    within = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = ranged.withColumn("_next", F.lead(F.struct("doc_id", "text", "kept", "digest")).over(within)).join(heads, "_range")
    return rows.withColumn("_next", F.coalesce("_next", "_head")).drop("_head", "_range")


def fingerprints_with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Sketch every text of docs (doc_id, text) and its edited text, whose last quarter of code points is replaced by as
    many first ones (or all) of the next document's text.

    Returns doc_id, n_chars, text, edited, kept, edited_kept, next_kept, near_edited, near_next. Null texts are empty. A
    single row is its own next. Repeated rows follow each other; other columns are ignored. With one shingle in eight kept,
    a short text may keep none: its likeness to any text but an equal one is 0.
    """
    # several ranges a task, so that tasks have about equal numbers of them
    ranges = parts or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = with_next(rows, ranges).withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("_next.text"), F.lit(1), quarter))
    rows = rows.withColumn("edited", edited).withColumn("edited_kept", sketch(F.col("edited")))
    return rows.select("doc_id", "n_chars", "text", "edited", "kept", "edited_kept", likeness(F.col("kept"), F.col("edited_kept"), F.col("text") == F.col("edited")).alias("near_edited"), likeness(F.col("kept"), F.col("_next.kept"), F.col("digest") == F.col("_next.digest")).alias("near_next"))
