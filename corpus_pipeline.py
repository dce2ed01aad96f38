"""A training corpus from `documents`: language ID, line dedup, near-dedup, mixing and packing, each over whole tables.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and further columns whatever their names. Null and empty
texts: the first stage rejects them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import documents, word_count, written
from tesserae.llm.encoding import tokenizer_path
from tesserae.llm.langid import held_out, identify, train
from tesserae.llm.line_dedup import find_repeats, without_repeats
from tesserae.llm.minhash import near_duplicates
from tesserae.llm.mixing import mix
from tesserae.llm.packing import pack

#: A document is rejected if its best language is less likely than all others together.
LEAST_SCORE = 0.5


def whole_rows(docs: DataFrame) -> DataFrame:
    """docs as one column `row`, so that no column of theirs has the name of a working column."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language by the model: those without a letter, or with no language at LEAST_SCORE, go."""
    columns = docs.columns
    found = identify(docs, train(docs.where(~held_out())), keep=columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier ones; a document goes if no word is left of it. n_chars follows the text."""
    kept = without_repeats(docs, find_repeats(docs)).where(word_count(F.col("text")) > 0)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: five-word shingles, similarity 0.8."""
    rows = near_duplicates(docs, width=5)
    group = F.coalesce(F.col("component").cast("string"), F.concat(F.lit("empty "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("text_hash")))
    first = rows.groupBy(group).agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    own = whole_rows(docs).withColumns({"id": F.col("row.doc_id"), "hash": F.xxhash64("row.text")})
    kept = own.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")), "left_semi")
    # rows repeated as they are are one document
    return kept.dropDuplicates(["id", "hash"]).select(*columns_of(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (at most twice), in the order of their virtual finish times."""
    digest = F.xxhash64("text", "source").alias("digest")
    taken = mix(docs.select("doc_id", "text", "source", digest), carry=("digest",)).where("copies > 0")
    taken = taken.groupBy("doc_id", "digest").agg(F.max("copies").alias("copies"), F.min("finish").alias("finish"))
    rows = whole_rows(docs).withColumn("hash", F.xxhash64("row.text", "row.source"))
    rows = rows.join(taken, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("digest")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.orderBy("finish", "copy").select(*columns_of(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences, with checksums of their ids."""
    # workers keep less here, since the JVMs hold what the stages before have left
    pieces = pack(docs, tokenizer_path(), end_id=2, rows_at_once=500, kept=200_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Language ID, MinHash and byte-pair encoding have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
