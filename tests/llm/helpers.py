"""Fixture rows that every operator must bear: nulls, empty and repeated texts, equal ids, clashing extra columns."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("_bucket", T.StringType()), ("size", T.LongType()), ("shard", T.StringType())]])

LONG = " ".join(f"word{k % 997} é{k % 31}" for k in range(30_000))
TEXTS = [
    (1, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "a"),
    (2, "one two three four five six seven", "en", "a"),
    (3, "", "en", None),
    (4, None, None, "b"),
    (None, "lonely text\nwith two lines", "de", "b"),
    (None, None, None, None),
    (5, "   \t\n ", "fr", "c"),
    (6, "ünïcødé ẞ 漢字 <|endoftext|> 🙂 it's we'll", "fr", "c"),
    (7, LONG, "en", "a"),
    (8, "12345 67890", "es", "d"),
]


def fixture(spark):
    return spark.createDataFrame([(*row, None if row[1] is None else len(row[1]), "x", 9, "y") for row in TEXTS], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
