"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 3 to 0 with method C escapes: a symbol seen c times in a context of n
symbols, d of them distinct, costs -log2(c / (n + d)) bits; an unseen one costs the escape, -log2(d / (n + d)), and is
coded in the next shorter context, at last uniformly over all 256 bytes. The statistics are frozen after learning, so the
code length of a text is a sum over its bytes. The tree is held sparsely: for each language and order the sorted contexts
with their escapes and the sorted contexts and symbols with their bits, so its size is that of what was seen. A block of
texts looks up each of its distinct grams once. The text's language is the one that codes it shortest; the score is its
share of the summed likelihoods.

Learning uses a bounded sample: at most `sample` labelled documents a language, those with the smallest digest of their
id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches
from .idle import busy, idle

#: Labelled documents learned from, by language.
SAMPLE = 1200
ORDER = 3


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts and the number of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, np.diff(offsets)


def with_context(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with ORDER zero bytes before each text, and the places of the texts' own bytes."""
    at = np.arange(len(flat)) + ORDER * (1 + np.repeat(np.arange(len(lengths)), lengths))
    out = np.zeros(len(flat) + ORDER * len(lengths), np.uint8)
    out[at] = flat
    return out, at


@dataclass
class Model:
    """Frozen statistics: for each language the grams (four bytes as one number) and their counts."""

    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]

    def key(self) -> int:
        return zlib.crc32(repr([(n, zlib.crc32(g.tobytes()), zlib.crc32(c.tobytes())) for n, g, c in zip(self.languages, self.grams, self.counts, strict=True)]).encode())

    def symbols(self) -> tuple[np.ndarray, int]:
        """A symbol for each byte value, which is its own whatever the languages, and how many there are."""
        return np.arange(256), 256

    def trees(self) -> list[list[Level]]:
        """For each language the levels of its context tree, from order ORDER to 0."""
        found = []
        for gram, count in zip(self.grams, self.counts, strict=True):
            levels = []
            for order in range(ORDER, -1, -1):
                keys, inverse = np.unique((gram & (1 << 8 * (order + 1)) - 1).astype(np.uint32), return_inverse=True)
                c = np.bincount(inverse, count, len(keys))
                contexts, own = np.unique(keys >> 8, return_inverse=True)
                n, d = np.bincount(own, c, len(contexts)), np.bincount(own, minlength=len(contexts))
                levels.append(Level(keys, -np.log2(c / (n + d)[own]), contexts, -np.log2(d / (n + d))))
            found.append(levels)
        return found


@dataclass
class Level:
    """What one order has seen: contexts with a symbol (as one number) and their bits, contexts and the bits of escapes."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def found_in(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted number whether the ascending keys have it, and the places of those that they have."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, at[hit]


def gram_bits(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each gram after the others: in the longest context that has it, with the escapes before."""
    out, left = np.zeros(len(grams)), np.arange(len(grams))
    for k, level in enumerate(levels):
        key = grams[left] & np.uint32((1 << 8 * (ORDER - k + 1)) - 1)
        hit, at = found_in(level.keys, key)
        out[left[hit]] += level.bits[at]
        left, key = left[~hit], key[~hit]
        hit, at = found_in(level.contexts, key >> 8)
        out[left[hit]] += level.escapes[at]
    out[left] += 8
    return out


_tables: dict[int, list[list[Level]]] = {}


def code_lengths(model: Model, texts: pa.Array, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language, and its bytes. Texts are scored whole, in blocks of bytes."""
    key = model.key()
    if key not in _tables:
        _tables.clear()
        _tables[key] = model.trees()
    trees = _tables[key]
    flat, lengths = utf8(texts)
    padded, at = with_context(flat, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    out = np.zeros((len(lengths), len(model.languages)))
    for a in range(0, len(at), block):
        i, own = at[a : a + block], owner[a : a + block]
        gram = np.zeros(len(i), np.uint32)
        for back in range(ORDER, -1, -1):
            gram = gram << 8 | padded[i - back]
        coded = pa.array(gram).dictionary_encode()
        distinct, place, first = coded.dictionary.to_numpy(), coded.indices.to_numpy(), own[0]
        for k, levels in enumerate(trees):
            sums = np.bincount(own - first, gram_bits(levels, distinct)[place])
            out[first : first + len(sums), k] += sums
    return out, lengths


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from docs (doc_id, text, lang): every row given counts as labelled if text and lang are not null."""
    small_batches(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64("text"))).alias("_digest"))
    draw = (F.conv(F.substring("_digest", 1, 8), 16, 10).cast("double") / 2.0**32).alias("_draw")
    counts = {r["lang"]: r["count"] for r in docs.where("text is not null and lang is not null").groupBy("lang").count().collect()}
    if not counts:
        return Model([], [], [])
    # twice the sample by a threshold on the digest, which no task sorts, and then exactly the smallest
    limit = F.lit(1.0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, min(1.0, (2 * sample + 50) / n)).otherwise(limit)
    drawn = rows.select("text", "lang", "_digest", draw).where(F.col("_draw") <= limit)
    drawn = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_digest", "text"))).where(F.col("_n") <= sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in sorted(set(langs)):
                padded, at = with_context(*utf8(batch.column(0).filter(pa.array(langs == lang))))
                wide = padded.astype(np.int64)
                held.setdefault(lang, []).append(np.unique(wide[at - 3] << 24 | wide[at - 2] << 16 | wide[at - 1] << 8 | wide[at], return_counts=True))
        for lang, parts in held.items():
            grams, inverse = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(grams)), pa.array(grams, pa.int64()), pa.array(n)], ["lang", "gram", "n"])

    found = drawn.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts)
    by = {lang: x.sort_values("gram") for lang, x in found.groupby("lang")}
    empty = found.iloc[:0]
    return Model(languages, [by.get(x, empty)["gram"].to_numpy(np.int64) for x in languages], [by.get(x, empty)["n"].to_numpy(np.int64) for x in languages])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, lang_pred, score (0 to 1), bits_per_byte; or, instead of doc_id
    and held_out, the columns of docs named by `keep`, which must not be called like the last three.

    lang_pred is 'und' with score 0 for a null text, one without a letter, or a model that has learned nothing. Ties go to
    the first language by name. bits_per_byte is null for texts without bytes. Equal texts get equal predictions; other
    columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    if keep is None:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").alias("_text"))
    else:
        rows = docs.select(*keep, F.col("text").alias("_text"))
    given = rows.schema.fields[:-1]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy()
        for batch in batches:
            texts = batch.column(len(given))
            n = len(texts)
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                bits, lengths = code_lengths(model, texts)
                best = bits.argmin(1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
                rate = bits.min(1) / np.maximum(lengths, 1)
            else:
                best, share, lengths, rate, letter = np.zeros(n, int), np.zeros(n), utf8(texts)[1], np.zeros(n), np.zeros(n, bool)
            names = np.array([*model.languages, "und"], object)
            columns = [*batch.columns[:-1], pa.array(names[np.where(letter, best, len(names) - 1)], pa.string()), pa.array(np.where(letter, share, 0.0)), pa.array(rate, mask=lengths == 0)]
            yield pa.record_batch(columns, [*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])
        idle(_tables.clear)

    schema = T.StructType([*given, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return rows.mapInArrow(predict, schema)
