"""Token ids in directly addressable codes: chunk levels, continuation bitmaps and rank directories.

An id is split into 8-bit chunks, lowest first. Level 0 has the lowest chunk of every token and a bit that says whether
more follow; level k has the k-th chunk of just those tokens whose bit on level k-1 is set. The place of a token on the
next level is the number of set bits before it, which a directory of counts every 512 bits gives in constant time. So any
token is read by at most one look at each level, with no block to decode.

Segment layout, little-endian: magic DAC1; u32 documents, u64 tokens, u32 levels; per document i64 doc_id, u8 null flag,
u64 first token; per level u64 entries, the chunks, the bitmap and its u32 directory.

Segments are rows of a Parquet table in the shared folder, since executors of a cluster reach storage through Spark alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, written
from .encoding import ENCODED_ROWS, encoder_of, let_go

MAGIC, BLOCK = b"DAC1", 512
#: A segment is closed once it has this many tokens; a document always lies in one segment.
SEGMENT_TOKENS = 500_000
SEGMENTS = "part long, seq int, n_docs long, n_tokens long, payload binary"
TOKENS = "part long, seq int, doc_id long, local_start long, n_tokens long, ids binary"


def pack_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one segment; ids has the documents' tokens one after another."""
    starts = np.cumsum(lengths) - lengths
    out = [MAGIC, b"", np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(), starts.astype("<u8").tobytes()]
    rest, levels = np.ascontiguousarray(ids, np.uint32), 0
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        levels += 1
        if not more.any():
            break
        rest = rest[more] >> 8
    out[1] = struct.pack("<IQI", len(doc_ids), len(ids), levels)
    return b"".join(out)


class Segment:
    """A segment read in place: views of its bytes, nothing decoded until asked for."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        docs, self.n_tokens, levels = struct.unpack_from("<IQI", payload, 4)
        at = 20
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at)
        self.null = np.frombuffer(payload, "u1", docs, at + 8 * docs)
        self.starts = np.frombuffer(payload, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            width = -(-n // BLOCK) * (BLOCK // 8)
            chunks = np.frombuffer(payload, "u1", n, at + 8)
            bits = np.frombuffer(payload, "u1", width, at + 8 + n)
            ranks = np.frombuffer(payload, "<u4", width * 8 // BLOCK, at + 8 + n + width)
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + width + 4 * len(ranks)

    def token(self, i: int) -> int:
        """Token i of the segment, by one look at each level that it reaches."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            block = i // BLOCK
            ones = int(np.bitwise_count(bits[block * BLOCK // 8 : byte]).sum()) + int(bits[byte] & ((1 << bit) - 1)).bit_count()
            i, shift = int(ranks[block]) + ones, shift + 8
        return value

    def tokens(self) -> np.ndarray:
        """All tokens: each level's chunks are put under the set bits of the level before."""
        out = np.zeros(self.n_tokens, np.uint32)
        where = np.arange(self.n_tokens)
        for k, (chunks, bits, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            where = where[np.unpackbits(bits, bitorder="little", count=len(chunks)).astype(bool)]
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token, ids) of each document in order."""
        ids, ends = self.tokens(), np.append(self.starts[1:], self.n_tokens)
        for d, null, a, b in zip(self.doc_ids.tolist(), self.null.tolist(), self.starts.tolist(), ends.tolist(), strict=True):
            yield None if null else d, a, ids[a:b]


def write_tokens(docs: DataFrame, path: str, end_id: int | None = 1, label: str = "tokens") -> DataFrame:
    """Encode docs (doc_id, text) with the tokenizer file at path and write segments in ascending doc_id order.

    Documents are range-partitioned by id, so that segment (part, seq) order is id order; rows with equal ids follow the
    digest of their texts, and a null id comes first. A null or empty text has only the end id. Returns the written
    segments (part, seq, n_docs, n_tokens, payload); an empty table gives none.
    """
    small_batches(docs.sparkSession, ENCODED_ROWS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seq = TaskContext.get().partitionId(), encoder_of(path), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def segment() -> pa.RecordBatch:
            doc_ids = [d for x, _, _ in held for d in x]
            lengths, ids = np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            payload = pack_segment(doc_ids, lengths, ids)
            return pa.record_batch([pa.array([part]), pa.array([seq], pa.int32()), pa.array([len(doc_ids)]), pa.array([len(ids)]), pa.array([payload], pa.binary())], ["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            doc_ids, ids, lengths = batch.column(0).to_pylist(), *encoder.encode(batch.column(1))
            if end_id is not None:
                ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
            if doc_ids:
                held.append((doc_ids, lengths, ids))
            if sum(len(x) for _, _, x in held) >= SEGMENT_TOKENS:
                yield segment()
                held, seq = [], seq + 1
        if held:
            yield segment()
        let_go()

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(ranged.mapInArrow(encode, SEGMENTS), label)


def read_tokens(segments: DataFrame) -> DataFrame:
    """Documents of written segments: part, seq, doc_id, local_start (in the segment), n_tokens, ids (u32, little-endian)."""
    small_batches(segments.sparkSession, 8)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = list(Segment(payload).documents())
                columns = [pa.array([part] * len(found), pa.int64()), pa.array([seq] * len(found), pa.int32()), pa.array([d for d, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.int64()), pa.array([len(x) for *_, x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for *_, x in found], pa.binary())]
                yield pa.record_batch(columns, ["part", "seq", "doc_id", "local_start", "n_tokens", "ids"])

    return segments.select("part", "seq", "payload").mapInArrow(decode, TOKENS)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(part, seq, first): the ids in all segments before each. Sums run within parts, then over one row a part."""
    sizes = segments.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_part_first"))
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("_in"))
    return within.join(parts, "part").select("part", "seq", (F.col("_in") + F.col("_part_first")).alias("first"))
