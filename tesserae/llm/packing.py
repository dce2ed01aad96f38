"""Hierarchical packing of documents into sequences of several context sizes.

A document of at least the longest context is cut into full windows of it; what remains goes to the smallest tier that
holds it. Tiers are packed from the longest: each document opens a window of its tier, and the gap behind it is filled
from shorter tiers, by whole documents where they fit and else by a cut one. Windows are powers of two, so full windows
need no padding; what a task holds at its end is laid out in windows of falling powers of two.

Packing goes on inside each input partition, in chunks of bounded size, with no shuffle. The pieces are written, and then
step groups are balanced over all tasks: the windows of a tier follow each other task by task, and a new group begins
with every STEP_TOKENS real tokens. So groups of a tier differ by less than one window, but for its last one.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, small_batches, written
from .encoding import ENCODED_ROWS, KEPT_UNITS, encoder_of, let_go

TIERS = (512, 1024, 2048, 4096)
#: Tokens of one training step, and tokens that a task packs together.
STEP_TOKENS, CHUNK_TOKENS = 64 * 4096, 2_000_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, earlier long"
#: Sequence ids of a task begin at its number shifted by this.
TASK_BITS = 36

Piece = tuple[int, int, int]  # length, document, start


def pack_chunk(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (tier, pieces) made of pieces no longer than the top tier, and the pieces left for later.

    A window opens with the longest piece left; it is filled from the pool of shorter ones. When the pool can't fill it,
    its pieces are left over.
    """
    pool = sorted(pieces)
    windows: list[tuple[int, list[Piece]]] = []
    while pool:
        first = pool.pop()
        tier = next(t for t in tiers if t >= first[0])
        row, gap = [first], tier - first[0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0))
            if at:
                piece = pool.pop(at - 1)
            else:  # the shortest is too long: cut it
                length, doc, start = pool.pop(0)
                piece = (gap, doc, start)
                insort(pool, (length - gap, doc, start + gap))
            row.append(piece)
            gap -= piece[0]
        if gap:
            return windows, row
        windows.append((tier, row))
    return windows, []


def last_windows(pieces: list[Piece], top: int) -> list[tuple[int, list[Piece]]]:
    """Windows of falling powers of two, at most top, that hold just the pieces given."""
    left, windows = list(reversed(pieces)), []
    total = sum(p[0] for p in pieces)
    while total:
        size = min(top, 1 << (total.bit_length() - 1))
        row, gap = [], size
        while gap:
            length, doc, start = left.pop()
            if length > gap:
                left.append((length - gap, doc, start + gap))
                length = gap
            row.append((length, doc, start))
            gap -= length
        windows.append((size, row))
        total -= size
    return windows


class Packer:
    """Packs a stream of documents (ids as uint32) of one task."""

    def __init__(self, first_sequence: int, tiers: tuple[int, ...] = TIERS):
        self.sequence, self.tiers, self.tier_tokens = first_sequence, tiers, Counter()
        self.docs: list[tuple] = []  # (doc_id, ids)
        self.left: list[Piece] = []
        self.new: list[Piece] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        top, doc, n = self.tiers[-1], len(self.docs), len(ids)
        self.docs.append((doc_id, ids))
        self.new += [(min(top, n - a), doc, a) for a in range(0, n, top)]
        self.held += n

    def flush(self, last: bool = False) -> dict[str, list]:
        """The pieces of all windows that are full by now; at the last call, of all."""
        windows, left = pack_chunk(self.left + self.new, self.tiers)
        if last:
            windows += last_windows(left, self.tiers[-1])
            left = []
        out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
        for size, row in windows:
            tier = next((t for t in self.tiers if t >= size), self.tiers[-1])
            offset, earlier = 0, self.tier_tokens[tier]
            for length, doc, start in row:
                doc_id, ids = self.docs[doc]
                for name, value in zip(out, (doc_id, start, length, ids[start : start + length].astype("<u4").tobytes(), len(ids), self.sequence, offset, tier, earlier), strict=True):
                    out[name].append(value)
                offset += length
            self.sequence += 1
            self.tier_tokens[tier] += offset
        keep = {doc: k for k, doc in enumerate(dict.fromkeys(p[1] for p in left))}
        self.docs, self.left, self.new, self.held = [self.docs[d] for d in keep], [(n, keep[d], a) for n, d, a in left], [], 0
        return out


def step_groups(pieces: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Written pieces with step_group instead of `earlier`, the tier's tokens before the window in its task. Groups are
    numbered within a tier; the sums over tasks run over one row a task and tier."""
    task = F.shiftright("sequence_id", TASK_BITS)
    totals = pieces.groupBy(task.alias("_task"), F.col("tier").alias("_tier")).agg(F.sum("length").alias("_n"))
    before = Window.partitionBy("_tier").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_task", "_tier", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = if_small(written(offsets, "packed-offsets"))
    rows = pieces.join(offsets, (task == F.col("_task")) & (F.col("tier") == F.col("_tier")))
    group = F.floor((F.col("_offset") + F.col("earlier")) / step_tokens)
    return rows.withColumn("step_group", group).drop("_task", "_tier", "_offset", "earlier")


def pack(docs: DataFrame, path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, rows_at_once: int = ENCODED_ROWS, kept: int = KEPT_UNITS) -> DataFrame:
    """Pack docs (doc_id, text), encoded with the tokenizer file at path, each with end_id after it.

    One row a piece, with its ids as little-endian u32. Every id of every row of docs lies in one piece; a null or empty
    text is the end id alone. Sequence ids are unique, offsets gapless from 0, and every sequence is as long as a power of
    two. step_group numbers, in a tier, groups of STEP_TOKENS tokens to within one window, the last one of fewer. An empty
    table gives no rows; repeated rows are packed each for itself; other columns are ignored. rows_at_once and kept bound
    a worker's memory.
    """
    small_batches(docs.sparkSession, rows_at_once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, packer = encoder_of(path, kept), Packer(TaskContext.get().partitionId() << TASK_BITS, tiers)

        def rows(last: bool = False) -> Iterator[pa.RecordBatch]:
            out = packer.flush(last)
            types = {"ids": pa.binary(), "tier": pa.int32()}
            columns = {c: pa.array(v, types.get(c, pa.int64())) for c, v in out.items()}
            if n := len(out["doc_id"]):
                table = pa.record_batch(list(columns.values()), list(columns))
                yield from (table.slice(a, 2000) for a in range(0, n, 2000))

        for batch in batches:
            doc_ids, ids, lengths = batch.column(0).to_pylist(), *encoder.encode(batch.column(1))
            ends = np.cumsum(lengths)
            for d, a, b in zip(doc_ids, (ends - lengths).tolist(), ends.tolist(), strict=True):
                packer.add(d, np.append(ids[a:b], np.uint32(end_id)))
            if packer.held >= CHUNK_TOKENS:
                yield from rows()
        yield from rows(True)
        let_go()

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
    return step_groups(written(pieces, "packed"), STEP_TOKENS)
