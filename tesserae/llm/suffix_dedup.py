"""Removal of repeated byte strings by suffix arrays.

A byte is removed if a string of `window` bytes that covers it also starts anywhere else. Passages are found beside that:
strings that also start elsewhere and have `words` whole words (and `least` bytes at least), or `window` bytes. The steps:

1. Equal texts are one row with a count; if there is a copy, all of the text is repeated. These rows are written bucketed
   by the text's key, so that joining them later moves no text again.
2. Every position has an anchor, the smallest hashed run of GRAM bytes among the `least` bytes behind it (the first on
   ties). Equal strings have equal anchors at equal offsets, so consecutive positions with one anchor form a region, and
   only anchors that occur twice go on. This deals the work out and decides nothing.
3. Regions are dealt by anchor. A task takes many anchors' regions at a time, marks cuts, which depend only on the bytes
   behind them, and names the block of bytes behind each cut by its rank. Since a block tells where the next cut is, the
   suffixes of these names stand in the order of the bytes; they are sorted by linear grouping.
4. The bytes that neighbours in the suffix array have in common tell how far the string at each cut is repeated. The
   match at a position before a cut is read from the neighbours among the suffixes with the same bytes before their cuts.

An anchor with more than HOT regions is not gathered in one task. Equal regions of it are counted, one of each goes on
string by string, and strings are counted by digest, which is exact and leaves nothing out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, written
from .shingles import SPACE, mix, powers
from .suffix_grouping import suffix_array

#: Bytes of a repeated string; words, and least bytes, of a passage; bytes hashed for anchors and for cuts; how far a cut
#: may be away; regions of an anchor that one task takes.
WINDOW, WORDS, LEAST, GRAM, SEED, REACH, HOT = 400, 51, 240, 32, 8, 48, 5000
#: Keys over which the rows of equal regions of a frequent anchor are dealt.
SALTS = 32
#: Bytes of a text hashed at a time, and of regions whose suffixes are sorted together.
CHUNK, SORTED_BYTES = 1 << 20, 4 << 20
BYTE = np.random.default_rng(7).integers(1, 2**64, 256, dtype=np.uint64)
ANCHORS = "anchor long, first long, last long"
#: Bytes behind a cut that decide where the next one is.
BLOCK = REACH + SEED
NEVER = 1 << 40


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` bytes."""
    up, down = powers(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * up, dtype=np.uint64)])
    n = len(data) - width + 1
    return mix((sums[width:] - sums[:n]) * down[:n])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values, the place of its smallest one, the first on ties; by prefix and suffix minima."""
    n = len(values)
    keyed = (values >> np.uint64(28) << np.uint64(28)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, 2**64 - 1, np.uint64)
    padded[:n] = keyed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1 : width - 1 + m]) & np.uint64((1 << 28) - 1)).astype(np.int64)


def anchors_of(data: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(anchor hash, first and last position) of each region of a text; long texts go in chunks."""
    rows = []
    for a in range(0, len(data) - least + 1, CHUNK):
        part = data[a : a + CHUNK + least - 1]
        hashes = gram_hashes(part, GRAM)
        place = window_minima(hashes, least - GRAM + 1)
        cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(cut[1:], len(place)) - 1
        rows.append(np.stack([hashes[place[cut]].astype(np.int64), cut + a, last + a]))
    return np.concatenate(rows, 1) if rows else np.zeros((3, 0), np.int64)


class Regions:
    """Regions laid out one after another: the byte before each (a space at a text's start), then its bytes, which end
    `window` bytes behind its last position or where the text ends."""

    def __init__(self, regions: list[bytes], positions: list[int], window: int, words: int, least: int):
        self.window, self.least = window, least
        lengths = np.array([len(r) for r in regions], np.int64)
        self.data = np.frombuffer(b"".join(regions), np.uint8)
        self.end = np.cumsum(lengths)
        self.first = self.end - lengths + 1
        self.positions = np.array(positions, np.int64)
        self.last = self.first + self.positions - 1
        self.owner = np.repeat(np.arange(len(regions)), self.positions)
        self.at = np.arange(len(self.owner)) + np.repeat(self.first - (np.cumsum(self.positions) - self.positions), self.positions)
        self.whole = np.where(self.at + window <= self.end[self.owner], window, NEVER)
        self.passage = np.minimum(self.whole, self.word_lengths(words))

    def word_lengths(self, words: int) -> np.ndarray:
        """For each position the bytes of the words that begin there; NEVER if no word does or they are too few or short."""
        space = SPACE[self.data].copy()
        before = self.first - 1
        inner = self.first[~space[before]]  # a region that begins inside a word
        space[before] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        start, stop = edge[::2], edge[1::2]
        out = np.full(len(self.data), NEVER)
        if len(start) >= words:
            a, b = start[: len(start) - words + 1], stop[words - 1 :]
            region = np.searchsorted(self.end, a, "right")
            fits = (b <= self.end[region]) & (b - a >= self.least)
            out[a[fits]] = (b - a)[fits]
        out[inner] = NEVER
        return out[self.at]

    def spans(self, hit: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(region, start, stop) of the maximal ranges covered by the strings at the positions that are hit; starts and
        stops count from the region's first position."""
        k = np.flatnonzero(hit)
        own, a, b = self.owner[k], self.at[k], self.at[k] + length[k]
        reach = np.maximum.accumulate(b) if len(b) else b
        cut = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (a[1:] > reach[:-1]))) if len(k) else k
        stop = reach[np.append(cut[1:], len(k)) - 1] if len(k) else k
        return own[cut], a[cut] - self.first[own[cut]], stop - self.first[own[cut]]


def repeats_in(r: Regions, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, whether the string of `window` bytes, and the passage, also start elsewhere in its group.

    Regions of one group must differ; `groups` numbers the regions' anchors.
    """
    data, end = r.data, r.end
    n_regions = len(end)
    # the cut of each position with a whole block behind it
    place = window_minima(gram_hashes(data, SEED), REACH)
    here = np.arange(len(place))
    region = np.minimum(np.searchsorted(end, here, "right"), n_regions - 1)
    inside = (here >= r.first[region]) & (here + BLOCK <= end[region])
    cuts = place[inside]
    own = region[inside]
    new = np.append(True, (cuts[1:] != cuts[:-1]) | (own[1:] != own[:-1]))
    begin, own = cuts[new], own[new]
    # of the cuts without a whole block, the first ends its region's sequence
    short = begin + BLOCK > end[own]
    keep = ~short | np.append(True, ~short[:-1] | (own[1:] != own[:-1]))
    begin, own = begin[keep], own[keep]
    m = len(begin)
    size = np.minimum(end[own] - begin, BLOCK)
    named = np.zeros((m, 4 + BLOCK + 1), np.uint8)
    named[:, :4] = groups[own].astype(">u4").view(np.uint8).reshape(-1, 4)
    padded = np.concatenate([data, np.zeros(BLOCK, np.uint8)])
    blocks = np.lib.stride_tricks.sliding_window_view(padded, BLOCK)[begin]
    blocks[np.arange(BLOCK) >= size[:, None]] = 0
    named[:, 4:-1], named[:, -1] = blocks, size + 1
    names = np.unique(named.view(f"S{4 + BLOCK + 1}").ravel(), return_inverse=True)[1]
    entry = np.arange(m) + own  # one separator behind each region's cuts
    total = m + n_regions
    symbols, at, cut_of = np.empty(total, np.int64), np.empty(total, np.int64), np.full(total, -1)
    separator = np.bincount(own, minlength=n_regions).cumsum() + np.arange(n_regions)
    symbols[separator], at[separator] = np.arange(n_regions), end
    symbols[entry], at[entry], cut_of[entry] = names + n_regions, begin, np.arange(m)
    order = suffix_array(symbols)

    # bytes that neighbours have in common, as far as they matter
    left, right = order[:-1], order[1:]
    common, alive, step = np.zeros(len(left), np.int64), np.arange(len(left)), 0
    while len(alive):
        i, j = left[alive] + step, right[alive] + step
        known = (i < total) & (j < total)
        i, j, alive = i[known], j[known], alive[known]
        same = symbols[i] == symbols[j]
        apart = ~same & (cut_of[i] >= 0) & (cut_of[j] >= 0) & (common[alive] + 2 * BLOCK >= r.least)
        x, y = cut_of[i[apart]], cut_of[j[apart]]
        differ = blocks[x] != blocks[y]
        equal = np.where(differ.any(1), differ.argmax(1), BLOCK)
        common[alive[apart]] += np.where(groups[own[x]] == groups[own[y]], np.minimum(equal, np.minimum(size[x], size[y])), 0)
        alive = alive[same]
        common[alive] += at[i[same] + 1] - at[i[same]]
        alive, step = alive[common[alive] < r.window], step + 1

    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total)
    low = [common]  # minima of runs of 2, 4, ... neighbours
    while 2 ** len(low) <= len(common):
        low.append(np.minimum(low[-1][: -(2 ** (len(low) - 1))], low[-1][2 ** (len(low) - 1) :]))

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes at ranks a < b have in common."""
        level = np.frexp((b - a).astype(float))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            pick = level == k
            out[pick] = np.minimum(low[k][a[pick]], low[k][b[pick] - 2**k])
        return out

    def longest(ranks: np.ndarray, together: np.ndarray) -> np.ndarray:
        """For ascending ranks within groups of equal numbers, the most bytes shared with another of the group."""
        next_to = np.zeros(len(ranks), np.int64)
        pair = np.flatnonzero(together[1:] == together[:-1])
        next_to[pair] = shared(ranks[pair], ranks[pair + 1])
        return np.maximum(next_to, np.concatenate([[0], next_to[:-1]]))

    # each position's cut, and the distances before it at which a cut has positions
    cut = np.searchsorted(begin, place[r.at])
    before = begin[cut] - r.at
    nearest, farthest = np.full(m, BLOCK), np.full(m, -1)
    np.minimum.at(nearest, cut, before)
    np.maximum.at(farthest, cut, before)

    serving = np.flatnonzero(farthest >= 0)
    serving = serving[np.argsort(rank[entry[serving]])]
    most = np.zeros(m, np.int64)
    most[serving] = longest(rank[entry[serving]], groups[own[serving]])
    starting = serving[nearest[serving] == 0]
    exact = np.zeros(m, np.int64)
    exact[starting] = longest(rank[entry[starting]], groups[own[starting]])
    earlier = np.maximum(cut - 1, 0)
    carried = np.where((cut > 0) & (own[earlier] == r.owner), exact[earlier] - (r.at - begin[earlier]), 0)
    match = np.where(before == 0, exact[cut], carried)
    reach = most[cut] + before
    open_ = (before > 0) & (((match < r.whole) & (reach >= r.whole)) | ((match < r.passage) & (reach >= r.passage)))

    # positions before a cut that are not decided: classes of suffixes by the bytes before them
    need = np.zeros(m, np.int64)
    np.maximum.at(need, cut[open_], before[open_])
    tracked = serving
    bound = max(1, r.least - REACH)
    near = rank[entry[tracked]]
    split = np.append(True, shared(near[:-1], near[1:]) < bound) if len(near) > 1 else np.ones(len(near), bool)
    kind = np.cumsum(split)
    which = np.flatnonzero(open_)
    which = which[np.argsort(before[which], kind="stable")]
    upto = np.searchsorted(before[which], np.arange(REACH + 1))
    slot = np.full(m, -1)
    for d in range(1, REACH):
        stay = farthest[tracked] >= d
        tracked, kind = tracked[stay], kind[stay]
        if not len(tracked):
            break
        key = kind * 256 + data[begin[tracked] - d]
        by = np.argsort(key, kind="stable")
        tracked, key = tracked[by], key[by]
        kind = np.cumsum(np.append(True, key[1:] != key[:-1]))
        alive = (np.bincount(kind)[kind] > 1) & (np.bincount(kind, need[tracked] >= d)[kind] > 0)
        tracked, kind = tracked[alive], kind[alive]
        ask = which[upto[d] : upto[d + 1]]
        if not len(tracked) or not len(ask):
            continue
        valid = nearest[tracked] <= d
        v = tracked[valid]
        if not len(v):
            continue
        found = longest(rank[entry[v]], kind[valid])
        slot[v] = np.arange(len(v))
        has = slot[cut[ask]] >= 0
        match[ask[has]] = np.maximum(match[ask[has]], found[slot[cut[ask[has]]]] + d)
        slot[v] = -1
    return match >= r.whole, match >= r.passage


def distinct_texts(docs: DataFrame, parts: int, label: str) -> DataFrame:
    """The distinct texts of docs with their counts, written bucketed by key."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.unhex(F.md5("text")).alias("key"), "text")
    rows = rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"{label}_{uuid.uuid4().hex}"
    rows.write.bucketBy(parts, "key").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


SPANS = "key binary, start long, stop long, passage boolean"


def span_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["key", "start", "stop", "passage"])


def solve(rows: list[tuple[int, bytes, int, bytes, int]], window: int, words: int, least: int) -> list[tuple]:
    """Spans (key, start, stop, passage) of regions (anchor, key, first, region, positions), all those of each anchor."""
    # equal regions of an anchor repeat each other whole, and one of them stands for all
    members: dict[tuple, list[tuple]] = {}
    for anchor, key, first, region, positions in rows:
        members.setdefault((anchor, region, positions), []).append((key, first))
    by_anchor: dict[int, int] = {}
    for anchor, *_ in members:
        by_anchor[anchor] = by_anchor.get(anchor, 0) + 1
    number = {a: k for k, a in enumerate(by_anchor)}
    out: list[tuple] = []
    for several in (True, False):  # regions to compare, and those that are equal to all others of their anchor
        own = [m for m in members if (by_anchor[m[0]] > 1) == several and (several or len(members[m]) > 1)]
        if not own:
            continue
        r = Regions([m[1] for m in own], [m[2] for m in own], window, words, least)
        copied = np.array([len(members[m]) > 1 for m in own])[r.owner]
        whole, passage = repeats_in(r, np.array([number[m[0]] for m in own])) if several else (copied, copied)
        whole = (whole | copied) & (r.whole < NEVER)
        for hit, length, kind in ((whole, r.whole, False), ((passage | copied) & ~whole & (r.passage < NEVER), r.passage, True)):
            for k, a, b in zip(*(x.tolist() for x in r.spans(hit, length)), strict=True):
                out += [(key, first + a, first + b, kind) for key, first in members[own[k]]]
    return out


def repeated_spans(texts: DataFrame, window: int = WINDOW, words: int = WORDS, least: int = LEAST, hot: int = HOT, label: str = "suffix") -> DataFrame:
    """(key, start, stop, passage) of byte ranges covered by repeated strings of `window` bytes, or of passages that are
    shorter, for distinct texts (key, text)."""
    small_batches(texts.sparkSession, 300)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                a = anchors_of(np.frombuffer(text.encode(), np.uint8), least)
                if a.shape[1]:
                    yield pa.record_batch([pa.array([key] * a.shape[1], pa.binary()), *map(pa.array, a)], ["key", "anchor", "first", "last"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in find(batches):
            held.append(b)
            n += b.num_rows
            if n > 20_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    long = texts.where(F.octet_length("text") >= least)
    every = written(long.select("key", "text").mapInArrow(gathered, f"key binary, {ANCHORS}"), f"{label}-anchors")
    often = written(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), f"{label}-counts")
    per_text = every.join(often, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", "first", "last", "n")).alias("regions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        for batch in batches:
            keys, texts_, regions = (batch.column(k).to_pylist() for k in range(3))
            out: list[tuple] = []
            for key, text, found in zip(keys, texts_, regions, strict=True):
                data = b" " + text.encode()
                out += [(r["anchor"], key, r["first"], data[r["first"] : r["last"] + 1 + window], r["last"] - r["first"] + 1, r["n"]) for r in found]
            for a in range(0, len(out), 4000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[a : a + 4000], strict=True), types, strict=True)], ["anchor", "key", "first", "region", "positions", "n"])

    # the texts lie in buckets by key already; only the list of regions moves
    regions = long.join(per_text.hint("shuffle_hash"), "key").select("key", "text", "regions").mapInArrow(cut, "anchor long, key binary, first long, region binary, positions long, n long")
    if often.where(F.col("n") > hot).limit(1).count():
        regions = written(regions, f"{label}-regions")
        hot_spans = counted_strings(regions.where(F.col("n") > hot).drop("n"), window, words, least, label)
    else:
        hot_spans = None

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size >= SORTED_BYTES and row[0] != rows[-1][0]:
                    yield span_rows(solve(rows, window, words, least))
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield span_rows(solve(rows, window, words, least))

    dealt = regions.where(F.col("n") <= hot).drop("n").repartition("anchor").sortWithinPartitions("anchor")
    spans = dealt.mapInArrow(group, SPANS)
    return spans if hot_spans is None else spans.unionByName(hot_spans)


def counted_strings(regions: DataFrame, window: int, words: int, least: int, label: str) -> DataFrame:
    """The same for written regions of anchors that are too frequent to gather: strings are counted by digest."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.binary(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())
        for batch in batches:
            for anchor, key, first, region, positions in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                r, salt = Regions([region], [positions], window, words, least), anchor.to_bytes(8, "little", signed=True)
                out = []
                for length, kind in ((r.whole, False), (r.passage, True)):
                    for a, n in zip(r.at.tolist(), length.tolist(), strict=True):
                        if n < (NEVER if not kind else window):
                            out.append((hashlib.blake2b(region[a : a + n], digest_size=16, salt=salt).digest(), kind, key, first + a - 1, first + a - 1 + n))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["digest", "passage", "key", "start", "stop"])

    def twins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            yield span_rows([x for row in rows for x in dict.fromkeys(solve([row, row], window, words, least))])

    # equal regions repeat each other whole; one of each goes on, string by string. How often a region occurs comes back to
    # its rows under SALTS keys each, so that no task has all rows of a region
    place = F.struct("key", "first")
    marked = regions.withColumns({"content": F.md5(F.concat("region", F.col("positions").cast("string").cast("binary"))), "bytes": F.octet_length("region").cast("long") - 1})
    counts = marked.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(place).alias("one")).where("copies > 1")
    again = counts.select("anchor", "content", "one", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = marked.drop("region").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).unionByName(again, allowMissingColumns=True)
    rows = rows.withColumn("one", F.max("one").over(Window.partitionBy("anchor", "content", "salt"))).where("key is not null")
    rows = written(rows.select("key", "first", "bytes", "one", F.coalesce(place == F.col("one"), F.lit(True)).alias("stands")), f"{label}-hot")
    copied = rows.where("one is not null")
    whole = copied.where(F.col("bytes") >= window).select("key", F.col("first").alias("start"), (F.col("first") + F.col("bytes")).alias("stop"), F.lit(False).alias("passage"))
    bytes_of = lambda found: regions.join(found.select("key", "first"), ["key", "first"], "left_semi").select("anchor", "key", "first", "region", "positions")
    short = bytes_of(copied.where(F.col("bytes") < window)).mapInArrow(twins, SPANS)
    strings = written(bytes_of(rows.where("stands")).mapInArrow(spread, "digest binary, passage boolean, key binary, start long, stop long"), f"{label}-strings")
    twice = strings.groupBy("digest", "passage").agg(F.count("*").alias("times")).where("times > 1")
    return whole.unionByName(short).unionByName(strings.join(twice, ["digest", "passage"]).select("key", "start", "stop", "passage"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, words: int = WORDS, least: int = LEAST, hot: int = HOT, label: str = "suffix") -> DataFrame:
    """Per distinct text of docs (text): key (md5), n_bytes, n_removed, spans (start, stop), passages (start, stop), kept (bytes).

    Strings never cross documents. Texts shorter than the window lose nothing; a null text is empty. Kept bytes may split
    characters, so they are binary. An empty table gives no rows; other columns are ignored. least must be 56 at least.
    """
    if not BLOCK <= least <= window:
        raise ValueError(f"least must lie between {BLOCK} and window")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = distinct_texts(docs, parts, label)
    spans = repeated_spans(texts, window, words, least, hot, label)
    per_text = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop", "passage")).alias("spans"))

    def merged(found: list) -> list[tuple[int, int]]:
        out: list[list[int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, copies, found in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                data = text.encode()
                if copies > 1:
                    all_of = [(0, len(data))]
                    gone = all_of if len(data) >= window else []
                    again = all_of if gone or (len(data) >= least and len(data.split()) >= words) else []
                else:
                    gone, again = (merged([(s["start"], s["stop"]) for s in found or () if also or not s["passage"]]) for also in (False, True))
                edges = [0, *(x for m in gone for x in m), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                named = ([{"start": a, "stop": b} for a, b in x] for x in (gone, again))
                for column, value in zip(out, (len(data), len(data) - len(kept), *named, kept), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), span, span, pa.binary()), strict=True))], ["key", "n_bytes", "n_removed", "spans", "passages", "kept"])

    rows = texts.join(per_text.hint("shuffle_hash"), "key", "left").select("key", "text", "copies", "spans")
    return rows.mapInArrow(apply, "key binary, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, passages array<struct<start:long,stop:long>>, kept binary")
