"""MinHash near-duplicate detection by an inverted join on signature coordinates.

Documents with equal shingle sets form a class. A class's signature has COORDINATES minima, and each (coordinate, value)
pair is a posting. Two classes are candidates if at least MATCHES coordinates agree; a pair at the threshold similarity
misses that with odds of about one in a million. Postings that nobody shares are counted and dropped; a class with r
shared ones can only match if r >= MATCHES, and any match shares one of its r - MATCHES + 1 rarest (the prefix). Only
prefixes are joined; the agreeing coordinates of a candidate pair are then counted in blocks, skipping pairs that can no
longer reach MATCHES; and a surviving pair is confirmed on the full shingle sets.

A posting shared by many classes never yields all its pairs. First every class is compared with the weightiest class of
each of its postings, the one most like the others, and confirmed links give components. Then, in each posting, only
classes outside the component most common there are compared with classes of other components, in blocks: a pair inside
one component is no news. A pair is looked at only in the first prefix posting that it shares, and parities of hashed
shingles, which bound the symmetric difference from below, drop those that can't be similar. All links between different
components are found, so the components are those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, if_small, small_batches, written
from .shingles import BASE, mix, shingle_sets

COORDINATES, MATCHES = 48, 24
#: Parities kept of a set, and classes of a posting that are compared together.
PARITIES, MEMBERS = 2048, 1000
#: Coordinates compared at a time when agreements are counted.
BLOCK = 8
SKETCHES = "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary, parity binary"


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = (mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32)
    return seed[:n] | np.uint32(1), seed[n:]


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The minimum of each of the hash functions (a * x + b on the upper 32 bits) over a set, as u32."""
    a, b = _factors(coordinates)
    low = np.full(coordinates, 2**32 - 1, np.uint32)
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(upper), 256):
        low = np.minimum(low, (upper[k : k + 256, None] * a + b).min(0))
    return low


def parities(shingles: np.ndarray) -> bytes:
    """For each residue of hashes, whether an odd number of the set's shingles have it."""
    return np.packbits((np.bincount((shingles % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)).tobytes()


def sketch(docs: DataFrame, width: int, label: str = "minhash") -> DataFrame:
    """Per row of docs (doc_id, text): set size, a 128-bit key of the shingle set, its signature and its parities (null if empty)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, signatures, odd = [], [], [], []
            for s in shingle_sets(batch.column(2), width):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signatures.append(signature(s).astype("<u4").tobytes() if len(s) else None)
                odd.append(parities(s) if len(s) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(odd, pa.binary())], [c.split()[0] for c in SKETCHES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return written(rows.mapInArrow(run, SKETCHES), label)


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(node, coordinate, value, weight) for the rarest r - matches + 1 of each class's r shared postings; weight sums the
    sizes of all of them, and is largest for the class in the middle of a group."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for a in range(0, len(nodes), 2000):
                values = np.frombuffer(b"".join(batch.column(1)[a : a + 2000].to_pylist()), "<u4")
                own = nodes[a : a + 2000]
                c = len(values) // max(1, len(own))
                yield pa.record_batch([pa.array(np.repeat(own, c)), pa.array(np.tile(np.arange(c, dtype=np.int32), len(own))), pa.array(values.astype(np.int64))], ["node", "coordinate", "value"])

    postings = classes.select("node", "signature").mapInArrow(spread, "node long, coordinate int, value long")
    shared = postings.withColumn("df", F.count("*").over(Window.partitionBy("coordinate", "value"))).where("df > 1")
    own = Window.partitionBy("node")
    ranked = shared.withColumn("r", F.count("*").over(own)).withColumn("weight", F.sum("df").over(own)).withColumn("rank", F.row_number().over(own.orderBy("df", "coordinate")))
    return ranked.where(F.col("rank") <= F.col("r") - (matches - 1)).select("node", "coordinate", "value", "weight")


def agreeing(pairs: DataFrame, classes: DataFrame, matches: int, similarity: tuple[int, int]) -> DataFrame:
    """pairs (a, b) of nodes whose signatures agree in at least `matches` coordinates and whose set sizes allow a link;
    adds `agree`."""
    over, under = similarity
    own = classes.select("node", "signature", "n_shingles")
    rows = pairs.join(own.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na")), "a")
    rows = rows.join(own.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb")), "b")
    rows = rows.where(F.least("na", "nb") * over >= F.greatest("na", "nb") * under)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u4").reshape(batch.num_rows, -1) for k in (2, 3))
            width, alive, agree = x.shape[1], np.arange(len(x)), np.zeros(len(x), np.int64)
            for k in range(0, width, BLOCK):
                agree[alive] += (x[alive, k : k + BLOCK] == y[alive, k : k + BLOCK]).sum(1)
                alive = alive[agree[alive] + max(0, width - k - BLOCK) >= matches]
            yield pa.record_batch([batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive)), pa.array(agree[alive])], ["a", "b", "agree"])

    return rows.select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long, agree long")


def texts_of(needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the documents in a written table (node, doc_id, text_hash)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    join = texts["doc_id"].eqNullSafe(needed["doc_id"]) & (texts["text_hash"] == needed["text_hash"])
    return texts.join(if_small(needed), join).select(needed["node"], "text")


def across_components(placed: DataFrame, classes: DataFrame, similarity: tuple[int, int], matches: int, label: str) -> DataFrame:
    """Candidate pairs, written, (a, b) of classes in different components, from prefix postings placed (node, coordinate, value, part).

    In each posting the classes outside its most common component are queries against all of them, block by block.
    """
    key = ["coordinate", "value"]
    counts = placed.groupBy(*key, "part").agg(F.count("*").alias("n"))
    most = counts.groupBy(*key).agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.max("n").alias("n"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    here = written(placed.join(most.select(*key, "most", "n", "all"), key), f"{label}-postings")
    masks = placed.groupBy("node").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("coordinate"))).alias("mask"))
    own = masks.join(classes.select("node", "signature", "parity", "n_shingles"), "node")
    # queries go to every block of members, members to every block of queries
    blocks, queries = F.ceil(F.col("all") / MEMBERS).cast("int"), F.ceil((F.col("all") - F.col("n")) / MEMBERS).cast("int")
    odd = F.col("part") != F.col("most")
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    as_query = here.where(odd).select(*key, "node", "part", F.lit(True).alias("query"), mine(queries).alias("q"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("m"))
    as_member = here.select(*key, "node", "part", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), queries - 1)).alias("q"), mine(blocks).alias("m"))
    rows = as_query.unionByName(as_member).join(own, "node")
    rows = rows.withColumn("group", F.xxhash64(*key, "q", "m")).select("group", "coordinate", "node", "part", "query", "mask", "n_shingles", "signature", "parity")
    over, under = similarity

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            node, part, query, mask, size, c = (group.column(x).to_numpy() for x in ("node", "part", "query", "mask", "n_shingles", "coordinate"))
            short = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u4").reshape(len(node), -1)
            parity = np.frombuffer(b"".join(group.column("parity").to_pylist()), "<u8").reshape(len(node), -1)
            bits = np.int64(1) << np.arange(short.shape[1], dtype=np.int64)
            member = np.flatnonzero(~query)
            a, b = [], []
            for x in np.flatnonzero(query):
                y = member[(part[member] != part[x]) & (c[member] == c[x]) & (np.minimum(size[member], size[x]) * over >= np.maximum(size[member], size[x]) * under)]
                y = y[short[y, c[x]] == short[x, c[x]]]
                equal = short[y] == short[x]
                # only in the first posting that both have in their prefixes
                shared = equal & ((mask[y, None] & mask[x] & bits) != 0)
                y = y[(equal.sum(1) >= matches) & (shared.argmax(1) == c[x])]
                differ = np.bitwise_count(parity[y] ^ parity[x]).sum(1, dtype=np.int64)
                y = y[differ * (over + under) <= (over - under) * (size[y] + size[x])]
                a.append(np.minimum(node[x], node[y]))
                b.append(np.maximum(node[x], node[y]))
            return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            group = table.column("group").to_numpy()
            edges = np.flatnonzero(np.diff(group)) + 1
            if not len(edges):
                continue
            starts = [0, *edges.tolist()]
            pairs = [solve(table.slice(i, j - i)) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.record_batch([pa.array(np.concatenate([p[k] for p in pairs])) for k in range(2)], ["a", "b"])
            held = table.slice(starts[-1]).to_batches()
        if held:
            a, b = solve(pa.Table.from_batches(held))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    found = written(rows.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long").distinct(), f"{label}-pairs")
    dropped(here)
    return found


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: tuple[int, int], label: str) -> DataFrame:
    """Of written pairs (a, b), those whose full shingle sets have over * common >= under * union, written. Sets are sets
    of 64-bit hashes of shingles. Drops the pairs."""
    over, under = similarity
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # any document of a class has the class's set
    needed = written(nodes.join(classes.select("node", "doc_id", "text_hash"), "node"), f"{label}-needed")
    found = texts_of(needed, docs)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([s.astype("<u8").tobytes() for s in shingle_sets(batch.column(1), width)], pa.binary())], ["node", "shingles"])

    held = written(found.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"]), f"{label}-sets", "none")
    rows = pairs.select("a", "b").join(held.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    rows = rows.join(held.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(over * common >= under * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    good = written(rows.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long"), f"{label}-links")
    dropped(pairs, needed, held)
    return good


def near_duplicates(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (100, 80), matches: int = MATCHES, label: str = "near") -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, text_hash, n_shingles, component_id (the smallest doc_id reachable over links).

    A link is similarity[0] * common >= similarity[1] * union. Texts without words have an empty set and no link; their
    component is their own id. Rows with equal sets are linked. A null doc_id takes part, and its component is the smallest
    id linked with it, or null. An empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sketched = sketch(docs, width, f"{label}-sketches")
    classes = sketched.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("smallest"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("signature").alias("signature"), F.first("parity").alias("parity"), F.first("n_shingles").alias("n_shingles"))
    # numbered when written, so that the numbers stay
    classes = written(classes.select("set_key", "smallest", "one.doc_id", "one.text_hash", "signature", "parity", "n_shingles", F.monotonically_increasing_id().alias("node")), f"{label}-classes")
    postings = written(prefix_postings(classes, matches), f"{label}-postings")

    here = Window.partitionBy("coordinate", "value")
    stars = postings.withColumn("first", F.max(F.struct("weight", "node")).over(here)["node"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = agreeing(stars, classes, matches, similarity)
    # each class keeps the one that agrees with it most
    stars = stars.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b")
    links = confirmed(written(stars, f"{label}-stars"), classes, docs, width, similarity, f"{label}-1")
    parts = components(links, label=f"{label}-parts")

    placed = postings.join(parts, "node", "left").select("node", "coordinate", "value", F.coalesce("component", "node").alias("part"))
    across = across_components(placed, classes, similarity, matches, f"{label}-2")
    dropped(postings)
    more = confirmed(across, classes, docs, width, similarity, f"{label}-3")
    every = components(links.unionByName(more), label=f"{label}-components")
    dropped(links, more)

    own = classes.select("set_key", "smallest", "node").join(every, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = own.groupBy("component").agg(F.min("smallest").alias("component_id"))
    own = own.join(smallest, "component").select("set_key", "component_id", "component")
    rows = sketched.drop("signature", "parity").join(own, "set_key", "left")
    return rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")
