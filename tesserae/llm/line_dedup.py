"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words; a line is removed if an earlier line of the corpus (by doc_id, then line
number) has the same set or one of Jaccard similarity SIMILARITY or more. Blank lines stay.

Texts are split and hashed once: the lines, as hashes of their words, are written, and counted, joined and verified from
there, numbered in their order; by doc_id where those are whole numbers and unique, else texts are sorted first. Lines with equal sets form a class, stood for by its first line and its number. Tokens are
ordered by rarity, estimated by a table of word counts of fixed size. Two sets that are similar enough share one of the
first n - ceil(t n) + 1 tokens of each (the prefix); so only prefixes are joined, with themselves, so that one shuffle
serves both sides. A shared token at positions i and j bounds the overlap by min(m - i, n - j) (positional filter), sizes
must be within t of each other (length filter), and the parities of hashed tokens bound the symmetric difference from
below. What is left is verified on all words, by their 64-bit hashes. Tables are deleted as soon as their last reader is
written.

All pairs of near copies of one line would grow with the square of their number. So each class is first compared with the
first class that has the same two smallest, next two smallest or two largest hashes of words; the join only makes pairs
whose later class is not settled by that.

A token in more than HOT prefixes never yields all its pairs: each class is first compared with the earliest class of each
of its hot tokens, and only those that stay unresolved are then joined with all earlier ones.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, if_small, let_go, quantile_bounds, range_bucket, written

#: 5 * common >= 4 * union, a Jaccard similarity of 0.8; entries of the table of word counts.
OVER, UNDER = 5, 4
COUNTERS = 1 << 17
#: Prefixes that may hold a token for all its pairs to be compared at once; words above which a set has 128 parities, not 64.
HOT = 1_000
LONG = 64


def spaced(text: Column, spaces: str = "\t\n\v\f\r") -> Column:
    """Lower-cased text with white space made one character, since splitting at one needs no pattern; a null text is empty."""
    text = F.coalesce(text, F.lit(""))
    plain = one = F.lower(text)
    for space in spaces:
        one = F.replace(one, F.lit(space), F.lit(" "))
    # to look for a character takes less than to replace it
    return F.when(functools.reduce(operator.or_, [F.contains(text, F.lit(space)) for space in spaces]), one).otherwise(plain)


def word_hashes(line: Column) -> Column:
    """The set of the hashes of the words of a spaced line."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def shift(x: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", x, F.lit(by) if isinstance(by, int) else by.cast("int"))


def first_id(docs: DataFrame) -> int | None:
    """The least doc_id, if all are whole numbers, no two are equal and none is 2**32 or more above it."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return None
    found = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.min("doc_id"), F.max("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    return found[1] if found[0] == 1 and not found[3] and found[2] - found[1] < 1 << 32 else None


def hashed_lines(docs: DataFrame) -> DataFrame:
    """One row a line: node (ascends with the place, kept by writing it), doc_id, rid (hash of the text), line_no, hashes (of
    its words, ascending)."""
    # by line, since lower-casing takes long where not all is ASCII
    hashes = F.sort_array(word_hashes(spaced(F.col("line"), "\t\v\f\r"))).alias("hashes")
    lines = F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")
    least = first_id(docs)
    if least is not None:
        # the place is a number of its own, so texts stay where they are read
        rows = docs.select("doc_id", F.xxhash64("text").alias("rid"), lines)
        rows = rows.select("doc_id", "rid", F.posexplode("lines").alias("line_no", "line"))
        node = shift(F.col("doc_id").cast("long") - F.lit(least).cast("long"), 31).bitwiseOR(F.col("line_no").cast("long"))
        return rows.select(node.alias("node"), "doc_id", "rid", "line_no", hashes)
    # ranges of doc_id are dealt to tasks and sorted there, since Spark's own sort reads all texts once more for its bounds
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = quantile_bounds(docs, "doc_id", 4 * parts) if isinstance(docs.schema["doc_id"].dataType, T.NumericType) else []
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("rid"), range_bucket(F.col("doc_id"), bounds).cast("long").alias("bucket"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "rid")
    rows = rows.select("bucket", "doc_id", "rid", lines)
    rows = rows.select("bucket", "doc_id", "rid", F.posexplode("lines").alias("line_no", "line"))
    node = shift(F.col("bucket"), 40).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return rows.select(node.alias("node"), "doc_id", "rid", "line_no", hashes)


def level(n: int) -> int:
    """The logarithm of a count, between 1 and 127."""
    return min(127, 1 + int(4 * math.log2(1 + n)))


def rarity_table(docs: DataFrame) -> bytes:
    """A byte for each counter: the level of how many words fall on it, once a line, of docs or of their hashed lines."""
    lines = docs if "hashes" in docs.columns else hashed_lines(docs)
    word = lines.select(F.explode("hashes").alias("word"))
    counter = F.col("word").bitwiseAND(F.lit(COUNTERS - 1)).alias("counter")
    table = bytearray(b"\1" * COUNTERS)
    # the fast map of an aggregate has room for half of the counters unless it is told
    spark, room = docs.sparkSession, "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = spark.conf.get(room)
    spark.conf.set(room, str(COUNTERS.bit_length()))
    try:
        for counter, n in word.groupBy(counter).agg(F.count("*").alias("n")).collect():
            table[counter] = level(n)
    finally:
        spark.conf.set(room, before)
    return bytes(table)


def levels_of(table: bytes) -> Column:
    """The table as an array, which is folded into one literal and read at an index, without a string for each word."""
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<tinyint>")


def token(h: Column, levels: Column) -> Column:
    """A positive long that sorts rarest first, of the hash of a word: 7 bits of count, 56 of hash."""
    return shift(levels[h.bitwiseAND(F.lit(COUNTERS - 1))].cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))


def tokens_of(hashes: Column, levels: Column) -> Column:
    """The tokens, rarest first. None is null, and said to be so they are sorted as longs, not as objects."""
    return F.sort_array(F.transform(hashes, lambda h: F.coalesce(token(h, levels), F.lit(0).cast("long"))))


def parities(tokens: Column, n: Column) -> tuple[Column, Column]:
    """Parities of how many tokens hash to each of 64 bits: of all tokens and 0, or for over LONG tokens of each half. The two
    together always make the parities of all."""
    none = F.lit(0).cast("long")
    # bits are looked up, which takes less than to shift them for each token
    bit = [F.lit(1 << k if k < 63 else -1 << 63).cast("long") for k in range(64)]
    whole = F.aggregate(tokens, none, lambda a, x: a.bitwiseXOR(F.array(*bit)[x.bitwiseAND(F.lit(63))]))
    half = F.aggregate(tokens, none, lambda a, x: a.bitwiseXOR(F.array(*[none] * 64, *bit)[x.bitwiseAND(F.lit(127))]))
    return whole, F.when(n > LONG, half).otherwise(none)


def needed(n: Column) -> Column:
    """ceil(t * n): the least overlap of a set of n with any similar one."""
    return F.floor((F.lit(UNDER) * n + (OVER - 1)) / OVER).cast("int")


def lines_of(lines: DataFrame, table: bytes) -> DataFrame:
    """One row a hashed line with words: node, doc_id, rid, line_no, n, k1, k2 (hashes of the set), p0, p1, low, next, high (of
    the two smallest, next two and two largest hashes of words), prefix, rare (how many of it can't be in over HOT prefixes,
    since their counters are not above it)."""
    levels = levels_of(table)
    n = F.size("hashes")
    two = lambda i, j: F.hash(F.get("hashes", i), F.get("hashes", j))
    ends = [two(F.lit(0), F.lit(1)).alias("low"), F.when(n > 3, two(F.lit(2), F.lit(3))).alias("next"), two(n - 1, n - 2).alias("high")]
    keys = [F.xxhash64("hashes").alias("k1"), F.xxhash64(F.lit(7), "hashes").alias("k2")]
    rows = lines.where(n > 0).select("node", "doc_id", "rid", "line_no", *keys, *ends, tokens_of(F.col("hashes"), levels).alias("tokens"))
    n = F.size("tokens")
    whole, half = parities(F.col("tokens"), n)
    cut = F.slice("tokens", F.lit(1), n - needed(n) + 1)
    place, ends = ["node", "doc_id", "rid", "line_no"], ["low", "next", "high"]
    rows = rows.select(*place, "k1", "k2", *ends, n.alias("n"), whole.alias("whole"), half.alias("p1"), cut.alias("cut"))
    rare = F.size(F.filter("cut", lambda x: x < level(HOT + 1) << 56)).alias("rare")
    return rows.select(*place, "n", "k1", "k2", F.col("whole").bitwiseXOR(F.col("p1")).alias("p0"), "p1", *ends, F.transform("cut", lambda x: F.hash(x)).alias("prefix"), rare)


def passes(x: str, y: str) -> Column:
    """The length, positional and parity filters on postings x and y of one token. A place `at` may be marked as -1 - at."""
    c = lambda side, name: F.col(f"{side}.{name}")
    m, n = c(x, "n"), c(y, "n")
    overlap = F.ceil(F.lit(UNDER) * (m + n) / F.lit(OVER + UNDER))
    at = lambda side: F.greatest(c(side, "at"), -1 - c(side, "at"))
    bound = F.least(m - at(x), n - at(y))
    low, high = c(x, "p0").bitwiseXOR(c(y, "p0")), c(x, "p1").bitwiseXOR(c(y, "p1"))
    differ = F.when(F.least(m, n) > LONG, F.bit_count(low) + F.bit_count(high)).otherwise(F.bit_count(low.bitwiseXOR(high)))
    return (F.least(m, n) * OVER >= F.greatest(m, n) * UNDER) & (bound >= overlap) & (differ <= m + n - 2 * overlap)


def pairs_of(late: DataFrame, early: DataFrame) -> DataFrame:
    """Pairs (early, late) of classes with postings of one token that pass the filters, the late one's place not marked."""
    both = late.alias("x").join(early.alias("y"), F.col("x.token") == F.col("y.token"))
    # the mark is read with the other side's node, else it would be a filter below one of two equal shuffles
    both = both.where((F.col("y.node") < F.col("x.node")) & (F.when(F.col("x.at") >= 0, F.col("y.node")) < F.col("x.node")) & passes("x", "y"))
    return both.select(F.col("y.node").alias("early"), F.col("x.node").alias("late")).distinct()


def pairs_by_size(postings: DataFrame) -> DataFrame:
    """Pairs (early, late) of classes with postings of one token that pass the filters, the late one's place not marked.

    The smaller set of a pair, of n words, has at least 8/9 n in common with the other, so it is only looked for by its first
    n - ceil(8/9 n) + 1 tokens. What is not of use is left out after the shuffle, so that one shuffle serves both sides; a
    filter that does not depend on the row alone stays there.
    """
    dealt = postings.where("token is not null and n is not null").repartition("token")
    at = F.greatest("at", -1 - F.col("at"))
    least = F.floor((2 * UNDER * F.col("n") + (OVER + UNDER - 1)) / (OVER + UNDER))
    small = dealt.where(F.when(at <= F.col("n") - least, F.monotonically_increasing_id() >= 0).otherwise(F.lit(False))).alias("y")
    x, y, m, n = F.col("x.node"), F.col("y.node"), F.col("x.n"), F.col("y.n")
    both = dealt.alias("x").join(small, F.col("x.token") == F.col("y.token"))
    both = both.where((n <= m) & (n * OVER >= m * UNDER) & ((n < m) | (y < x)) & (F.when(x < y, F.col("y.at")).otherwise(F.col("x.at")) >= 0) & passes("x", "y"))
    return both.select(F.least(x, y).alias("early"), F.greatest(x, y).alias("late")).distinct()


def near_pairs(firsts: DataFrame, label: str) -> DataFrame:
    """Pairs (early, late) of classes that pass the filters, written, the early one the first with the late one's `low`, `next`
    or `high`."""
    rows = firsts.select(F.explode(F.array("low", "next", "high")).alias("key"), "node", "n", F.lit(0).alias("at"), "p0", "p1").where("key is not null")
    # most keys have one class
    keys = rows.groupBy("key").agg(F.min("node").alias("node"), F.count("*").alias("classes")).where("classes > 1").select("key", "node")
    keys = written(keys, f"{label}-keys")
    early = written(firsts.select("node", "n", F.lit(0).alias("at"), "p0", "p1").join(if_small(keys), "node"), f"{label}-early")
    both = rows.alias("x").join(if_small(early).alias("y"), F.col("x.key") == F.col("y.key")).where((F.col("y.node") < F.col("x.node")) & passes("x", "y"))
    pairs = written(both.select(F.col("y.node").alias("early"), F.col("x.node").alias("late")).distinct(), label)
    dropped(keys, early)
    return pairs


def sets_of(pairs: DataFrame, lines: DataFrame, label: str) -> DataFrame:
    """The word sets, as sets of 64-bit hashes, of the classes in written pairs (early, late), written."""
    nodes = written(pairs.select(F.col("early").alias("node")).union(pairs.select("late")).distinct(), f"{label}-nodes")
    sets = written(lines.select("node", F.col("hashes").alias("words")).join(if_small(nodes), "node"), f"{label}-sets")
    dropped(nodes)
    return sets


def similar_of(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """The late ones of written pairs (early, late) whose word sets are similar, written."""
    both = pairs.join(sets.select(F.col("node").alias("early"), F.col("words").alias("a")), "early").join(sets.select(F.col("node").alias("late"), F.col("words").alias("b")), "late")
    union = F.size(F.array_distinct(F.concat("a", "b")))
    return written(both.where(OVER * (F.size("a") + F.size("b") - union) >= UNDER * union).select("late").distinct(), f"{label}-similar")


def verified(pairs: DataFrame, lines: DataFrame, label: str) -> DataFrame:
    """Of written pairs (early, late) of classes, those late ones whose word sets are similar, written. Drops the pairs."""
    sets = sets_of(pairs, lines, label)
    found = similar_of(pairs, sets, label)
    dropped(pairs, sets)
    return found


def hot_repeats(postings: DataFrame, similar: DataFrame, lines: DataFrame, label: str) -> DataFrame:
    """The nodes of `similar` and those that are similar to an earlier class with which they share a hot token."""
    here = Window.partitionBy("token")
    whole = F.struct("node", "n", "at", "p0", "p1")
    shared = postings.withColumn("x", whole).withColumn("y", F.min("x").over(here))
    shared = written(shared.select("token", "x", F.col("y.node").alias("first"), ((F.col("y.node") < F.col("x.node")) & passes("x", "y")).alias("star")), f"{label}-postings")
    stars = written(shared.where("star").select(F.col("first").alias("early"), F.col("x.node").alias("late")).distinct(), f"{label}-hot-stars")
    resolved = written(similar.union(verified(stars, lines, f"{label}-3")).distinct(), f"{label}-resolved")
    flat = shared.select("token", "x.*", "first")
    late = flat.where("node > first").join(if_small(resolved), "node", "left_anti")
    pairs = written(pairs_of(late, flat), f"{label}-hot-pairs")
    dropped(shared)
    return resolved.union(verified(pairs, lines, f"{label}-4"))


def find_repeats(docs: DataFrame, label: str = "lines") -> DataFrame:
    """Decisions on docs (doc_id, text): doc_id, rid (hash of the text), n_lines, removed (line numbers from 0), and
    lines (line_no, digest, removed), once for each distinct (doc_id, text).

    A null text has one blank line. A null doc_id comes first. Lines at equal places of repeated rows are one line. An
    empty table gives no rows; other columns are ignored.
    """
    # to look for hashes in a dictionary takes longer than to write them
    hashed = written(hashed_lines(docs), f"{label}-hashed", "zstd", {"parquet.enable.dictionary#hashes.list.element": "false"})
    let_go(docs.sparkSession)
    lines = lines_of(hashed, rarity_table(hashed))
    same = [F.first(c).alias(c) for c in ("n", "p0", "p1", "low", "next", "high", "prefix", "rare")]
    firsts = lines.groupBy("k1", "k2").agg(F.min(F.struct("node", "doc_id", "rid", "line_no")).alias("f"), *same)
    firsts = written(firsts.select("f.*", "n", "p0", "p1", "low", "next", "high", "prefix", "rare"), f"{label}-classes")

    tokens = firsts.select("rare", F.posexplode("prefix").alias("at", "token")).where("at >= rare").groupBy("token").count()
    hot = written(tokens.where(F.col("count") > HOT).select("token"), f"{label}-hot")
    let_go(docs.sparkSession)
    postings = firsts.select("node", "n", "p0", "p1", F.posexplode("prefix").alias("at", "token"))
    any_hot = bool(hot.head(1))
    cold = postings.join(if_small(hot), "token", "left_anti") if any_hot else postings
    # near copies of one line share rare tokens, all pairs of them would grow with the square of their number: most are
    # settled by the first class with the same smallest or largest hashes, and only the others are joined
    settled = verified(near_pairs(firsts, f"{label}-near"), hashed, f"{label}-1").select(F.col("late").alias("node"))
    marks = if_small(settled.withColumn("settled", F.lit(True)))
    cold = cold.join(marks, "node", "left").withColumn("at", F.when(F.col("settled"), -1 - F.col("at")).otherwise(F.col("at"))).drop("settled")
    pairs = written(pairs_by_size(cold), f"{label}-pairs")
    # of the others too most are settled by their earliest candidate
    star = written(pairs.groupBy("late").agg(F.min("early").alias("early")), f"{label}-stars")
    sets = sets_of(pairs, hashed, f"{label}-2")
    again = similar_of(star, sets, f"{label}-2")
    rest = written(pairs.join(if_small(again), "late", "left_anti").select("early", "late"), f"{label}-rest")
    similar = settled.union(again.select("late")).union(similar_of(rest, sets, f"{label}-5").select("late"))
    dropped(pairs, star, rest, sets)
    if any_hot:
        similar = hot_repeats(postings.join(if_small(hot), "token", "left_semi"), similar, hashed, label)
    dropped(hot, hashed)

    # a line with words stays if it is its class's first and no earlier class is similar
    kept = firsts.join(if_small(similar), "node", "left_anti").select("doc_id", "rid", F.col("line_no").alias("kept"))
    words = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line_no"), F.unhex(F.md5(x)).alias("digest"), (F.ltrim(x, F.lit(" \t\n\v\f\r")) == "").alias("blank")))
    own = docs.select("doc_id", F.xxhash64("text").alias("rid"), words.alias("all"))
    each = own.withColumn("kept", F.lit(None).cast("int")).unionByName(kept, allowMissingColumns=True)
    each = each.groupBy("doc_id", "rid").agg(F.first("all", ignorenulls=True).alias("all"), F.collect_set("kept").alias("kept"))
    lines = F.transform("all", lambda x: F.struct(x["line_no"].alias("line_no"), x["digest"].alias("digest"), (~x["blank"] & ~F.array_contains("kept", x["line_no"])).alias("removed")))
    each = each.select("doc_id", "rid", lines.alias("lines"))
    gone = F.transform(F.filter("lines", lambda x: x["removed"]), lambda x: x["line_no"])
    return each.select("doc_id", "rid", F.size("lines").alias("n_lines"), gone.alias("removed"), "lines")


def kept_digest() -> Column:
    """md5 over the md5 digests, as hex, of the lines kept, in order."""
    return F.md5(F.array_join(F.transform(F.filter("lines", lambda x: ~x["removed"]), lambda x: F.lower(F.hex(x["digest"]))), ""))


def without_repeats(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs with the removed lines taken out of `text`; all other columns, whatever their names, and rows stay, also those
    left without lines."""
    found = decisions.where(F.size("removed") > 0).select(F.col("doc_id").alias("id"), "rid", "removed")
    own = docs.select(F.struct(*docs.columns).alias("row")).select("row", F.xxhash64("row.text").alias("hash"))
    rows = own.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("rid")), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    return rows.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
