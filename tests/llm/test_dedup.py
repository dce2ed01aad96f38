import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import common, line_dedup, minhash, queries, shingles, suffix_dedup
from tesserae.llm.suffix_grouping import suffix_array

from .helpers import DOCS, TEXTS, empty, fixture


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(xs):
    assert suffix_array(np.array(xs, np.int64)).tolist() == sorted(range(len(xs)), key=lambda i: xs[i:]) if xs else True


def brute_removal(texts, window):
    counts = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((sum(gone), bytes(gone).count(b"\0\1") + (gone[:1] == b"\1"), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


def suffix_docs():
    rng = np.random.default_rng(4)
    passage = "".join(map(chr, rng.integers(97, 123, 700)))
    fresh = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = [fresh(300) + passage + fresh(50), passage[:450], fresh(900), "ab" * 500, "ab" * 300, passage[:399], None, "", "é" * 250, fresh(600) * 2, passage[100:650] + fresh(10)]
    return texts + [fresh(80) + passage[50:600] + fresh(70) for _ in range(8)] + [texts[2]]


def words_from(text, words, least):
    """The string of so many whole words that begins at each word, if it is long enough."""
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    strings = {at[k][0]: at[k + words - 1][1] for k in range(len(at) - words + 1)}
    return {a: b for a, b in strings.items() if b - a >= least}


def brute_passages(texts, window, words, least):
    """Per text the bytes covered by strings of `window` bytes, or of `words` whole words, that start elsewhere too."""
    whole = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    wanted = {t[a:b] for t in texts for a, b in words_from(t, words, least).items() if b - a < window}
    sizes = {len(s) for s in wanted}
    parts = Counter(s for t in texts for n in sizes for i in range(len(t) - n + 1) if (s := t[i : i + n]) in wanted)
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if whole[t[i : i + window]] > 1:
                hit[i : i + window] = b"\1" * window
        for a, b in words_from(t, words, least).items():
            if parts[t[a:b]] > 1:
                hit[a:b] = b"\1" * (b - a)
        out.append(sum(hit))
    return out


@pytest.mark.parametrize("hot", [5000, 2])
def test_suffix_dedup_equals_brute_force(spark, hot):
    texts = suffix_docs()
    rows = suffix_dedup.remove_repeats(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), hot=hot).collect()
    found = {bytes(r.key): (r.n_removed, len(r.spans), bytes(r.kept)) for r in rows}
    again = {bytes(r.key): sum(x.stop - x.start for x in r.passages) for r in rows}
    raw = [(t or "").encode() for t in texts]
    for t, expected, covered in zip(raw, brute_removal(raw, 400), brute_passages(raw, 400, 51, 240), strict=True):
        assert found[hashlib.md5(t).digest()] == expected
        assert again[hashlib.md5(t).digest()] == covered


def covered(texts, window, words, least):
    """What the core finds in distinct texts without Spark: covered bytes of (removed strings, passages too)."""
    rows = []
    for k, t in enumerate(texts):
        for anchor, a, b in suffix_dedup.anchors_of(np.frombuffer(t, np.uint8), least).T.tolist():
            rows.append((anchor, k, a, (b" " + t)[a : b + 1 + window], b - a + 1))
    count = Counter(r[0] for r in rows)
    out = [(bytearray(len(t)), bytearray(len(t))) for t in texts]
    for k, a, b, passage in suffix_dedup.solve(sorted((r for r in rows if count[r[0]] > 1), key=lambda r: r[0]), window, words, least):
        for marks in out[k][passage:]:
            marks[a:b] = b"\1" * (b - a)
    return [(sum(g), sum(p)) for g, p in out]


def random_texts(rng):
    letters = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8))) for _ in range(rng.choice([5, 40, 400]))]
    text = lambda n: " ".join(rng.choice(letters) for _ in range(n)).replace(" a", " \n", 1)
    base, out = text(400), set()
    for _ in range(rng.randint(2, 20)):
        kind, i = rng.random(), rng.randrange(len(base))
        passage = text(rng.randint(0, 60)) + rng.choice(["", " "]) + base[i : i + rng.randint(0, 900)] + rng.choice(["", " "]) + text(rng.randint(0, 60))
        out.add((text(rng.randint(1, 200)) if kind < 0.2 else rng.choice(["ab", "a", text(7) + " "]) * rng.randint(1, 300) if kind < 0.3 else passage + base[5:300] * (kind < 0.5)).encode())
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_core_equals_brute_force(seed):
    rng = random.Random(seed)
    window, words, least = rng.choice([(400, 51, 240), (120, 12, 60), (100, 9, 57)])
    texts = random_texts(rng)
    expected = [(n, p) for (n, *_), p in zip(brute_removal(texts, window), brute_passages(texts, window, words, least), strict=True)]
    assert covered(texts, window, words, least) == expected


def test_repeats_come_from_the_suffix_array(monkeypatch):
    rng = random.Random(3)
    texts = random_texts(rng)
    right = covered(texts, 100, 9, 57)
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda symbols: np.arange(len(symbols)))
    assert sum(n for n, _ in right) > 0 and covered(texts, 100, 9, 57) != right


def test_suffix_dedup_edge_cases(spark):
    assert suffix_dedup.remove_repeats(fixture(spark)).count() == len({t or "" for _, t, *_ in TEXTS})
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_word_hashes_by_chunks(monkeypatch):
    text = ("Alpha beta " * 50 + "x" * 300 + "\tGAMMA").encode()
    whole = shingles.word_hashes(np.frombuffer(text, np.uint8))
    assert len(whole) == len(text.split())
    monkeypatch.setattr(shingles, "CHUNK", 37)
    assert (shingles.word_hashes(np.frombuffer(text, np.uint8)) == whole).all()
    a, b = shingles.shingle_sets(pa.array(["One two", "one TWO"]), 2)
    assert (a == b).all() and len(shingles.shingle_set(whole[:0], 2)) == 0


def test_minhash_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = sorted(con.sql(queries.ORACLE_SQL["op4_minhash"]).select("doc_id", "n_shingles", "component_id", "kept").fetchall())
    found = queries.op4_minhash(spark, sf)
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id", "kept").collect())) == expected


def near_copies(n=60):
    """A large group of near copies: all within reach of a base, many not of each other; and chains."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(120)]
    out = [" ".join(words)]
    for _ in range(n):
        w = list(words)
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            w[k] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


def test_minhash_links_within_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", 7)
    texts = near_copies()
    docs = spark.createDataFrame([(k + 10, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2).collect()}
    sets = [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]
    part = list(range(len(texts)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                part[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {k + 10: root(k) + 10 for k in range(len(texts))}


def test_minhash_edge_cases(spark):
    rows = minhash.near_duplicates(fixture(spark), 5).collect()
    assert len(rows) == len(TEXTS)
    by = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert by[(1, 3)] == by[(2, 3)] == 1 and by[(3, 0)] == 3 and by[(5, 0)] == 5
    assert minhash.near_duplicates(empty(spark), 5).count() == 0


def test_line_dedup_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    expected = sorted(con.sql(queries.ORACLE_SQL["op1_line_dedup"]).select("doc_id", "n_lines", "n_removed", "kept_digest").fetchall())
    assert sorted(map(tuple, queries.op1_line_dedup(spark, sf).select("doc_id", "n_lines", "n_removed", "kept_digest").collect())) == expected


def test_line_dedup_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j\n\nx y"), (2, "x y\na b c d e f g h i K"), (3, "j i h g f e d c b a"), (4, None), (None, "x Y"), (2, "other")], "doc_id long, text string")
    found = line_dedup.find_repeats(docs)
    gone = {(r.doc_id, r.n_lines): r.removed for r in found.collect()}
    assert gone == {(1, 3): [2], (2, 2): [0, 1], (3, 1): [0], (4, 1): [], (None, 1): [], (2, 1): []}
    kept = {(r.doc_id, r.text) for r in line_dedup.without_repeats(docs, found).collect()}
    assert kept == {(1, "a b c d e f g h i j\n"), (2, ""), (3, ""), (4, None), (None, "x Y"), (2, "other")}
    assert line_dedup.without_repeats(fixture(spark), line_dedup.find_repeats(fixture(spark))).count() == len(TEXTS)
    assert line_dedup.find_repeats(empty(spark)).count() == 0 and DOCS


def test_line_dedup_tells_rare_words_apart(spark):
    # counters up to four times the mean are told apart too
    table = line_dedup.rarity_table(spark.range(400_000).selectExpr("id as doc_id", "concat('w', id) as text"))
    assert table.count(1) < line_dedup.COUNTERS / 2 and min(table) == 1


def test_line_dedup_hot_tokens_equal_all_pairs(spark, monkeypatch):
    base = [f"word{i}" for i in range(20)]
    lines = [" ".join(base[:k] + [f"x{k}{j}" for j in range(20 - k)]) for k in range(12, 21)] + [" ".join(base[1:]), " ".join(base[2:] + ["y"])]
    docs = spark.createDataFrame([(i, f"{line}\nown{i} line{i}") for i, line in enumerate(lines)], "doc_id long, text string")
    sets = [set(line.split()) for line in lines]
    expected = {i: [0] if any(5 * len(a & b) >= 4 * len(a | b) for a in sets[:i]) else [] for i, b in enumerate(sets)}
    for hot in (1, 3, 1_000):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert {r.doc_id: r.removed for r in line_dedup.find_repeats(docs, f"hot{hot}").collect()} == expected
    assert 0 < sum(map(len, expected.values())) < len(lines)


def test_line_dedup_near_copies_make_no_square_of_pairs(spark, monkeypatch):
    base = [f"word{i}" for i in range(30)]
    copies = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(30)] + [" ".join([*base, f"y{k}", f"z{k}"]) for k in range(170)]
    docs = spark.createDataFrame([(i, f"own{i} line{i}\n{line}") for i, line in enumerate(copies)], "doc_id long, text string")
    made = {}

    def counted(df, label, *more):
        out = common.written(df, label, *more)
        made[label] = out.count() if {"early", "late"} == set(df.columns) else 0
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    sets = [set(line.split()) for line in copies]
    expected = {i: [1] if any(5 * len(a & b) >= 4 * len(a | b) for a in sets[:i]) else [] for i, b in enumerate(sets)}
    assert {r.doc_id: r.removed for r in line_dedup.find_repeats(docs, "near").collect()} == expected
    # each copy has up to eight prefix tokens; all pairs of 200 are 19,900
    assert 150 < sum(made.values()) < 8 * 200


def test_line_dedup_hashes_texts_once_and_shuffles_postings_once(spark, monkeypatch):
    # near copies settled before the join, others that only the join finds, white space of every kind, one line blank by it
    base = [f"word{i}" for i in range(30)]
    texts = [" ".join(base), "\t".join([*base[:29], "x"]), "\v".join([*base[:27], "y", "z", "w"]), "\f".join(base[::-1]) + "\r", " \t\v\f\r", "A\tb  c\rd e", "e d\vc b a", *[" ".join([*base[:k], f"q{k}", *base[k + 1 :]]) for k in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.lower().split()) for t in texts]
    expected = {i: [0] if b and any(5 * len(a & b) >= 4 * len(a | b) for a in sets[:i]) else [] for i, b in enumerate(sets)}
    hashed, plans = [], {}
    once = line_dedup.word_hashes
    monkeypatch.setattr(line_dedup, "word_hashes", lambda line: hashed.append(line) or once(line))

    def seen(df, label, *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return common.written(df, label, *more)

    monkeypatch.setattr(line_dedup, "written", seen)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert {r.doc_id: r.removed for r in line_dedup.find_repeats(docs, "once").collect()} == expected
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(hashed) == 1
    assert re.search(r"ReusedExchange [^\n]* Exchange hashpartitioning\(token", plans["once-pairs"])


def test_line_dedup_leaves_texts_with_unique_numbers_where_they_are_read(spark):
    texts = {-5: "a b\n\nC", 2**31: "b A", 7: None, 0: "c\nc"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lines = line_dedup.hashed_lines(docs)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    rows = sorted(lines.collect())
    assert [(r.doc_id, r.line_no) for r in rows] == [(-5, 0), (-5, 1), (-5, 2), (0, 0), (0, 1), (7, 0), (2**31, 0)]
    assert len({r.node for r in rows}) == 7 and {(r.doc_id, *r.removed) for r in line_dedup.find_repeats(docs, "unique").collect()} == {(-5,), (0, 0, 1), (7,), (2**31, 0)}
    assert line_dedup.first_id(docs) == -5
    for more in [(7, "x"), (None, "x"), (2**32 - 5, "x")]:
        assert line_dedup.first_id(docs.union(spark.createDataFrame([more], docs.schema))) is None
    assert line_dedup.first_id(empty(spark)) is None and line_dedup.first_id(docs.withColumn("doc_id", F.col("doc_id").cast("string"))) is None


def test_line_dedup_sorts_tokens_as_longs(spark):
    lines = spark.createDataFrame([([3, None, 1],)], "hashes array<long>")
    assert not lines.select(line_dedup.tokens_of(F.col("hashes"), line_dedup.levels_of(b"\1" * line_dedup.COUNTERS)).alias("t")).schema["t"].dataType.containsNull


def test_line_dedup_finds_pairs_by_the_first_tokens_of_the_smaller(spark, monkeypatch):
    # sets of 4 to 75 words of few words, many just above or below the bound, most of unequal sizes, in any order
    rng = random.Random(3)
    sets = []
    for k in range(24):
        whole = [f"w{rng.randrange(300)}x{k}" for _ in range(rng.randrange(4, 75))]
        for _ in range(6):
            some = rng.sample(whole, max(1, round(len(whole) * rng.uniform(0.75, 1))))
            sets.append({*some, *[f"v{rng.randrange(99)}" for _ in range(rng.randrange(1 + len(whole) // 9))]})
    rng.shuffle(sets)
    docs = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in enumerate(sets)], "doc_id long, text string").repartition(3)
    expected = {i: [0] if any(5 * len(a & b) >= 4 * len(a | b) for a in sets[:i]) else [] for i, b in enumerate(sets)}
    plans = {}

    def seen(df, label, *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return common.written(df, label, *more)

    monkeypatch.setattr(line_dedup, "written", seen)
    # all is found by the join alone
    monkeypatch.setattr(line_dedup, "near_pairs", lambda firsts, label: common.written(firsts.select(F.col("node").alias("early"), F.col("node").alias("late")).limit(0), label))
    assert {r.doc_id: r.removed for r in line_dedup.find_repeats(docs, "small").collect()} == expected
    assert 40 < sum(map(len, expected.values())) < 130
    assert "monotonically_increasing_id() >= 0" in plans["small-pairs"]
