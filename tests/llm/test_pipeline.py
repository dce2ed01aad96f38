from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from tesserae.llm.common import components, range_bucket
from tesserae.llm.encoding import tokenizer_path

from .helpers import fixture


def test_components(spark):
    from pyspark.sql import functions as F

    edges = [(k, k + 1) for k in range(20)] + [(30, 31), (40, 31), (31, 30)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {found[k] for k in range(21)} == {0} and {found[k] for k in (30, 31, 40)} == {30}
    bounds = list(range(0, 1000, 5))
    rows = spark.range(-3, 1010).select("id", range_bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in rows)


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = p.documents(spark, sf)
    out = [docs]
    for name, stage in p.STAGES:
        out.append(p.written(stage(spark, out[-1], sf), f"test-{name}"))
    return out


def test_columns_and_rows(stages):
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    counts = [s.count() for s in stages]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[1] >= 0.95 * counts[0]


def test_line_stage_against_brute_force(stages):
    before = [(r.doc_id, r.text) for r in stages[1].orderBy("doc_id").collect()]
    after = {r.doc_id: r.text for r in stages[2].collect()}
    seen = []
    for d, text in before:
        kept = []
        for line in text.split("\n"):
            words = set(line.lower().split())
            if not words or not any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                kept.append(line)
            if words:
                seen.append(words)
        expected = "\n".join(kept)
        assert after.get(d, "") == (expected if expected.split() else "")


def test_near_stage_against_brute_force(stages):
    sets = {}
    for r in stages[2].collect():
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in r.text.split()]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    part = {d: d for d in sets}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    assert {r.doc_id for r in stages[3].collect()} == {root(d) for d in ids}


def test_mix_and_pack_stages(stages):
    words = Counter({r.doc_id: len(r.text.split()) for r in stages[3].collect()})
    copies = Counter(r.doc_id for r in stages[4].collect())
    total = sum(words.values())
    taken = sum(words[d] * c for d, c in copies.items())
    assert max(copies.values()) <= 2 and 1.5 * total - max(words.values()) <= taken <= 1.5 * total
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    tokens = sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    assert sum(r.length for r in stages[5].collect()) == tokens


def test_stages_bear_edge_cases(spark, sf):
    docs = fixture(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES:
        docs = p.written(stage(spark, docs, sf), f"edge-{name}")
    assert docs.count() > 0


def test_no_column_name_of_the_documents_clashes(spark, sf):
    """Extra columns with the names of working columns pass through every stage but the last unchanged."""
    names = ["_removed", "_doc", "_text_hash", "_hash", "_finish", "id", "rid", "removed", "hash", "digest", "finish", "copies", "row", "first", "lang_pred_", "node", "token"]
    docs = fixture(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumns({c: F.lit(k) for k, c in enumerate(names)})
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, sf), f"names-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
        assert {tuple(r)[5:] for r in docs.collect()} == {tuple(range(len(names)))}
