import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import packing, queries, token_store
from tesserae.llm.encoding import WordEncoder, tokenizer_path

from .helpers import TEXTS, empty, fixture


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = reference_ids.__dict__.setdefault("t", Tokenizer.from_file(tokenizer_path()))
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_encoder_equals_whole_text_encoding(spark, sf):
    texts = [t for _, t, *_ in TEXTS] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["e ́x", "a b c　d", "x <|startoftext|>y", "\r\n\tz", "Σίσυφος ΣΑΣ"]
    flat, lengths = WordEncoder(tokenizer_path()).encode(pa.array(texts))
    ends = np.cumsum(lengths)
    for text, a, b in zip(texts, ends - lengths, ends, strict=True):
        assert flat[a:b].tolist() == reference_ids(text)


def test_word_encoder_on_marks_and_letters():
    rng = random.Random(2)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [" ".join(pick("abçÉßÿzQ'9", rng.randint(0, 6)) + pick("""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""", rng.randint(0, 4)) + pick("s't9é", rng.randint(0, 2)) for _ in range(40)) for _ in range(200)]
    flat, lengths = WordEncoder(tokenizer_path()).encode(pa.array(texts))
    ends = np.cumsum(lengths)
    for text, a, b in zip(texts, ends - lengths, ends, strict=True):
        assert flat[a:b].tolist() == reference_ids(text)


@pytest.mark.parametrize("top", [1, 256, 257, 70_000, 2**32])
def test_segment_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    lengths = np.array([3, 0, 1500, 1])
    ids = rng.integers(0, top, lengths.sum(), dtype=np.uint64).astype(np.uint32)
    segment = token_store.Segment(token_store.pack_segment([5, None, 7, 7], lengths, ids))
    assert [segment.token(i) for i in range(len(ids))] == ids.tolist()
    assert [d for d, *_ in segment.documents()] == [5, None, 7, 7]
    assert np.concatenate([x for *_, x in segment.documents()]).tolist() == ids.tolist()


def test_token_store_of_documents(spark, sf):
    rows = {r.doc_id: r for r in queries.op7_token_store(spark, sf).collect()}
    start = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*reference_ids(d.text), 1], "<u4")
        assert (rows[d.doc_id].start, rows[d.doc_id].n_tokens, rows[d.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_store_edge_cases(spark):
    segments = token_store.write_tokens(fixture(spark), tokenizer_path())
    rows = token_store.read_tokens(segments).collect()
    assert len(rows) == len(TEXTS) and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert token_store.read_tokens(token_store.write_tokens(empty(spark), tokenizer_path())).count() == 0


def check_pieces(pieces, expected):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for runs in by_sequence.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at and length > 0
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    for doc_id, n in expected.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == n
            at += p.length
        assert at == n


def test_packing_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {d.doc_id: np.array([*reference_ids(d.text), 2], "<u4") for d in docs}
    pieces = queries.op10_packing(spark, sf).collect()
    check_pieces(pieces, {d: len(x) for d, x in ids.items()})
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())


def test_step_groups_are_balanced_over_all_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 20_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = packing.pack(docs, tokenizer_path()).collect()
    windows = {(r.sequence_id, r.tier, r.step_group): 0 for r in rows}
    assert len(windows) == len({r.sequence_id for r in rows}) and len({r.sequence_id >> packing.TASK_BITS for r in rows}) > 1
    for r in rows:
        windows[r.sequence_id, r.tier, r.step_group] += r.length
    sizes = defaultdict(int)
    for (_, tier, group), n in windows.items():
        sizes[tier, group] += n
    for tier in packing.TIERS:
        own = [sizes[tier, g] for g in range(1 + max((g for t, g in sizes if t == tier), default=-1))]
        assert all(abs(n - 20_000) < tier for n in own[:-1]) and (len(own) > 1 or tier < 4096)


def test_packing_in_chunks_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    packer, out = packing.Packer(0), []
    lengths = [int(n) for n in rng.geometric(1 / 700, 4000)]
    for d, n in enumerate(lengths):
        packer.add(d, np.arange(n, dtype=np.uint32))
        if d % 500 == 499:
            out.append(packer.flush())
    out.append(packer.flush(True))
    from types import SimpleNamespace

    pieces = [SimpleNamespace(**dict(zip(o, v, strict=True))) for o in out for v in zip(*o.values(), strict=True)]
    check_pieces(pieces, dict(enumerate(lengths)))
    assert len(pieces) < 2.5 * len(lengths)
    rows = packing.pack(fixture(spark), tokenizer_path()).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * 8 and sum(r.length for r in rows if r.doc_id in (3, 4, 5)) == 3
    assert packing.pack(empty(spark), tokenizer_path()).count() == 0
