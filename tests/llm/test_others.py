import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from tesserae.llm import fingerprints, langid, media, queries

from .helpers import TEXTS, empty, fixture


def test_language_accuracy_on_held_out(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op5_langid(spark, sf).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def grams_of(text):
    padded = b"\0\0\0" + text
    found, counts = np.unique([int.from_bytes(padded[i - 3 : i + 1], "big") for i in range(3, len(padded))], return_counts=True)
    return found.astype(np.int64), counts.astype(np.int64)


def plain_bits(learned, probe):
    """Code length of probe after learned, by counting symbols in lists: orders 3 to 0, method C, 256 bytes at the end."""
    padded, chain = b"\0\0\0" + learned, b"\0\0\0" + probe
    history = [padded[i - 3 : i + 1] for i in range(3, len(padded))]

    def p(context, x, order):
        if order < 0:
            return 1 / 256
        seen = [h[3] for h in history if h[3 - order : 3] == context[3 - order :]]
        if not seen:
            return p(context, x, order - 1)
        n, d = len(seen), len(set(seen))
        return seen.count(x) / (n + d) if x in seen else d / (n + d) * p(context, x, order - 1)

    return -sum(np.log2(p(chain[i - 3 : i], chain[i], 3)) for i in range(3, len(chain)))


def test_code_lengths_equal_a_plain_model():
    import pyarrow as pa

    learned = {"en": "abracadabra", "ru": "мама мыла раму, рама мала", "zh": "人人为我 我为人人", "xx": "ABRA cad\t%%%"}
    pairs = [grams_of(t.encode()) for t in learned.values()]
    model = langid.Model(list(learned), [g for g, _ in pairs], [c for _, c in pairs])
    probes = ["bracadz", "ABRACADABRA", "рама мыла", "мы за мир", "为人", "人 a м", ""]
    found, lengths = langid.code_lengths(model, pa.array(probes), block=5)
    for k, probe in enumerate(probes):
        assert lengths[k] == len(probe.encode())
        for n, text in enumerate(learned.values()):
            assert np.isclose(found[k, n], plain_bits(text.encode(), probe.encode()), rtol=1e-6)
    assert found[:6].argmin(1).tolist()[:5] == [0, 3, 1, 1, 2]


def test_every_byte_is_a_symbol_whatever_the_languages():
    import pyarrow as pa

    def grams(text):
        padded = b"\0\0\0" + text.encode()
        found, counts = np.unique([int.from_bytes(padded[i - 3 : i + 1], "big") for i in range(3, len(padded))], return_counts=True)
        return found.astype(np.int64), counts.astype(np.int64)

    # 26 languages with the same prose, each with a rare letter of its own
    prose = "the quick brown fox jumps over the lazy dog " * 20
    own = [chr(65 + k) for k in range(26)]
    learned = [grams(prose + x * 30) for x in own]
    model = langid.Model(own, [g for g, _ in learned], [c for _, c in learned])
    bits = langid.code_lengths(model, pa.array([f"the fox {x * 6}" for x in own]))[0]
    assert bits.argmin(1).tolist() == list(range(26))
    alone = [langid.code_lengths(langid.Model([x], [g], [c]), pa.array([f"the fox {x * 6}"]))[0][0, 0] for x, (g, c) in zip(own, learned, strict=True)]
    assert np.allclose(bits.min(1), alone)


def test_language_edge_cases(spark):
    model = langid.train(fixture(spark))
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(fixture(spark), model).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und")} <= rows and (1, "en") in rows
    assert {r.lang_pred for r in langid.identify(fixture(spark), langid.train(empty(spark))).collect()} == {"und"}
    kept = langid.identify(fixture(spark), model, keep=["doc_id", "source", "size"])
    assert kept.columns == ["doc_id", "source", "size", "lang_pred", "score", "bits_per_byte"] and kept.count() == len(TEXTS)
    assert langid.identify(empty(spark), model).count() == 0


def test_fingerprints_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    expected = sorted(con.sql(queries.ORACLE_SQL["op8_fingerprints"]).select(*columns).fetchall())
    assert sorted(map(tuple, queries.op8_fingerprints(spark, sf).select(*columns).collect())) == expected


def test_fingerprint_ranges_and_edge_cases(spark):
    rows = fingerprints.fingerprints_with_edits(fixture(spark), 3).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.fingerprints_with_edits(empty(spark), 3).count() == 0
    docs = spark.createDataFrame([(k, f"text {k:03d}") for k in range(200)], "doc_id long, text string")
    for r in fingerprints.fingerprints_with_edits(docs, 9).collect():
        assert r.edited == r.text[:6] + "te"


def test_media_round_trip(spark, sf):
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op9_media(spark, sf).collect():
        raw = texts[r.doc_id]
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


@pytest.mark.parametrize("shape", [(5, 7), (1, 1), (6, 3, 3)])
def test_image_formats(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_netpbm(image)) == image).all() and (media.decode(media.encode_bmp(image)) == image).all()
    plain = b"P%d\n# note\n%d %d 255\n" % (3 if len(shape) == 3 else 2, shape[1], shape[0]) + b" ".join(b"%d" % v for v in image.ravel())
    assert (media.decode(plain) == image).all()


def test_bitmaps_and_resizing():
    bits = np.array([[1, 0, 1], [0, 1, 1]], np.uint8)
    expected = (1 - bits) * 255
    assert (media.decode(b"P1\n3 2\n1 0 1\n011") == expected).all() and (media.decode(b"P4\n3 2\n" + np.packbits(bits, axis=1).tobytes()) == expected).all()
    wide = np.random.default_rng(2).integers(0, 65536, (4, 5)).astype(np.uint16)
    assert (media.decode(media.encode_netpbm(wide)) == wide).all()
    image = np.random.default_rng(3).integers(0, 256, (12, 18)).astype(np.uint8)
    assert np.allclose(media.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3).mean((1, 3)))
    assert np.isclose(media.area_resize(image, 5, 7).mean(), image.mean()) and np.allclose(media.area_resize(image, 12, 18), image)
    assert media.difference_hash(np.tile(np.arange(90, dtype=np.uint8), (16, 1))) == "ff" * 8
    assert np.load(__import__("io").BytesIO(media.tile_of(image))).shape == (32, 32)


def test_media_edge_cases(spark):
    rows = media.media_features(media.store_payloads(fixture(spark))).collect()
    assert len(rows) == len(TEXTS) and all(len(r.samples) == r.height * r.width for r in rows)
    assert media.media_features(media.store_payloads(empty(spark))).count() == 0
