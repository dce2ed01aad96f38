"""One query for each operator, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import find_repeats, kept_digest

    docs = documents(spark, sf_dir)
    found = find_repeats(docs).select(F.col("doc_id").alias("id"), "rid", F.col("n_lines").cast("long"), F.size("removed").cast("long").alias("n_removed"), kept_digest().alias("kept_digest"))
    own = docs.select("doc_id", F.xxhash64("text").alias("own"))
    return own.join(found, own["doc_id"].eqNullSafe(found["id"]) & (own["own"] == found["rid"])).select("doc_id", "n_lines", "n_removed", "kept_digest")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    docs = documents(spark, sf_dir)
    in_passages = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    found = remove_repeats(docs).select("key", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), in_passages.alias("n_passage"))
    own = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    return own.join(found, "key").drop("key")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    rows = near_duplicates(documents(spark, sf_dir), width=2)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, train

    docs = documents(spark, sf_dir)
    return identify(docs, train(docs.where(~held_out())))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(documents(spark, sf_dir), [1.0] * 8)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encoding import tokenizer_path
    from .token_store import read_tokens, segment_starts, write_tokens

    segments = write_tokens(documents(spark, sf_dir), tokenizer_path(), end_id=1)
    read = read_tokens(segments).select("part", "seq", "doc_id", "local_start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(segment_starts(segments), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import word_count
    from .fingerprints import fingerprint, fingerprints_with_edits

    rows = fingerprints_with_edits(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("kept"), word_count(F.col("text"))).alias("fingerprint"),
        fingerprint(F.col("edited_kept"), word_count(F.col("edited"))).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import WIDTH, media_features, store_payloads

    rows = media_features(store_payloads(documents(spark, sf_dir)))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("samples"), F.octet_length("samples") - (WIDTH - 1), F.lit(WIDTH))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("-", "dhash", F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encoding import tokenizer_path
    from .packing import pack

    pieces = pack(documents(spark, sf_dir), tokenizer_path(), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_minhash": op4_minhash,
    "op5_langid": op5_langid,
    "op6_sharding": op6_sharding,
    "op7_token_store": op7_token_store,
    "op8_fingerprints": op8_fingerprints,
    "op9_media": op9_media,
    "op10_packing": op10_packing,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
t AS (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS s FROM l),
c AS (SELECT s, len(s) AS n, min((doc_id, line_no)) AS first FROM t WHERE len(s) > 0 GROUP BY s),
i AS (SELECT *, row_number() OVER (ORDER BY first) AS node FROM c),
e AS (SELECT node, n, unnest(s) AS x FROM i),
df AS (SELECT x, count(*) AS df FROM e GROUP BY x HAVING count(*) > 1),
o AS (SELECT node, n, x, row_number() OVER (PARTITION BY node ORDER BY coalesce(df, 1), x) AS pos FROM e LEFT JOIN df USING (x)),
p AS (SELECT DISTINCT a.node AS a, b.node AS b FROM o a JOIN o b ON a.x = b.x AND a.node < b.node AND least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4
      WHERE a.pos <= a.n - ceil(0.8 * a.n) + 1 AND b.pos <= b.n - ceil(0.8 * b.n) + 1),
m AS (SELECT DISTINCT p.b AS node FROM p JOIN i x ON x.node = p.a JOIN i y ON y.node = p.b
      WHERE 5 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
r AS (SELECT t.*, len(t.s) > 0 AND (m.node IS NOT NULL OR (t.doc_id, t.line_no) <> i.first) AS removed
      FROM t LEFT JOIN i ON t.s = i.s LEFT JOIN m ON i.node = m.node)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE removed)::BIGINT AS n_removed,
       md5(coalesce(string_agg(md5(line), '' ORDER BY line_no) FILTER (WHERE NOT removed), '')) AS kept_digest
FROM r GROUP BY doc_id
""",
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS order_key
  FROM documents),
src AS (SELECT source, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM src),
ratio AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS ratio,
                 1.5 * (SELECT sum(source_size) FROM src) AS budget FROM ranked),
filled AS (
  SELECT *, budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
         sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM ratio),
level AS (SELECT coalesce(max(room / ws) FILTER (WHERE cap * ws > weight * room), 0) AS share FROM filled),
targets AS (SELECT source, source_rank, source_size, weight, budget,
                   CASE WHEN cap * ws <= weight * room THEN cap ELSE weight * share END AS target FROM filled, level),
queued AS (
  SELECT s.doc_id, s.size, s.order_key, t.*,
         sum(s.size) OVER (PARTITION BY t.source_rank ORDER BY s.order_key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT doc_id, size, order_key, source_rank, budget, e AS epoch, (e * source_size + cum)::DOUBLE / weight AS finish
  FROM queued, (SELECT unnest([0, 1]) AS e) WHERE size > 0),
upto AS (SELECT *, sum(size) OVER (ORDER BY finish, source_rank, epoch, order_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies),
taken AS (SELECT doc_id, count(*)::BIGINT AS copies FROM upto WHERE upto <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, round(q.target, 6) AS target,
       (q.size * coalesce(t.copies, 0))::BIGINT AS taken, coalesce(t.copies, 0)::BIGINT AS copies,
       q.cum::DOUBLE / q.weight AS finish
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id
""",
    "op4_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                          WHEN len(w) = 1 THEN w ELSE []::VARCHAR[] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
link AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
""",
    "op6_sharding": r"""
WITH tbl AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t),
b AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, key, length(h) // 2 AS n, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS x FROM b),
c AS (SELECT doc_id, key, n + 1 AS size, xor(list_reduce(x, lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM x, tbl),
s AS (SELECT *, list_transform(range(0, 9), lambda k: -ln((('0x' || md5(key || '|' || k)[1:13])::BIGINT + 1)::DOUBLE / 4503599627370497.0)) AS score FROM c),
p AS (SELECT *, list_position(score[1:8], list_min(score[1:8])) - 1 AS shard, list_position(score, list_min(score)) - 1 AS grown_shard FROM s)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key || '|' || text_crc32 || '|' || size)) - 1 AS slot
FROM p
""",
    "op8_fingerprints": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
nx AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text
       FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, text)),
ed AS (SELECT *, array_to_string(list_concat(string_split(text, '')[1:n_chars - n_chars // 4], string_split(next_text, '')[1:n_chars // 4]), '') AS edited FROM nx),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w0, regexp_extract_all(edited, '[^\x20\x09-\x0D]+') AS w1,
             regexp_extract_all(next_text, '[^\x20\x09-\x0D]+') AS w2 FROM ed),
h AS (SELECT *,
  CASE WHEN len(w0) >= 5 THEN list_transform(range(1, len(w0) - 3), lambda i: md5(array_to_string(w0[i:i+4], ' '))) WHEN len(w0) > 0 THEN [md5(array_to_string(w0, ' '))] ELSE []::VARCHAR[] END AS h0,
  CASE WHEN len(w1) >= 5 THEN list_transform(range(1, len(w1) - 3), lambda i: md5(array_to_string(w1[i:i+4], ' '))) WHEN len(w1) > 0 THEN [md5(array_to_string(w1, ' '))] ELSE []::VARCHAR[] END AS h1,
  CASE WHEN len(w2) >= 5 THEN list_transform(range(1, len(w2) - 3), lambda i: md5(array_to_string(w2[i:i+4], ' '))) WHEN len(w2) > 0 THEN [md5(array_to_string(w2, ' '))] ELSE []::VARCHAR[] END AS h2
  FROM w),
k AS (SELECT *,
  list_sort(list_distinct(list_transform(list_filter(h0, lambda x: x < '2'), lambda x: x[1:8]))) AS k0,
  list_sort(list_distinct(list_transform(list_filter(h1, lambda x: x < '2'), lambda x: x[1:8]))) AS k1,
  list_sort(list_distinct(list_transform(list_filter(h2, lambda x: x < '2'), lambda x: x[1:8]))) AS k2 FROM h)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  len(w0)::VARCHAR || ':' || coalesce(array_to_string(k0, ''), '') AS fingerprint,
  len(w1)::VARCHAR || ':' || coalesce(array_to_string(k1, ''), '') AS edited_fingerprint,
  CASE WHEN text = edited THEN 1.0 WHEN least(len(k0), len(k1)) = 0 THEN 0.0 ELSE len(list_intersect(k0, k1))::DOUBLE / least(len(k0), len(k1)) END::DOUBLE AS near_edited,
  CASE WHEN text = next_text THEN 1.0 WHEN least(len(k0), len(k2)) = 0 THEN 0.0 ELSE len(list_intersect(k0, k2))::DOUBLE / least(len(k0), len(k2)) END::DOUBLE AS near_next
FROM k
""",
}
