"""The thin queries of the ten operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import license as licenses
from wakeline.llm import decontam, mixing, packing, quality, quotes, repeats, simhash, urlgraph, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source", "times")


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(_table(spark, sf_dir, "conversations"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.FEATURES, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP6_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
r AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) FROM rules
    WHERE ('.' || p.host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(p.path, substr(rule, strpos(rule, '/')))) AS m FROM p),
seed AS (
  SELECT host, avg(CASE WHEN m.verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS t, avg(CASE WHEN m.verdict = 'block' THEN 1.0 ELSE 0.0 END) AS d FROM r WHERE host <> '' GROUP BY host),
link AS (SELECT host AS src, lower(unnest(regexp_extract_all(html, '\shref\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1, 'i'))) AS dst FROM p),
edge AS (SELECT src, dst, count(*) AS n FROM link WHERE src <> '' AND src <> dst GROUP BY ALL),
flow AS (
  SELECT 't' AS kind, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS w FROM edge
  UNION ALL SELECT 'd', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edge),
start AS (SELECT 't' AS kind, host, 0.15 * t AS s FROM seed UNION ALL SELECT 'd', host, 0.15 * d FROM seed),
walk AS (
  SELECT 0 AS k, kind, host, s FROM start
  UNION ALL
  SELECT k + 1, kind, host, sum(s) FROM (SELECT walk.k, walk.kind, b AS host, 0.85 * w * s AS s FROM walk JOIN flow ON walk.kind = flow.kind AND walk.host = flow.a WHERE walk.k < 100) GROUP BY ALL),
score AS (SELECT host, sum(CASE kind WHEN 't' THEN s ELSE 0 END) AS trust, sum(CASE kind WHEN 'd' THEN s ELSE 0 END) AS distrust FROM walk GROUP BY host)
SELECT page_id, r.host, path, m.rule AS rule, coalesce(m.verdict, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > 0.075 THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN score ON r.host = score.host
"""

OP8_SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
grams AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT)::BIGINT AS x FROM b GROUP BY source),
p AS (SELECT sum(x)::DOUBLE / sum(n)::DOUBLE AS m, coalesce(var_pop(x / n), 0) AS s2 FROM h),
k AS (SELECT m, CASE WHEN s2 <= 0 THEN 1e6 ELSE greatest(1.0, least(1e6, m * (1 - m) / s2 - 1)) END AS k FROM p),
r AS (SELECT source, (x + m * k) / (n + k) AS rate FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rate > 0.5 AS kept, round(rate, 6) AS host_rate
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""


OP3_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 10))::BIGINT AS u,
    ('0x' || substr(md5(coalesce(text, '')), 1, 10))::BIGINT AS v, row_number() OVER () AS rid
  FROM documents),
s0 AS (SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
t0 AS (SELECT sum(source_size)::DOUBLE AS total FROM s0),
fill AS (
  SELECT 0 AS step, list(source IS NULL ORDER BY source NULLS LAST) AS x, [false for i in range(count(*))] AS capped FROM s0
  UNION ALL
  SELECT step + 1, x, (SELECT list(c ORDER BY source NULLS LAST) FROM (
      SELECT source, capped[k] OR (total - (sum(CASE WHEN capped[k] THEN 3 * source_size ELSE 0 END) OVER ())) * weight / (sum(CASE WHEN capped[k] THEN 0 ELSE weight END) OVER ()) > 3 * source_size AS c
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s0), t0))
  FROM fill WHERE step < (SELECT count(*) FROM s0)),
cap AS (SELECT capped FROM fill ORDER BY step DESC LIMIT 1),
s1 AS (SELECT s0.*, capped[row_number() OVER (ORDER BY source NULLS LAST)] AS c FROM s0, cap),
s2 AS (SELECT *, CASE WHEN c THEN 3.0::DOUBLE * source_size ELSE ((total - sum(CASE WHEN c THEN 3 * source_size ELSE 0 END) OVER ()) / sum(CASE WHEN c THEN 0 ELSE weight END) OVER ()) * weight END AS target FROM s1, t0),
s3 AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole, ceil(docs / 1024)::BIGINT AS buckets FROM s2),
s4 AS (SELECT *, target - whole * source_size AS quota FROM s3),
r AS (SELECT rid, doc_id, d.source, size, u, v, source_size, target, whole, quota, ((u::HUGEINT * buckets) // 1099511627776)::BIGINT AS b FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
b0 AS (SELECT source, b, quota, sum(size) AS n, count(*) AS docs FROM r GROUP BY ALL),
b1 AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY b) - n AS before FROM b0),
b2 AS (SELECT source, b AS last_b, quota - before AS room, ceil(docs / 4096)::BIGINT AS subs FROM b1 WHERE before <= quota AND before + n > quota),
p AS (SELECT rid, r.source, room, u, v, size, doc_id, ((v::HUGEINT * subs) // 1099511627776)::BIGINT AS s FROM r JOIN b2 ON r.source IS NOT DISTINCT FROM b2.source AND b = last_b),
p0 AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY s) - n AS before FROM (SELECT source, s, room, sum(size) AS n FROM p GROUP BY ALL)),
p1 AS (SELECT source, s AS last_s, room - before AS room FROM p0 WHERE before <= room AND before + n > room),
q AS (SELECT rid, p.source, size, row_number() OVER (PARTITION BY p.source ORDER BY u, size, doc_id NULLS FIRST, v, rid) AS k FROM p JOIN p1 ON p.source IS NOT DISTINCT FROM p1.source AND s = last_s),
walk AS (
  SELECT source, 0::BIGINT AS k, NULL::BIGINT AS rid, room, false AS took FROM p1
  UNION ALL
  SELECT q.source, q.k, q.rid, CASE WHEN size > 0 AND size <= walk.room THEN walk.room - size ELSE walk.room END, size > 0 AND size <= walk.room
  FROM walk JOIN q ON q.source IS NOT DISTINCT FROM walk.source AND q.k = walk.k + 1),
took AS (SELECT rid FROM walk WHERE took UNION ALL SELECT rid FROM p JOIN p1 ON p.source IS NOT DISTINCT FROM p1.source AND s < last_s)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE size * (whole + (CASE WHEN last_b IS NULL THEN quota > 0 ELSE b < last_b OR took.rid IS NOT NULL END)::INT) END::BIGINT AS taken
FROM r LEFT JOIN b2 ON r.source IS NOT DISTINCT FROM b2.source LEFT JOIN took ON r.rid = took.rid
"""


OP9_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
q AS (SELECT *, regexp_matches(text, '(?m)^[ \t]*>') AS quoted FROM m),
l0 AS (SELECT rid, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT *, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM q WHERE quoted)),
l1 AS (SELECT *, CASE WHEN regexp_matches(line, '^[ \t]*>') THEN regexp_extract(line, '^[ \t>]*') ELSE '' END AS mark FROM l0),
l2 AS (SELECT rid, conv_id, turn, i, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS rest FROM l1),
own AS (SELECT rid, string_agg(rest, chr(10) ORDER BY i) FILTER (WHERE level = 0) AS x FROM l2 GROUP BY rid),
r AS (
  SELECT q.*, CASE WHEN quoted THEN regexp_replace(regexp_replace(coalesce(x, ''), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') ELSE text END AS reply
  FROM q LEFT JOIN own USING (rid)),
said AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(x), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS norm
  FROM (SELECT conv_id, turn, unnest(list_concat([reply], list_concat(regexp_split_to_array(reply, '\n[ \t]*\n'), string_split(reply, chr(10))))) AS x FROM r) WHERE turn IS NOT NULL),
s0 AS (SELECT *, trim(rest) = '' AS blank, lag(trim(rest) = '') OVER w AS was_blank, lag(level) OVER w AS was FROM l2 WINDOW w AS (PARTITION BY rid ORDER BY i)),
s1 AS (SELECT *, sum(CASE WHEN NOT blank AND (was IS NULL OR was_blank OR was <> level) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS place FROM s0),
p AS (SELECT rid, conv_id, turn, place, any_value(level) AS level, list(rest ORDER BY i) AS ls FROM s1 WHERE NOT blank GROUP BY rid, conv_id, turn, place),
a0 AS (SELECT conv_id, turn, place, level, unnest(xs) AS x, generate_subscripts(xs, 1) AS part FROM (SELECT *, list_concat([array_to_string(ls, chr(10))], ls) AS xs FROM p WHERE level > 0)),
asked AS (SELECT *, trim(regexp_replace(lower(x), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS norm FROM a0),
found AS (
  SELECT a.conv_id, a.turn, a.place, a.level, a.part, max(s.turn) AS parent
  FROM asked a LEFT JOIN said s ON a.norm = s.norm AND a.conv_id IS NOT DISTINCT FROM s.conv_id AND s.turn < a.turn WHERE a.norm <> '' GROUP BY ALL),
b0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, place ORDER BY parent IS NULL, level, part, parent) AS k FROM found),
b1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY parent IS NULL, level, place, part, parent) AS best, sum((parent IS NULL)::INT) OVER (PARTITION BY conv_id, turn)::BIGINT AS n_unlinked FROM b0 WHERE k = 1),
link AS (SELECT conv_id, turn, parent, n_unlinked FROM b1 WHERE best = 1),
up AS (
  SELECT conv_id, turn, parent AS root, 1::BIGINT AS depth FROM link WHERE parent IS NOT NULL
  UNION ALL
  SELECT up.conv_id, up.turn, link.parent, depth + 1 FROM up JOIN link ON up.conv_id IS NOT DISTINCT FROM link.conv_id AND up.root = link.turn WHERE link.parent IS NOT NULL),
deep0 AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth, list(root ORDER BY depth DESC) AS path FROM up GROUP BY ALL),
deep AS (SELECT *, row_number() OVER (PARTITION BY conv_id, root ORDER BY list_append(path, turn)) AS position FROM deep0)
SELECT r.conv_id, r.turn, role, reply, parent, coalesce(root, r.turn) AS root, coalesce(depth, 0) AS depth, coalesce(n_unlinked, 0) AS n_unlinked, coalesce(position, 0) AS position
FROM r LEFT JOIN link ON r.conv_id IS NOT DISTINCT FROM link.conv_id AND r.turn IS NOT DISTINCT FROM link.turn
LEFT JOIN deep ON r.conv_id IS NOT DISTINCT FROM deep.conv_id AND r.turn IS NOT DISTINCT FROM deep.turn
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_round_trip": OP3_SQL, "op4_source_mixing": OP4_SQL, "op6_url_filter": OP6_SQL, "op8_quality_rules": OP8_SQL, "op9_quotation_linking": OP9_SQL}
