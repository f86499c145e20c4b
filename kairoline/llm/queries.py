"""The queries of this package's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, infill, langid, mixing, pii, prefix_trie, secrets, simhash, substrings, tokens, toxicity, url_filter
from .common import Scratch, crc_mod, read_table

Query = Callable[[SparkSession, str], DataFrame]

RULES = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"), url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), RULES)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    model = toxicity.fit(docs.where(~F.col("held_out")), read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=("doc_id", "held_out"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(substrings.remove_repeats(read_table(spark, sf_dir, "documents")))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    return prefix_trie.trie(*prefix_trie.branched(read_table(spark, sf_dir, "conversations"), scratch), scratch)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(read_table(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


QUERIES: dict[str, Query] = {"op1_url_filter": op1_url_filter, "op2_pii": op2_pii, "op3_langid": op3_langid, "op4_simhash": op4_simhash, "op5_nearest": op5_nearest, "op6_toxicity": op6_toxicity, "op7_token_counts": op7_token_counts, "op8_source_mix": op8_source_mix, "op9_decontaminate": op9_decontaminate, "op10_suffix_dedup": op10_suffix_dedup, "op11_secrets": op11_secrets, "op12_prefix_trie": op12_prefix_trie, "op13_infill": op13_infill}

_OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule, rhost, rpath, v) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
hits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN hits ON p.host = hits.host AND p.path = hits.path
"""

_OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size, CASE WHEN cap > level * w THEN (max(level) FILTER (WHERE cap > level * w) OVER ()) * w ELSE cap END::DOUBLE AS target
  FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_copies
  FROM t),
c AS (
  SELECT doc_id, size, h, b.*, target - full_copies * source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (full_copies + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

_OP9_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT r, i, n, item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM pos) JOIN win USING (n, g)),
cov AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "binary") AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""

_OP12_SQL = r"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc_of AS (SELECT b, v FROM bits WHERE k = 8),
crcs(conv_id, k, c) AS (
  SELECT conv_id, 0, 4294967295::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, k + 1, xor(c >> 8, v) FROM crcs JOIN crc_of ON b = xor(c & 255, ascii(substr(conv_id::VARCHAR, k + 1, 1))) WHERE k < length(conv_id::VARCHAR)),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, max(pos) AS n FROM t GROUP BY conv_id),
v AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base, xor(c, 4294967295) % 9 AS h, own.n
  FROM crcs c JOIN own USING (conv_id) WHERE k = length(c.conv_id::VARCHAR)),
w AS (SELECT v.*, least(h, coalesce(o.n, 0)) AS lent FROM v LEFT JOIN own o ON o.conv_id = base),
r AS (
  SELECT w.conv_id, pos AS i, role, text FROM w JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL
  SELECT w.conv_id, lent + pos - h, role, text FROM w JOIN t ON t.conv_id = w.conv_id AND pos > h),
paths AS (
  SELECT conv_id, i AS d, text, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY i) AS path FROM r),
rows_ AS (
  SELECT conv_id, d, array_to_string(path, ',') AS label, array_to_string(path[1:d - 1], ',') AS parent, strlen(text) AS n_bytes,
         d = max(d) OVER (PARTITION BY conv_id) AS is_last FROM paths
  UNION ALL
  SELECT conv_id, 0, '', NULL, 0, lent + greatest(n - h, 0) = 0 FROM w),
nodes AS (
  SELECT label, d, min(conv_id) AS conv_id, any_value(parent) AS parent, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_last), '')) AS ends_sha256
  FROM rows_ GROUP BY label, d),
kids AS (SELECT parent AS label, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT r.label, sum((n.n_convs - 1) * n.n_bytes)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN kids ON kids.label = n.label JOIN rows_ r ON r.conv_id = n.conv_id AND r.d <= n.d
  GROUP BY r.label)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.label = n.parent AND p.d = n.d - 1 LEFT JOIN kids ON kids.label = n.label JOIN below ON below.label = n.label
"""

_OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
f AS (
  SELECT *, substr(t, 1, least(x, y)) AS p, substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(t, greatest(x, y) + 1) AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": _OP1_SQL, "op8_source_mix": _OP8_SQL, "op9_decontaminate": _OP9_SQL, "op12_prefix_trie": _OP12_SQL, "op13_infill": _OP13_SQL}
