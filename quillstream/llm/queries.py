"""The queries opN_<name> of the training-data operators, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_text, infill, langid, licenses, line_dedup, lm_score, mixing, neardup, quality, secrets, substring_dedup, whitening
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.deduplicate(table(spark, sf_dir, "documents")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.deduplicate_lines(table(spark, sf_dir, "documents"), rare_share=None))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_by_own_labels(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_by_own_words(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_substring_dedup, op3_html_extraction, op4_benchmark_decontamination, op5_minhash_near_dedup, op6_line_dedup, op7_language_id, op8_lm_scoring, op9_secret_scan,
        op10_quality_rules, op11_fill_in_middle, op12_embedding_whitening, op13_license_scan,
    )
}

#: Words of a line or text, for DuckDB.
_W = r"[^\x20\x09-\x0D]+"

_MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, [5, 2, 1][i % 3 + 1]::BIGINT AS w, (SELECT sum(s) FROM s)::BIGINT AS total FROM o),
p AS (SELECT *, coalesce(sum(s) OVER b, 0)::BIGINT AS ps, coalesce(sum(w) OVER b, 0)::BIGINT AS pw, (SELECT sum(w) FROM w)::BIGINT AS all_w
      FROM w WINDOW b AS (ORDER BY s::DOUBLE / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, s = 0 OR w * (total - 3 * ps) > 3 * s * (all_w - pw) AS capped FROM p),
r AS (SELECT (any_value(total) - 3 * coalesce(sum(s) FILTER (capped), 0))::BIGINT AS rest, (sum(w) FILTER (NOT capped))::BIGINT AS share FROM c),
t AS (SELECT c.*, CASE WHEN capped THEN (3 * s)::DOUBLE ELSE (w * rest)::DOUBLE / share END AS target FROM c, r),
g AS (SELECT *, sum(floor(target)::BIGINT) OVER (ORDER BY i) AS high, sum(floor(target)::BIGINT) OVER () AS full_sum FROM t),
b AS (SELECT *, (high - floor(target)::BIGINT)::HUGEINT * 2147483648 // full_sum AS low_point, high::HUGEINT * 2147483648 // full_sum AS high_point FROM g),
slots AS (SELECT (slot % 2147483648 * 1327217885) % 2147483648 AS point FROM range((SELECT (max(total) + 31) // 32 FROM w)) x(slot)),
n AS (SELECT i, count(*) AS asked FROM b JOIN slots ON point >= low_point AND point < high_point GROUP BY i),
k AS (SELECT d.*, b.i, b.s, b.target, least(coalesce(n.asked, 0) * 32, 3 * b.s) AS used,
        sum(size) OVER (PARTITION BY b.i ORDER BY md5('mix:' || doc_id), doc_id) - size AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN n ON n.i = b.i)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  (SELECT sum(greatest(0, least(start + e * s + size, used) - least(start + e * s, used))) FROM range(3) x(e))::BIGINT AS taken
FROM k
"""

_BOILERPLATE = "|".join(quality.BOILERPLATE)
_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM d, unnest(range(1, len(ws) - 1)) u(i)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g), range(3) x(k)
      WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_extract_all(line, '{_W}') AS lw FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT *, len(lw) AS n FROM l WHERE len(lw) > 0),
f AS (SELECT *, len(regexp_extract_all(line, '[#*$%&|<>]')) >= 0.3 * n
    OR len(regexp_extract_all(line, '(^|[\x20\x09])[|»›>·•/]([\x20\x09]|\z)')) >= greatest(2, 0.15 * n)
    OR (n <= 30 AND regexp_matches(lower(line), '{_BOILERPLATE}'))
    OR len(regexp_extract_all(line, '!!')) >= 0.5 * n
    OR (n >= 5 AND len(regexp_extract_all(line, '\p{{Lu}}')) > 0.6 * len(regexp_extract_all(line, '\p{{L}}')))
    OR (n >= 5 AND len(list_filter(range(2, n + 1), lambda i: lw[i] = lw[i - 1])) >= 0.3 * n)
    OR (n < 4 AND NOT regexp_matches(line, '[.!?…。؟:;]["''”’»)\]]*[\x20\x09-\x0D]*\z')) AS fails FROM m),
p AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (fails), 0) AS lost FROM f GROUP BY doc_id),
q AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(p.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.3 * n_words AS kept
FROM q
"""

_AW = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DECONTAM = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_AW}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_FOLD}, '{_AW}') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, len(v) AS n, array_to_string(v, ' ') AS v FROM (
  SELECT item, ws[i:i + least(13, len(ws)) - 1] AS v FROM b, unnest(range(1, greatest(2, len(ws) - 11))) u(i) WHERE len(ws) > 0)),
k AS (SELECT DISTINCT n FROM p),
h AS (SELECT doc_id, i, n, item FROM (
    SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS v FROM d, k, unnest(range(1, len(ws) - n + 2)) u(i)) JOIN p USING (n, v)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, n)) u(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_NEAR_DUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_W}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
      FROM d, unnest(range(1, greatest(2, len(ws)))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
      JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
      WHERE 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
      GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""

_SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS v FROM d, unnest(range(1, len(ws) - 48)) u(i)),
m AS (SELECT v, min(doc_id) AS first_doc FROM v GROUP BY v),
x AS (SELECT DISTINCT doc_id, i + j AS w FROM v JOIN m USING (v), range(50) r(j) WHERE first_doc < doc_id),
k AS (SELECT doc_id, list(w) AS gone FROM x GROUP BY doc_id),
r AS (SELECT d.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS g,
    array_to_string([t[1] FOR t IN list_zip(ws, range(1, len(ws) + 1)) IF NOT list_contains(coalesce(gone, []), t[2])], ' ') AS kept
  FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, g::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM r
"""

_INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT doc_id, t, u, len(u) AS n, [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT for k in range(4)] AS h FROM d),
c AS (SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {
    "op1_mixing": _MIXING, "op2_substring_dedup": _SUBSTRING, "op4_benchmark_decontamination": _DECONTAM, "op5_minhash_near_dedup": _NEAR_DUP, "op10_quality_rules": _QUALITY,
    "op11_fill_in_middle": _INFILL,
}
