"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm import conversations, decontaminate, hard_negatives, html_text, licenses, mixing, nb_svm, near_dup, pseudonyms, quality, toxicity, url_rules, warc
from kindred.llm.workspace import read

#: The rules of the URL query.
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), url_rules.RULE_SCHEMA)
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(read(spark, sf_dir, "documents").select("doc_id", "text"), pseudonyms.session_key(spark))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damaged(read(spark, sf_dir, "conversations"))
    return conversations.audited(conversations.shaped(rows, gone=F.col("gone")))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_svm.scores(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_source_mix": op2_source_mix,
    "op3_minhash_near_dup": op3_minhash_near_dup,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_main_text": op6_main_text,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality_classifier": op13_quality_classifier,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS.split())))

SQL: dict[str, str] = {
    "op11_hard_negatives": """
WITH sound AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS found_id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, found_id) <= 5),
n AS (SELECT p.anchor_id, p.found_id AS positive_id, s.found_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.found_id ORDER BY s.score DESC, s.found_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
    # Checksums bit by bit; then from each conversation's last turn back, for each state of the pattern the least cost and letters (as one string, cost first).
    "op12_conversation_repair": r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind FROM src),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, (SELECT unnest([1, 2]) AS copy) WHERE kind > 0 AND (copy = 1 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role[:64], unhex(sha256(role || chr(0) || text))) AS i, regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid FROM d),
f AS (SELECT *, CASE WHEN solid = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(solid[-1:], '[.!?]') THEN 3 ELSE 0 END AS fault,
    role[:1] AS r, coalesce(lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[:1], 'su') AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- c0 to c3: nothing, system, user, assistant so far; 9-digit cost, then letters.  Insertions lead 0, 1 and 3 to 2, and 2 to 3.
back(conv_id, i, c0, c1, c2, c3) AS (
  SELECT DISTINCT conv_id, n + 1, '000000000', '000000010II', '000000005I', '000000000' FROM f
  UNION ALL
  SELECT conv_id, i, least(a0, b2), least(a1, b2), least(a2, b3), least(a3, b2) FROM (
    SELECT *, lpad((a2[:9]::INT + 5)::VARCHAR, 9, '0') || 'I' || a2[10:] AS b2, lpad((a3[:9]::INT + 5)::VARCHAR, 9, '0') || 'I' || a3[10:] AS b3 FROM (
      SELECT f.conv_id, f.i, least(
          lpad((c0[:9]::INT + 2)::VARCHAR, 9, '0') || 'D' || c0[10:],
          CASE WHEN fault IN (0, 3) THEN lpad((c2[:9]::INT + 1 + m)::VARCHAR, 9, '0') || 'R' || c2[10:] END,
          CASE WHEN fault IN (0, 3) AND r = 's' THEN lpad((c1[:9]::INT + m)::VARCHAR, 9, '0') || 'K' || c1[10:] END,
          CASE WHEN fault IN (0, 3) AND r = 'u' THEN lpad((c2[:9]::INT + m)::VARCHAR, 9, '0') || 'K' || c2[10:] END) AS a0,
        least(
          lpad((c1[:9]::INT + 2)::VARCHAR, 9, '0') || 'D' || c1[10:],
          CASE WHEN fault IN (0, 3) THEN lpad((c2[:9]::INT + 1 + m)::VARCHAR, 9, '0') || 'R' || c2[10:] END,
          CASE WHEN fault IN (0, 3) AND r = 'u' THEN lpad((c2[:9]::INT + m)::VARCHAR, 9, '0') || 'K' || c2[10:] END) AS a1,
        least(
          lpad((c2[:9]::INT + 2)::VARCHAR, 9, '0') || 'D' || c2[10:],
          CASE WHEN fault IN (0, 3) THEN lpad((c3[:9]::INT + 1 + m)::VARCHAR, 9, '0') || 'R' || c3[10:] END,
          CASE WHEN fault IN (0, 3) AND r = 'a' THEN lpad((c3[:9]::INT + m)::VARCHAR, 9, '0') || 'K' || c3[10:] END) AS a2,
        least(
          lpad((c3[:9]::INT + 2)::VARCHAR, 9, '0') || 'D' || c3[10:],
          CASE WHEN fault IN (0, 3) THEN lpad((c2[:9]::INT + 1 + m)::VARCHAR, 9, '0') || 'R' || c2[10:] END,
          CASE WHEN fault IN (0, 3) AND r = 'u' THEN lpad((c2[:9]::INT + m)::VARCHAR, 9, '0') || 'K' || c2[10:] END) AS a3
      FROM back JOIN (SELECT *, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS m FROM f) f ON f.conv_id IS NOT DISTINCT FROM back.conv_id AND f.i = back.i - 1))),
best AS (SELECT conv_id, c0[:9]::BIGINT AS cost, c0[10:] AS audit FROM back WHERE i = 1),
steps AS (SELECT conv_id, k, audit[k] AS letter, length(replace(audit[:k], 'I', '')) AS i, length(replace(audit[:k], 'D', '')) AS place FROM best, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS k)),
lines AS (SELECT s.conv_id, k, letter, coalesce(text, '') AS text, role,
    (place + count_if(letter = 'K' AND place = 1 AND r = 's') OVER (PARTITION BY s.conv_id)) % 2 AS odd
  FROM steps s LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i AND letter <> 'I' WHERE letter <> 'D'),
texts AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS repaired FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op1_warc_round_trip": """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS s FROM pages),
m AS (SELECT s, max(page_id) AS f FROM d WHERE b >= 1000 GROUP BY s)
SELECT page_id, b AS payload_bytes, d.s AS payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to
FROM d LEFT JOIN m ON d.s = m.s AND b >= 1000
""",
    "op7_url_filter": f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT p.*, rh, rp, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC NULLS LAST, length(rp) DESC) AS n
  FROM parts p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM fits WHERE n = 1
""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) AS chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS lines,
  len(regexp_extract_all(t, '!')) AS shouts, len(list_filter(w, lambda x: lower(regexp_replace(x, '[.,;:!?]', '', 'g')) IN ({_STOP_SQL}))) AS stops FROM d),
f AS (SELECT m.*, coalesce(cov.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(cov.n, 0) > 50 * n_words AS base_failed FROM m LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / chars <= 0.05 AND shouts / n_words <= 0.3
  AND stops / n_words >= 0.02 AND n_dup_lines / lines <= 0.5 AS kept FROM f
""",
}
