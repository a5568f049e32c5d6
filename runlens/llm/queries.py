"""The queries opN_<name> over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import bpe, exact_dedup, filter_audit, html_text, language, minmax_hash, packing, pitman_yor, quality_rules, range_coder, simhash, token_counts, whitening
from runlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.rule_ledger(table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(ledger).drop("policy")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.round_trip(table(spark, sf_dir, "documents"), with_ids=False)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("n_chars")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_minmax_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_hash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM p
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g
), h AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS x(k) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(h.n, 0)::BIGINT AS n_repeat_words,
         coalesce(list_max(list_transform(w, lambda x: length(x))), 0)::BIGINT AS max_word_chars
  FROM d LEFT JOIN h ON h.doc_id = d.doc_id
), b AS (
  SELECT *, ((CASE WHEN n_words < 10 THEN 1 ELSE 0 END)
    | (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    | (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    | (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    | (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
    | (CASE WHEN max_word_chars > 1000 THEN 32 ELSE 0 END))::BIGINT AS fail_bits
  FROM m
)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), g AS (
  SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY c DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY n) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM g
"""

OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r(doc_id, met) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.met
), c AS (
  SELECT doc_id, min(met) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), e AS (
  SELECT t, min(doc_id) AS least FROM d GROUP BY t
), y AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 200)::INT AS a,
         (100 * len(list_distinct(w)) < 50 * len(w))::INT AS b,
         (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT AS c,
         regexp_matches(t, '[#$%&*|]')::INT AS x,
         coalesce(d.doc_id > least, least IS NOT NULL)::INT AS e
  FROM d JOIN e USING (t) LEFT JOIN y ON y.doc_id = d.doc_id
), n AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': x, 'E': e} AS f, a + b + c + x + e AS fails,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM m GROUP BY ALL
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS v
), o AS (
  SELECT p.v || q.v || r.v || s.v || z.v AS filter_order
  FROM l p JOIN l q ON q.v <> p.v JOIN l r ON r.v NOT IN (p.v, q.v) JOIN l s ON s.v NOT IN (p.v, q.v, r.v)
  JOIN l z ON z.v NOT IN (p.v, q.v, r.v, s.v)
), k AS (
  SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o
), h AS (
  SELECT part, filter_order, step, n, good, toxic, fails, substr(filter_order, step, 1) AS v, f[substr(filter_order, step, 1)] AS own,
         list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda z: coalesce(f[z], 0))) AS before
  FROM k, n
), r AS (
  SELECT part, filter_order, step, v,
         sum(CASE WHEN coalesce(before, 0) = 0 AND own = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN coalesce(before, 0) = 0 AND own = 1 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN before > 0 AND own = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN own = 1 AND fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN coalesce(before, 0) = 0 AND own = 1 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN coalesce(before, 0) = 0 AND own = 1 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h GROUP BY part, filter_order, step, v
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, v)::BIGINT AS shapley
FROM r
"""

QUERIES: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_lm_scores": op2_lm_scores,
    "op3_quality_rules": op3_quality_rules,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_bpe": op6_bpe,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_whitening": op11_whitening,
    "op12_minmax_hash": op12_minmax_hash,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": OP3_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_minmax_hash": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
