"""Queries over the driver's tables, one for each operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chain_dedup, decontaminate, license_scan, line_dedup, pii, repetition, simhash, token_parquet, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), digests=True)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(table(spark, sf_dir, "documents")).drop("longest_repeat", "n_repeats")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_chain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain_dedup.repeated(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans", "n_added")


def op10_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_parquet.encode_to_files(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_license_scan, op3_decontaminate, op4_simhash, op5_repetition, op6_url_rules, op7_chain_dedup, op8_line_dedup, op9_pii, op10_token_parquet)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _license_sql() -> str:
    """Phrases by joining consecutive words; templates by comparing each with all lines, and all windows of its length."""
    templates = ", ".join(f"('{name}', '{text}')" for name, text in license_scan.TEMPLATES.items())
    places = []
    for phrase, label in license_scan.PHRASES.items():
        first, *rest = phrase.split()
        joins = " ".join(f"JOIN tok t{k} ON t{k}.rid = t0.rid AND t{k}.pos = t0.pos + {k} AND t{k}.word = '{w}'" for k, w in enumerate(rest, 1))
        places.append(f"SELECT t0.rid, t0.pos, '{label}' AS label FROM tok t0 {joins} WHERE t0.word = '{first}'")
    return f"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM documents
), tok AS MATERIALIZED (
  SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM words
), places AS MATERIALIZED (
  {" UNION ALL ".join(places)}
), base AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY rid
), templates AS (
  SELECT name, regexp_extract_all(text, {_ALNUM}) AS ws FROM (VALUES {templates}) v(name, text)
), sized AS MATERIALIZED (
  SELECT name, list_distinct(ws) AS t, len(ws) AS size, greatest(CAST(ceil(CAST({license_scan.CONTAINMENT} AS DOUBLE) * len(list_distinct(ws)) - 1e-9) AS BIGINT), 1) AS need FROM templates
), lines AS (
  SELECT rid, list_distinct(regexp_extract_all({_LOW}, {_ALNUM})) AS ws FROM (SELECT rid, unnest(string_split(text, chr(10))) AS text FROM words)
), by_line AS (
  SELECT rid, name, len(list_intersect(ws, t)) AS common, len(t) AS n FROM lines, sized WHERE len(list_intersect(ws, t)) >= need
), met AS MATERIALIZED (
  SELECT rid, name, pos, word, size, need, len(t) AS n
  FROM (SELECT rid, name, t, size, need FROM words, sized WHERE contains(text, chr(10)) AND len(list_intersect(list_distinct(w), t)) >= need) JOIN tok USING (rid)
  WHERE list_contains(t, word)
), by_window AS (
  SELECT a.rid, a.name, count(DISTINCT b.word) AS common, any_value(a.n) AS n
  FROM met a JOIN met b ON a.rid = b.rid AND a.name = b.name AND b.pos BETWEEN a.pos AND a.pos + a.size - 1
  GROUP BY a.rid, a.name, a.pos HAVING count(DISTINCT b.word) >= any_value(a.need)
), shares AS MATERIALIZED (
  SELECT rid, name, max(CAST(common AS DOUBLE) / n) AS share FROM (SELECT * FROM by_line UNION ALL SELECT * FROM by_window) GROUP BY rid, name
), said AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM places UNION SELECT rid, name FROM shares) GROUP BY rid
), base_said AS (
  SELECT rid, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT rid, label FROM places) GROUP BY rid
), best AS (
  SELECT rid, max(share) AS share FROM shares GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(share, CAST(0 AS DOUBLE)) END AS score
FROM words LEFT JOIN base USING (rid) LEFT JOIN said USING (rid) LEFT JOIN base_said USING (rid) LEFT JOIN best USING (rid)
"""


def _repetition_sql() -> str:
    """A word is in a repeat of k words or more if it is in a window of k words that the text has twice."""
    k, most = repetition.REPEAT_WORDS, repetition.MAX_LONGEST + 1
    windows = " UNION ALL ".join(f"SELECT rid, {n} AS k, unnest(range(1, len(w) - {n} + 2)) AS i, w FROM words WHERE len(w) >= {n}" for n in (repetition.BASE_WINDOW, k, most))
    return f"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, k, i, md5(array_to_string(w[i : i + k - 1], ' ')) AS g FROM ({windows})
), again AS MATERIALIZED (
  SELECT rid, k, unnest(places) AS i FROM (SELECT rid, k, g, list(i) AS places FROM windows GROUP BY rid, k, g HAVING count(*) > 1)
), covered AS (
  SELECT rid, count(DISTINCT CASE WHEN k = {repetition.BASE_WINDOW} THEN p END) AS n_repeat_words, count(DISTINCT CASE WHEN k = {k} THEN p END) AS covered_words, bool_or(k = {most}) AS long
  FROM (SELECT rid, k, unnest(range(i, i + k)) AS p FROM again) GROUP BY rid
), lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), all_ AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(covered_words, 0) AS BIGINT) AS covered_words, coalesce(long, false) AS long
  FROM words LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)
)
SELECT * EXCLUDE (long), n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= CAST({repetition.MAX_COVERED} AS DOUBLE) * n_words AND NOT long AS kept
FROM all_
"""


#: The other queries need a tokenizer, XXH64, alignments or a trained model.
ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op5_repetition": _repetition_sql(),
    "op3_decontaminate": r"""
WITH words AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT k FROM item_windows
), doc_windows AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)
), found AS MATERIALIZED (
  SELECT rid, d.k, i, item_id FROM doc_windows d JOIN item_windows USING (k, g)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
""",
}
