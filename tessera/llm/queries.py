"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontam, html_main, linedup, neardup, order_minhash, packing, pii, quality, toxicity, training_order
from tessera.runtime import table


def op1_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_prefix_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counted=True)
    return docs.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op4_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.order(table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op5_containment_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_nearest_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tree_scoring_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op8_random_index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_odd_sketch_neardup": op1_odd_sketch_neardup,
    "op2_prefix_linedup": op2_prefix_linedup,
    "op3_curve_packing": op3_curve_packing,
    "op4_disclosure_pii": op4_disclosure_pii,
    "op5_containment_decontam": op5_containment_decontam,
    "op6_nearest_toxicity": op6_nearest_toxicity,
    "op7_tree_scoring_html": op7_tree_scoring_html,
    "op8_random_index_quality": op8_random_index_quality,
    "op9_training_order": op9_training_order,
    "op10_order_minhash": op10_order_minhash,
}

OP5_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
item_shingles AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM item_words WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS q FROM item_shingles GROUP BY 1),
widths AS (SELECT DISTINCT least(len(w), 5) AS k FROM item_words WHERE len(w) > 0),
doc_shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM doc_words, widths WHERE len(w) >= k),
hits AS (
  SELECT doc_id, item_id, count(*) AS n FROM doc_shingles JOIN item_shingles USING (s) GROUP BY 1, 2),
pairs AS (SELECT doc_id, item_id FROM hits JOIN sizes USING (item_id) WHERE 10 * n >= 8 * q),
grouped AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM pairs GROUP BY 1)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
FROM documents LEFT JOIN grouped USING (doc_id)
"""

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH RECURSIVE
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM doc_words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
hits AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM hits JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON doc_id = x
"""

OP2_SQL = f"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
words AS (SELECT doc_id, line, t, list_distinct({_WORDS.replace("coalesce(text, '')", "t")}) AS w FROM raw),
ids AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS id, len(w) AS n FROM words),
sets AS (SELECT min(id) AS first, list_sort(w) AS w, any_value(n) AS n FROM ids WHERE n > 0 GROUP BY list_sort(w)),
tokens AS (SELECT first, n, unnest(w) AS k FROM sets),
counts AS (SELECT k, count(*) AS c FROM tokens GROUP BY 1),
ranked AS (SELECT first, n, k, row_number() OVER (PARTITION BY first ORDER BY c, k) AS r FROM tokens JOIN counts USING (k)),
prefix AS (SELECT first, n, k FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.first AS x, b.first AS y FROM prefix a JOIN prefix b ON a.k = b.k AND b.first < a.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
gone AS (
  SELECT DISTINCT x FROM pairs JOIN sets a ON x = a.first JOIN sets b ON y = b.first
  WHERE 180 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n)),
kept AS (SELECT first AS id FROM sets WHERE first NOT IN (SELECT x FROM gone)),
marked AS (SELECT ids.*, n = 0 OR kept.id IS NOT NULL AS stays FROM ids LEFT JOIN kept USING (id))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_prefix_linedup": OP2_SQL,
    "op1_odd_sketch_neardup": OP1_SQL,
    "op5_containment_decontam": OP5_SQL,
}
