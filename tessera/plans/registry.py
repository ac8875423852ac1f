"""Registered queries with their SQL twins.

An entry is a name, the columns of its result (a trailing ``:f`` marks doubles, rounded to eight digits, halves up, on both sides,
``:s`` strings, ``:b`` booleans, none longs), the Spark query and the SQL body over the shared definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Definitions that the SQL twins share.
DEFINITIONS = """
WITH RECURSIVE
log AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts, CAST(ts AS DATE) AS d, value AS listened FROM events),
items AS (SELECT p_partkey AS item_id, CAST(p_size * 10 AS DOUBLE) AS duration, p_brand AS artist, p_type AS genre, p_name AS track FROM part),
users AS (SELECT DISTINCT user_id FROM events),
p AS (SELECT log.*, duration, artist, genre, track, date_diff('day', d, DATE '2024-01-21') AS age, least(greatest(listened / duration, 0.0), 1.0) AS f,
      pow(0.5, date_diff('day', d, DATE '2024-01-21') / 5.0) AS decay, date_diff('day', d, DATE '2024-01-21') // 7 AS week
      FROM log JOIN items USING (item_id) WHERE d < DATE '2024-01-21' AND duration > 0),
mine AS (SELECT p.* FROM p SEMI JOIN users USING (user_id)),
truth AS (SELECT user_id, item_id, least(floor(4 * greatest(sum(listened / duration), 0.0) + 0.5) / 4, 1.0) AS frac
      FROM log JOIN items USING (item_id) WHERE d >= DATE '2024-01-21' AND d < DATE '2024-01-31' AND duration > 0 GROUP BY 1, 2),
pool AS (SELECT item_id, s, row_number() OVER (ORDER BY round(s, 9) DESC, item_id) - 1 AS cand_rank
      FROM (SELECT item_id, sum(f) AS s FROM p WHERE age <= 7 GROUP BY 1) QUALIFY cand_rank < 40),
pairs AS (SELECT user_id, item_id, count(*) AS plays, sum(f) AS full_plays, sum(decay) AS decay_plays, sum(f * decay) AS decay_full, avg(f) AS mean_f, max(f) AS max_f, min(f) AS min_f,
      min(age) AS recency, max(age) AS first_age, count(DISTINCT d) AS n_days, count(DISTINCT week) AS n_weeks, count(*) FILTER (age <= 7) AS plays_7, count(*) FILTER (age <= 14) AS plays_14,
      sum(listened) AS secs, max(age) - min(age) AS span FROM p GROUP BY 1, 2),
stats AS (SELECT item_id, count(DISTINCT user_id) AS pop, avg(f) AS mean_f, count(*) FILTER (age <= 14) AS recent, count(*) AS plays,
      count(*) FILTER (age <= 14) / (count(*) + 1) AS trend, count(*) / (count(DISTINCT user_id) + 1) AS stickiness FROM p GROUP BY 1),
ufeat AS (SELECT user_id, count(*) AS u_plays, count(DISTINCT item_id) AS u_items, count(*) FILTER (age <= 7) AS u_plays_7, min(age) AS u_recency, avg(f) AS u_mean_f,
      1 - count(DISTINCT item_id) / count(*) AS u_repeat_rate FROM p GROUP BY 1),
cands AS (SELECT c.*, coalesce(pairs.plays, 0) AS plays, coalesce(decay_plays, 0) AS decay_plays, coalesce(pairs.mean_f, 0) AS mean_f, coalesce(recency, 0) AS recency,
      coalesce(pop, 0) AS pop, coalesce(trend, 0) AS trend, u_plays
      FROM (SELECT user_id, item_id, max(h) AS is_hist, CASE WHEN max(h) = 1 THEN 99999 ELSE max(cr) END AS cand_rank
            FROM (SELECT DISTINCT user_id, item_id, 1 AS h, NULL AS cr FROM mine UNION ALL SELECT user_id, item_id, 0, cand_rank FROM users, pool) GROUP BY 1, 2) c
      LEFT JOIN pairs USING (user_id, item_id) LEFT JOIN stats USING (item_id) LEFT JOIN ufeat USING (user_id)),
recs AS (SELECT user_id, item_id, is_hist, row_number() OVER (PARTITION BY user_id ORDER BY is_hist DESC, round(decay_plays, 9) DESC, cand_rank, item_id) AS rank FROM cands QUALIFY rank <= 10),
"""


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "i") for c in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    kinds = {"i": lambda c: F.col(c).cast("long"), "f": lambda c: F.floor(F.col(c).cast("double") * 1e8 + 0.5) / 1e8, "s": lambda c: F.col(c).cast("string"), "b": lambda c: F.col(c).cast("boolean")}
    return df.select(*[kinds[k](c).alias(c) for c, k in _columns(spec)])


def _shaped_sql(body: str, spec: str, extra: str) -> str:
    kinds = {"i": "CAST({c} AS BIGINT)", "f": "floor(CAST({c} AS DOUBLE) * 1e8 + 0.5) / 1e8", "s": "CAST({c} AS VARCHAR)", "b": "CAST({c} AS BOOLEAN)"}
    cols = ", ".join(f"{kinds[k].format(c=c)} AS {c}" for c, k in _columns(spec))
    return f"{DEFINITIONS.strip()}\n{extra}result AS ({body.strip()})\nSELECT {cols} FROM result"


def register(name: str, spec: str, query: Callable, sql: str | None = None, extra: str = "") -> None:
    """extra: further definitions for the SQL, each with a trailing comma."""
    _QUERIES[name] = lambda spark, sf_dir: shaped(query(spark, sf_dir), spec)
    if sql:
        _SQL[name] = _shaped_sql(sql, spec, extra)


def _load() -> None:
    if not _QUERIES:
        from tessera.plans import interaction_queries, lookup_queries, model_queries, relation_queries, retrieval_queries, source_queries, vector_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
