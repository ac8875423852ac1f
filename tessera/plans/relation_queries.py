"""Queries on relations between users and items, and on nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import evaluation as ev, graph as gr, jsonkb as kb, ranking as rk, temporal as tm
from tessera.plans.interaction_queries import _SESSIONS, _pool, _prep
from tessera.plans.registry import register
from tessera.runtime import table
from tessera.sources import fixtures as fx


def _sim(days: int, seeds: int) -> str:
    return f"""r AS (SELECT user_id, item_id, min(age) AS age FROM p WHERE age <= {days} AND listened >= 30 GROUP BY 1, 2),
    rp AS (SELECT user_id, item_id, pow(n + 1, -0.5) AS w FROM r JOIN (SELECT item_id, count(*) AS n FROM r GROUP BY 1) USING (item_id)),
    seeds AS (SELECT user_id, item_id, age, row_number() OVER (PARTITION BY user_id ORDER BY age, item_id) AS seed FROM r SEMI JOIN users USING (user_id) QUALIFY seed <= {seeds}),
    sim AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.w * b.w) AS sim FROM rp a JOIN rp b USING (user_id) WHERE b.item_id IN (SELECT item_id FROM pool) GROUP BY 1, 2),
    cv AS (SELECT user_id, j AS item_id, seed, age, sim FROM seeds JOIN sim ON item_id = i),"""


_COVIS = "SELECT user_id, item_id, sum(sim) AS covis, rank() OVER (PARTITION BY user_id ORDER BY round(sum(sim), 9) DESC) AS covis_rank FROM cv GROUP BY 1, 2"
register("covis", "user_id item_id covis:f covis_rank", lambda s, d: gr.covisitation_ranked(_prep(s, d), fx.cohort(s, d), _pool(s, d), 14, 20), _COVIS, _sim(14, 20))
register("covis_90", "user_id item_id covis:f covis_rank", lambda s, d: gr.covisitation_ranked(_prep(s, d), fx.cohort(s, d), _pool(s, d), 90, 10), _COVIS, _sim(90, 10))
register(
    "covis_multi", "user_id item_id cv_sum:f cv_max:f cv_mean:f cv_top3:f cv_wsum:f cv_last:f cv_max_rank cv_wsum_rank cv_top3_rank", lambda s, d: gr.covisitation_stats(_prep(s, d), fx.cohort(s, d), _pool(s, d), 14, 20),
    """SELECT *, rank() OVER (PARTITION BY user_id ORDER BY round(cv_max, 9) DESC) AS cv_max_rank, rank() OVER (PARTITION BY user_id ORDER BY round(cv_wsum, 9) DESC) AS cv_wsum_rank, rank() OVER (PARTITION BY user_id ORDER BY round(cv_top3, 9) DESC) AS cv_top3_rank FROM (
      SELECT user_id, item_id, sum(sim) AS cv_sum, max(sim) AS cv_max, sum(sim) / any_value(n) AS cv_mean, list_sum(list_sort(list(sim), 'DESC')[1:3]) / least(any_value(n), 3) AS cv_top3,
      sum(sim * pow(0.5, age / 7.0)) AS cv_wsum, coalesce(sum(sim) FILTER (seed = 1), 0) AS cv_last FROM cv JOIN (SELECT user_id, count(*) AS n FROM seeds GROUP BY 1) USING (user_id) GROUP BY 1, 2)""", _sim(14, 20),
)
register(
    "session_covis", "user_id item_id scovis:f", lambda s, d: gr.session_covisitation(tm.sessions(fx.interactions(s, d).where("d < '2024-01-21'"), 21600), fx.cohort(s, d), _pool(s, d)),
    """SELECT user_id, j AS item_id, sum(sim) AS scovis FROM (SELECT user_id, item_id FROM sess SEMI JOIN users USING (user_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, item_id) <= 30)
    JOIN (SELECT a.item_id AS i, b.item_id AS j, sum(a.w * b.w) AS sim FROM sw a JOIN sw b USING (user_id, sid) WHERE b.item_id IN (SELECT item_id FROM pool) GROUP BY 1, 2) ON item_id = i GROUP BY 1, 2""",
    _SESSIONS.replace("WHERE listened >= 30", "WHERE listened >= 30 AND d < DATE '2024-01-21'") + "sr AS (SELECT DISTINCT user_id, sid, item_id FROM sess), sw AS (SELECT sr.*, pow(n + 1, -0.5) AS w FROM sr JOIN (SELECT item_id, count(*) AS n FROM sr GROUP BY 1) USING (item_id)),",
)
register(
    "rp3", "user_id item_id rp3:f rp3b0:f", lambda s, d: gr.three_step_walk(_prep(s, d), fx.cohort(s, d), _pool(s, d), 14),
    """SELECT user_id, item_id, w / pow(di + 1, 0.4) AS rp3, w AS rp3b0 FROM (SELECT a.user_id, c.item_id, any_value(c.di) AS di, sum(1 / a.du / b.di / c.du) AS w FROM e a JOIN e b ON a.item_id = b.item_id JOIN e c ON b.user_id = c.user_id
    WHERE c.item_id IN (SELECT item_id FROM pool) GROUP BY 1, 2)""",
    """r AS (SELECT DISTINCT user_id, item_id FROM p WHERE age <= 14 AND listened >= 30),
    e AS (SELECT *, CAST(count(*) OVER (PARTITION BY user_id) AS DOUBLE) AS du, CAST(count(*) OVER (PARTITION BY item_id) AS DOUBLE) AS di FROM r),""",
)
register(
    "user_cf", "user_id item_id s:f", lambda s, d: gr.user_based(_prep(s, d), fx.cohort(s, d), 10, 14),
    "SELECT u AS user_id, item_id, sum(sim * x) AS s FROM near JOIN r ON v = user_id GROUP BY 1, 2",
    """r AS (SELECT user_id, item_id, sum(pow(0.5, age / 21.0)) AS x FROM p WHERE age <= 14 AND listened >= 30 GROUP BY 1, 2),
    damped AS (SELECT user_id, item_id, x / sqrt(pop) AS w FROM r JOIN (SELECT item_id, sum(x) + 1 AS pop FROM r GROUP BY 1) USING (item_id)),
    unit AS (SELECT user_id, item_id, w / sqrt(sum(w * w) OVER (PARTITION BY user_id)) AS w FROM damped),
    near AS (SELECT a.user_id AS u, b.user_id AS v, sum(a.w * b.w) AS sim FROM unit a JOIN unit b USING (item_id) WHERE a.user_id <> b.user_id GROUP BY 1, 2 QUALIFY rank() OVER (PARTITION BY u ORDER BY round(sum(a.w * b.w), 9) DESC) <= 10),""",
)
register(
    "co_listeners", "user_id item_id n", lambda s, d: gr.co_listeners(_prep(s, d), fx.cohort(s, d), 3),
    "SELECT u AS user_id, item_id, count(*) AS n FROM (SELECT DISTINCT a.user_id AS u, b.user_id AS v FROM r a JOIN r b USING (item_id) WHERE a.user_id <> b.user_id) JOIN r ON v = user_id GROUP BY 1, 2",
    "r AS (SELECT DISTINCT user_id, item_id FROM p WHERE age <= 3),",
)
register(
    "ppmi", "i j ppmi:f", lambda s, d: gr.ppmi(_prep(s, d), 14),
    "SELECT i, j, ln(n * t / (ni * nj)) AS ppmi FROM (SELECT i, j, CAST(n AS DOUBLE) AS n, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS t FROM (SELECT a.item_id AS i, b.item_id AS j, count(*) AS n FROM r a JOIN r b USING (user_id) WHERE a.item_id <> b.item_id GROUP BY 1, 2)) WHERE ln(n * t / (ni * nj)) > 0",
    "r AS (SELECT DISTINCT user_id, item_id FROM p WHERE age <= 14 AND listened >= 30),",
)


def _sparse(s, d) -> DataFrame:
    return fx.orders_log(s, d)


_SPARSE = """olog AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(o_orderdate AS DATE) AS d, l_quantity AS listened FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
old AS (SELECT * FROM olog WHERE d < DATE '2000-08-01'), new AS (SELECT * FROM olog WHERE d >= DATE '2000-08-01'),"""
register(
    "sparse_new_items", "user_id n value:f", lambda s, d: ev.anti_new(_sparse(s, d).where("d >= '2000-08-01'"), _sparse(s, d).where("d < '2000-08-01'")).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("listened").alias("value")),
    "SELECT user_id, count(*) AS n, sum(listened) AS value FROM new ANTI JOIN old USING (user_id, item_id) GROUP BY 1", _SPARSE,
)
register(
    "sparse_popular", "item_id listeners", lambda s, d: rk.popular(_sparse(s, d), 50), "SELECT item_id, count(DISTINCT user_id) AS listeners FROM olog GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", _SPARSE,
)


# nested documents
def _props(s, d) -> DataFrame:
    e = table(s, d, "events")
    return kb.flatten(e.select(F.col("event_id").cast("string").alias("entity"), F.col("props").alias("raw")))


register("flatten_props", "entity:s ord path:s value:s", lambda s, d: _props(s, d).withColumn("path", F.array_join("path", ".")), "SELECT event_id AS entity, 0 AS ord, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events")


register(
    "slugs", "p_partkey slug:s", lambda s, d: table(s, d, "part").select("p_partkey", kb.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug")),
    "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part",
)
