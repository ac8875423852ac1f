"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import graph as gr, vectors as vc
from tessera.plans.registry import register
from tessera.sources import fixtures as fx

#: SQL twins: vectors as lists of doubles; in matching, even ids ask and odd ones answer.
_V = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS v, label FROM v),
near AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v), 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.vec_id) AS rank
  FROM u a, u b WHERE a.vec_id <> b.vec_id QUALIFY rank <= 10),
back AS (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.vec_id) AS rank
  FROM u a, u b WHERE b.vec_id % 2 = 0 AND a.vec_id % 2 <> 0 QUALIFY rank = 1),
ahead AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v), 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.v, b.v), 6) DESC, b.vec_id) AS rank
  FROM u a, u b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 <> 0 QUALIFY rank <= 10),"""


def _all(s, d) -> DataFrame:
    return fx.vectors(s, d)


def _queries(s, d) -> DataFrame:
    return _all(s, d).where("vec_id % 2 = 0")


def _rest(s, d) -> DataFrame:
    return _all(s, d).where("vec_id % 2 <> 0")


def _near(s, d) -> DataFrame:
    return vc.neighbours(_all(s, d), _all(s, d), 10)


def _ahead(s, d) -> DataFrame:
    return vc.neighbours(_queries(s, d), _rest(s, d), 10)


def _mutual(s, d) -> DataFrame:
    return vc.mutual(_ahead(s, d), vc.neighbours(_rest(s, d), _queries(s, d), 1))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("v").alias("i", "x"))


register("l2_norm", "vec_id i x:f", lambda s, d: _flat(vc.normalised(_all(s, d).withColumn("v", F.transform("v", lambda x: x * (1 + F.col("vec_id") % 3))))), "SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM u", _V)
register("cosine_topk", "src dst sim:f rank", _near, "SELECT * FROM near", _V)
register("mutual_nn", "src dst sim:f", _mutual, "SELECT a.src, a.dst, a.sim FROM ahead a JOIN back b ON a.dst = b.src AND b.dst = a.src WHERE a.rank = 1", _V)
register(
    "hit_at_k", "hit_1:f hit_3:f hit_10:f mean_rank:f median_rank:f", lambda s, d: vc.hit_rates(_near(s, d), _all(s, d)),
    """SELECT avg(CAST(coalesce(r, 1000) <= 1 AS INT)) AS hit_1, avg(CAST(coalesce(r, 1000) <= 3 AS INT)) AS hit_3, avg(CAST(coalesce(r, 1000) <= 10 AS INT)) AS hit_10, avg(r) AS mean_rank, quantile_cont(r, 0.5) AS median_rank
    FROM (SELECT src, min(rank) FILTER (a.label = b.label) AS r FROM near JOIN v a ON src = a.vec_id JOIN v b ON dst = b.vec_id GROUP BY 1)""", _V,
)
register(
    "alpha_qe", "vec_id i x:f", lambda s, d: _flat(vc.expand(_all(s, d), _near(s, d).where("rank <= 5"), _all(s, d))),
    "SELECT vec_id, i, x / (sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-12) AS x FROM (SELECT vec_id, i, sum(x) AS x FROM parts GROUP BY 1, 2)",
    _V + """fl AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM u),
    parts AS (SELECT vec_id, i, x FROM fl UNION ALL SELECT src, i, x * pow(greatest(sim, 0), 3) FROM near JOIN fl ON dst = vec_id WHERE rank <= 5),""",
)
register(
    "block_concat", "vec_id i x:f", lambda s, d: _flat(vc.blocks([(_all(s, d).select("vec_id", F.slice("v", 1, 32).alias("v")), 1.0), (_all(s, d).select("vec_id", F.slice("v", 33, 32).alias("v")), 0.5)])),
    "SELECT vec_id, generate_subscripts(c, 1) - 1 AS i, unnest(c) AS x FROM (SELECT vec_id, list_concat(list_transform(v[1:32], lambda x: x / (sqrt(list_dot_product(v[1:32], v[1:32])) + 1e-12)), list_transform(v[33:64], lambda x: 0.5 * x / (sqrt(list_dot_product(v[33:64], v[33:64])) + 1e-12))) AS c FROM v)", _V,
)
register(
    "knn_graph_norm", "src dst w:f", lambda s, d: gr.affinity_graph(_near(s, d)),
    "SELECT src, dst, w / sqrt(sum(w) OVER (PARTITION BY src) * d2) AS w FROM sym JOIN (SELECT src AS dst, sum(w) AS d2 FROM sym GROUP BY 1) USING (dst) WHERE w > 0",
    _V + "ed AS (SELECT src, dst, pow(greatest(sim, 0), 3) AS w FROM near), sym AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM ed UNION ALL SELECT dst, src, w FROM ed) GROUP BY 1, 2),",
)
register(
    "contested", "src lost dst sim:f", lambda s, d: vc.contested(_ahead(s, d), 40),
    """SELECT src, lost, dst, sim FROM ahead JOIN (SELECT src, dst AS lost FROM claims WHERE r > 1) USING (src) WHERE dst NOT IN (SELECT dst FROM claims) AND sim > 0
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) = 1""",
    _V + "sure AS (SELECT * FROM ahead WHERE rank = 1 ORDER BY sim DESC, src LIMIT 40), claims AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY sim DESC, src) AS r FROM sure),",
)
register(
    "retrieval_change", "n moved shared", lambda s, d: vc.changed(_near(s, d), vc.neighbours(vc.bake(_queries(s, d), _mutual(s, d), _all(s, d), 1.0, 0.0), _all(s, d), 10)), None,
)
register("sinkhorn", "src dst", lambda s, d: vc.sinkhorn(_ahead(s, d).select("src", "dst", "sim"), 6), None)
register("orientation", "vec_id view", lambda s, d: vc.orient(_views(s, d), 0.02), "SELECT vec_id, CASE WHEN b - base > 0.02 THEN bv ELSE 0 END AS view FROM (SELECT vec_id, max(round(sim, 9)) AS b, arg_min(view, (-round(sim, 9), view)) AS bv, max(round(sim, 9)) FILTER (view = 0) AS base FROM (SELECT src AS vec_id, rank % 4 AS view, sim FROM near) GROUP BY 1) WHERE base IS NOT NULL", _V)
register(
    "finite_guard", "n bad", lambda s, d: vc.all_finite(_all(s, d).withColumn("v", F.transform("v", lambda x: F.when(x > 0.35, float("nan")).when(x < -0.35, float("-inf")).otherwise(x)))),
    "SELECT count(*) AS n, count(*) FILTER (len(list_filter(w, lambda x: NOT isfinite(x))) > 0) AS bad FROM (SELECT list_transform(v, lambda x: CASE WHEN x > 0.35 THEN 'nan'::DOUBLE WHEN x < -0.35 THEN '-inf'::DOUBLE ELSE x END) AS w FROM v)", _V,
)
register(
    "view_average", "vec_id i x:f", lambda s, d: _flat(vc.averaged(_all(s, d), _all(s, d).withColumn("v", F.reverse("v")))),
    "SELECT vec_id, generate_subscripts(c, 1) - 1 AS i, unnest(list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-12))) AS x FROM (SELECT vec_id, list_transform(list_zip(v, list_reverse(v)), lambda z: z[1] + z[2]) AS c FROM u)", _V,
)


def _views(s, d) -> DataFrame:
    """Ranks modulo four stand for views."""
    return _near(s, d).select(F.col("src").alias("vec_id"), (F.col("rank") % 4).alias("view"), "sim")
