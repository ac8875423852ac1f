"""Queries whose numbers depend on solvers: checked by rows and by properties, not by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import graph as gr, models as md, ranking as rk, temporal as tm, vectors as vc
from tessera.plans.interaction_queries import _pool, _prep
from tessera.plans.registry import register
from tessera.plans.vector_queries import _all, _near
from tessera.sources import fixtures as fx

FEATURES = ["is_hist", "cand_rank", "plays", "decay_plays", "mean_f", "recency", "pop", "trend", "u_plays"]


def _training(s, d) -> DataFrame:
    """Candidates of the earlier windows with their targets."""
    out = None
    for lo, hi in fx.WINDOWS[:2]:
        p = tm.prep(fx.interactions(s, d), fx.items(s, d), lo)
        c = rk.candidates(p, fx.cohort(s, d), rk.trending_pool(p, 40)).join(tm.target(fx.interactions(s, d), fx.items(s, d), lo, hi), ["user_id", "item_id"], "left").fillna({"frac": 0.0})
        out = c if out is None else out.unionByName(c)
    return out


def _apply(s, d) -> DataFrame:
    return rk.candidates(_prep(s, d), fx.cohort(s, d), _pool(s, d))


def _plays(s, d) -> DataFrame:
    return _prep(s, d).groupBy("user_id", "item_id").agg(F.sum("decay").alias("x"))


def _whitened(s, d) -> DataFrame:
    """Neighbours of all vectors after one fit."""
    out = vc.Whitening(_all(s, d), 32).apply(_all(s, d))
    return vc.neighbours(out, out, 3, digits=4)


register("pca_whiten", "src dst sim:f rank", _whitened)
register("latent_svd", "user_id item_id latent:f", lambda s, d: md.latent(_plays(s, d), 16, fx.cohort(s, d), _pool(s, d)))
register("als_implicit", "user_id item_id rank", lambda s, d: md.implicit_als(_plays(s, d)))
register("kmeans_vlad", "vec_id c i x:f", lambda s, d: _encoded(s, d))
register("gbt_rank", "user_id item_id rank", lambda s, d: md.boosted_ranks(_training(s, d), _apply(s, d), FEATURES, 10, rounds=5))
register("two_stage", "user_id item_id s:f", lambda s, d: md.two_stage(_training(s, d), _apply(s, d), FEATURES, rounds=5))
register("graph_diffusion", "query node x:f", lambda s, d: gr.diffuse(gr.affinity_graph(_near(s, d)), _all(s, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("vec_id").alias("node"), F.lit(1.0).alias("x"))))


def _encoded(s, d) -> DataFrame:
    """Quarters of each vector stand for its local descriptors."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("part"), F.slice("v", k * 16 + 1, F.lit(16)).alias("v")))
    local = _all(s, d).select("vec_id", F.explode(parts).alias("l")).select("vec_id", "l.part", "l.v")
    return vc.residuals(local, md.codebook(local, 4))
