"""Round trips through the writers and readers: what is read back must be the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tessera.operators import ranking as rk
from tessera.plans.interaction_queries import _recs
from tessera.plans.registry import register
from tessera.runtime import Scratch, table
from tessera.sources import fixtures as fx, io


def _place(s, name: str) -> str:
    return f"{Scratch(s, 'files').base}/{name}"


def _log_csv(s, d) -> str:
    path = _place(s, "log")
    log = table(s, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.col("value").alias("listened_duration"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("listened_datetime"))
    log.write.option("header", True).csv(path)
    return path


register("csv_columns", "user_id listened_duration:f", lambda s, d: io.read_csv(s, _log_csv(s, d), io.INTERACTIONS, ["user_id", "listened_duration"]), "SELECT user_id, listened AS listened_duration FROM log")
register(
    "csv_lazy_filter", "user_id item_id day:s listened:f", lambda s, d: io.read_interactions(s, _log_csv(s, d)).where("d >= '2024-01-21'").withColumn("day", F.col("d").cast("string")),
    "SELECT user_id, item_id, CAST(d AS VARCHAR) AS day, listened FROM log WHERE d >= DATE '2024-01-21'",
)
register("parquet_cache", "item_id listeners", lambda s, d: _cached(s, d), "SELECT item_id, count(DISTINCT user_id) AS listeners FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
register("ranked_csv", "id user_id item_id rank", lambda s, d: _ranked(s, d), "SELECT row_number() OVER (ORDER BY user_id, rank) - 1 AS id, user_id, item_id, rank FROM recs")
register("vectors_csv", "vec_id i x:f", lambda s, d: _vectors(s, d), "SELECT vec_id, generate_subscripts(v, 1) - 1 AS i, round(unnest(v), 4) AS x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)")


def _cached(s, d) -> DataFrame:
    path = _place(s, "cache")
    io.cached(s, path, lambda: rk.popular(fx.interactions(s, d), 50))
    return io.cached(s, path, lambda: 1 / 0)  # read, not built again


def _ranked(s, d) -> DataFrame:
    path = _place(s, "ranked")
    io.write_ranked_csv(_recs(s, d), path)
    return io.read_csv(s, path, T.StructType([T.StructField(c, T.LongType()) for c in ("id", "user_id", "item_id", "rank")]))


def _vectors(s, d) -> DataFrame:
    path = _place(s, "vectors")
    io.write_vectors_csv(fx.vectors(s, d), path, 64, 4)
    return io.read_vectors_csv(s, path, 64).select("vec_id", F.posexplode("v").alias("i", "x"))
