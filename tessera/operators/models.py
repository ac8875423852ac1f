"""Learners and factorisations on MLlib; their numbers depend on solvers, so they have no SQL twins."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor
from pyspark.mllib.linalg import Vectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from tessera.operators.ranking import top_k


def _assembled(df: DataFrame, features: list[str], fitted=None):
    df = df.select("*", *[F.col(f).cast("double").alias(f"_{f}") for f in features])
    imputer = fitted or Imputer(inputCols=[f"_{f}" for f in features], outputCols=[f"_i{f}" for f in features]).fit(df)
    return VectorAssembler(inputCols=[f"_i{f}" for f in features], outputCol="_x", handleInvalid="keep").transform(imputer.transform(df)), imputer


def boosted_ranks(train: DataFrame, apply: DataFrame, features: list[str], k: int, rounds: int = 10, seeds: int = 1) -> DataFrame:
    """Mean of seeded boosted regressors of frac, and each user's k best."""
    x, imputer = _assembled(train, features)
    y, _ = _assembled(apply, features, imputer)
    for s in range(seeds):
        y = GBTRegressor(featuresCol="_x", labelCol="frac", predictionCol=f"_p{s}", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=s, subsamplingRate=0.8).fit(x).transform(y)
    return top_k(y.withColumn("s", sum(F.col(f"_p{s}") for s in range(seeds)) / seeds), k).select("user_id", "item_id", "rank", "s")


def two_stage(train: DataFrame, apply: DataFrame, features: list[str], rounds: int = 10) -> DataFrame:
    """P(listened) times E(frac | listened)."""
    x, imputer = _assembled(train.withColumn("_y", (F.col("frac") > 0).cast("double")), features)
    y, _ = _assembled(apply, features, imputer)
    p = GBTClassifier(featuresCol="_x", labelCol="_y", predictionCol="_c", maxIter=rounds, maxDepth=4, seed=1).fit(x)
    e = GBTRegressor(featuresCol="_x", labelCol="frac", predictionCol="_e", maxIter=rounds, maxDepth=4, seed=1).fit(x.where("_y = 1"))
    return e.transform(p.transform(y)).select("user_id", "item_id", (vector_to_array("probability")[1] * F.col("_e")).alias("s"))


def implicit_als(plays: DataFrame, rank: int = 16, alpha: float = 40.0, k: int = 10) -> DataFrame:
    """Weighted implicit factorisation of (user_id, item_id, x), and each user's k best items."""
    model = ALS(userCol="user_id", itemCol="item_id", ratingCol="x", implicitPrefs=True, rank=rank, alpha=alpha, maxIter=5, seed=1, coldStartStrategy="drop").fit(plays)
    return model.recommendForAllUsers(k).select("user_id", F.posexplode("recommendations").alias("rank", "r")).select("user_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("r.item_id").cast("long").alias("item_id"), F.col("r.rating").alias("s"))


def latent(plays: DataFrame, size: int, users: DataFrame, pool: DataFrame) -> DataFrame:
    """Truncated SVD of log1p of (user_id, item_id, x) over all items of the log; cosine of users and pool items.

    Users stand at the centroid of the unit factors of all their plays; the pool is taken only for scoring. The rows stay
    distributed; the driver holds the items' factors (items x size), and no square matrix of a large catalogue.
    """
    spark = plays.sparkSession
    r = plays.groupBy("user_id", "item_id").agg(F.log1p(F.sum("x")).alias("w")).where("w > 0").persist(StorageLevel.DISK_ONLY)
    ids = sorted(x.item_id for x in r.select("item_id").distinct().collect())
    if not ids:
        return r.select("user_id", "item_id", F.col("w").alias("latent"))
    n = len(ids)
    at = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "item_id long, at int")
    by_user = r.join(at, "item_id").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("e"))
    rows = by_user.rdd.map(lambda x: Vectors.sparse(n, [y.at for y in x.e], [y.w for y in x.e])).persist(StorageLevel.DISK_ONLY)
    basis = RowMatrix(rows, numCols=n).computeSVD(min(size, n)).V.toArray()
    basis = basis / (np.linalg.norm(basis, axis=1, keepdims=True) + 1e-9)
    factors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, basis, strict=True)], "item_id long, b array<double>")
    u = r.join(users, "user_id", "left_semi").join(factors, "item_id").select("user_id", F.posexplode("b").alias("k", "y"), "w").groupBy("user_id", "k").agg(F.sum(F.col("y") * F.col("w")).alias("y"))
    norm = u.groupBy("user_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    flat = factors.join(F.broadcast(pool.select("item_id").distinct()), "item_id", "left_semi").select("item_id", F.posexplode("b").alias("k", "z"))
    return u.join(norm, "user_id").join(F.broadcast(flat), "k").groupBy("user_id", "item_id").agg(F.sum(F.col("y") * F.col("z") / (F.col("norm") + 1e-9)).alias("latent"))


def codebook(vectors: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """Centroids (c, v) of k-means."""
    model = KMeans(k=k, seed=seed, maxIter=10, featuresCol="_x").fit(vectors.select(array_to_vector("v").alias("_x")))
    return vectors.sparkSession.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(model.clusterCenters())], "c int, v array<double>")
