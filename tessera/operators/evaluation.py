"""Hold-out metrics, bounds, coverage and reports. truth has user_id, item_id, frac; recs have user_id, item_id, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def metrics(recs: DataFrame, truth: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """One row of six variants: sums over k, over min(k, items played) or over the ideal; of all users or of active ones."""
    truth = truth.join(users, "user_id", "left_semi")
    hit = recs.where(F.col("rank") <= k).join(truth, ["user_id", "item_id"]).groupBy("user_id").agg(F.sum("frac").alias("s"))
    w = Window.partitionBy("user_id").orderBy(F.desc("frac"), "item_id")
    top = truth.withColumn("_r", F.row_number().over(w))
    per = top.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_r") <= k, F.col("frac"))).alias("ideal"))
    per = per.join(hit, "user_id", "left").fillna({"s": 0.0})
    short = F.sum(F.col("s") / F.least("n", F.lit(k)))
    best = F.sum(F.coalesce(F.try_divide("s", "ideal"), F.lit(0.0)))
    agg = per.agg(F.sum("s").alias("s"), short.alias("c"), best.alias("d"), F.count("*").alias("na")).crossJoin(users.agg(F.count("*").alias("nu")))
    c = F.col
    return agg.select((c("s") / c("nu") / k).alias("metric_a"), (c("s") / c("na") / k).alias("metric_b"), (c("c") / c("na")).alias("metric_c"), (c("d") / c("na")).alias("metric_d"), (c("c") / c("nu")).alias("metric_e"), (c("d") / c("nu")).alias("metric_f"))


def oracle_top(truth: DataFrame, k: int) -> DataFrame:
    """The best possible list."""
    w = Window.partitionBy("user_id").orderBy(F.desc("frac"), "item_id")
    return truth.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("user_id", "item_id", "rank", "frac")


def pool_recall(truth: DataFrame, cands: DataFrame) -> DataFrame:
    """Share of the truth's pairs and of its value that the candidates hold."""
    j = truth.join(cands.select("user_id", "item_id", F.lit(1).alias("_in")).distinct(), ["user_id", "item_id"], "left")
    inside = F.coalesce("_in", F.lit(0))
    return j.agg(F.count("*").alias("pairs"), F.avg(inside.cast("double")).alias("pair_recall"), (F.sum(F.col("frac") * inside) / F.sum("frac")).alias("value_recall"))


def anti_new(truth: DataFrame, history: DataFrame) -> DataFrame:
    """Pairs of the truth that the user never played before."""
    return truth.join(history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def semi_history(truth: DataFrame, history: DataFrame) -> DataFrame:
    return truth.join(history.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi")


def strata(per_user: DataFrame, value: str, by: str, edges: list[float]) -> DataFrame:
    """Mean of a value in bins [edge, next) of another; values under the first edge are bin 0."""
    bucket = sum((F.col(by) >= e).cast("int") for e in edges)
    return per_user.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def segments(truth: DataFrame, history: DataFrame) -> DataFrame:
    """Users who come back against new ones: how many, their items and value."""
    seen = history.select("user_id", F.lit(1).alias("_h")).distinct()
    j = truth.join(seen, "user_id", "left").withColumn("comes_back", F.coalesce("_h", F.lit(0)))
    return j.groupBy("comes_back").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("items"), F.sum("frac").alias("value"))


def repeat_ratio(truth: DataFrame, history: DataFrame) -> DataFrame:
    """Users by the quarter of their share of repeats."""
    j = truth.join(history.select("user_id", "item_id", F.lit(1).alias("_h")).distinct(), ["user_id", "item_id"], "left")
    per = j.groupBy("user_id").agg(F.avg(F.coalesce("_h", F.lit(0)).cast("double")).alias("r"), F.sum("frac").alias("v"))
    return per.groupBy(F.least(F.floor(4 * F.col("r")), F.lit(3)).alias("quarter")).agg(F.count("*").alias("users"), F.avg("v").alias("mean_value"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, ties averaged: counts of distinct values are ranked by a running total, so no window spans the rows."""

    def ranks(col: str) -> DataFrame:
        g = df.groupBy(F.col(col).alias(f"_{col}")).agg(F.count("*").alias("n"))
        w = Window.orderBy(f"_{col}").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # distinct values only
        return g.select(f"_{col}", (F.sum("n").over(w) - (F.col("n") - 1) / 2).alias(f"r_{col}"))

    j = df.join(ranks(a), F.col(a) == F.col(f"_{a}")).join(ranks(b), F.col(b) == F.col(f"_{b}"))
    return j.agg(F.corr(f"r_{a}", f"r_{b}").alias("spearman"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson"))


def ks_statistic(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of a value between rows with and without a flag."""
    g = df.groupBy(value).agg(F.count_if(flag).alias("_nx"), F.count_if(~flag).alias("_ny"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # distinct values only
    total = g.agg(F.sum("_nx").alias("nx"), F.sum("_ny").alias("ny"))
    c = g.select(F.sum("_nx").over(w).alias("cx"), F.sum("_ny").over(w).alias("cy")).crossJoin(F.broadcast(total))
    return c.agg(F.max(F.abs(F.col("cx") / F.col("nx") - F.col("cy") / F.col("ny"))).alias("ks"))


def contract(recs: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Counts of broken promises: users short of k, doubled pairs, users that are missing or not asked for, bad ranks, nulls."""
    per = recs.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    j = users.select("user_id", F.lit(1).alias("_u")).join(per, "user_id", "full")
    return j.agg(F.count_if(F.col("n") != k).alias("wrong_size"), F.count_if(F.col("d") != F.col("n")).alias("doubled"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("_u").isNull()).alias("unasked"), F.count_if((F.col("lo") != 1) | (F.col("hi") != F.col("n"))).alias("bad_rank"))


def slots_by_kind(recs: DataFrame, truth: DataFrame) -> DataFrame:
    """Slots, hits and value of history and new items."""
    return recs.join(truth, ["user_id", "item_id"], "left").groupBy("is_hist").agg(F.count("*").alias("slots"), F.count("frac").alias("hits"), F.coalesce(F.sum("frac"), F.lit(0.0)).alias("value"))


def compare_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """Users with equal lists, and the mean overlap of slots."""
    la = a.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("x"))
    lb = b.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("y"))
    return la.join(lb, "user_id").agg(F.count("*").alias("users"), F.count_if(F.col("x") == F.col("y")).alias("equal"), F.avg(F.size(F.array_intersect("x", "y")).cast("double")).alias("overlap"))


def coverage_gap(truth: DataFrame, features: DataFrame) -> DataFrame:
    """Active users without a feature row, and the value they hold."""
    j = truth.join(features.select("user_id", F.lit(1).alias("_f")).distinct(), "user_id", "left")
    return j.groupBy(F.coalesce("_f", F.lit(0)).alias("covered")).agg(F.countDistinct("user_id").alias("users"), F.sum("frac").alias("value"))


def allocation_sweep(scored: DataFrame, truth: DataFrame, k: int, steps: list[int]) -> DataFrame:
    """Value captured by every split of k slots between history and new items: one ranking, joined to the splits."""
    w = Window.partitionBy("user_id", "is_hist").orderBy(F.desc(F.round("s", 9)), "item_id")
    ranked = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    splits = scored.sparkSession.createDataFrame([(h,) for h in steps], "n_hist int")
    j = ranked.join(F.broadcast(splits), ((F.col("is_hist") == 1) & (F.col("_r") <= F.col("n_hist"))) | ((F.col("is_hist") == 0) & (F.col("_r") <= k - F.col("n_hist"))))
    return j.join(truth, ["user_id", "item_id"]).groupBy("n_hist").agg(F.count("*").alias("hits"), F.sum("frac").alias("value"))


def user_weights(truth: DataFrame, k: int, alpha: float) -> DataFrame:
    """Training weights (k / min(k, items))^alpha."""
    return truth.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.pow(k / F.least("n", F.lit(k)), F.lit(alpha)).alias("weight"))
