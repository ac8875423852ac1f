"""Candidate pools, candidate tables, rankers and fusion. Every order ends in item_id, so ties are stable."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import temporal


def _order(score: str | Column) -> list[Column]:
    # sums of doubles differ in their last digits with the order of rows: scores are rounded before they are compared
    return [F.desc_nulls_last(F.round(score, 9)), F.asc("item_id")]


def top_k(scored: DataFrame, k: int, score: str | Column = "s", per: str = "user_id") -> DataFrame:
    """The k best items of each user, with rank 1..k."""
    w = Window.partitionBy(per).orderBy(*_order(score))
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def trending_pool(p: DataFrame, n: int, days: int = 7) -> DataFrame:
    """The n items with the most full plays in the last days, with cand_rank from 0."""
    best = p.where(F.col("age") <= days).groupBy("item_id").agg(F.sum("f").alias("s")).orderBy(*_order("s")).limit(n)
    return best.withColumn("cand_rank", (F.row_number().over(Window.orderBy(*_order("s"))) - 1).cast("long"))  # n rows


def trend_list(p: DataFrame, n: int, mode: str, days: int = 7, least: int = 5) -> DataFrame:
    """Trending items by users, plays, completion or mean_completion (of items with enough users, times log1p of them)."""
    g = p.where(F.col("age") <= days).groupBy("item_id").agg(F.countDistinct("user_id").alias("u"), F.count("*").alias("n"), F.sum("f").alias("c"), F.avg("f").alias("m"))
    key = {"users": F.col("u").cast("double"), "plays": F.col("n").cast("double"), "completion": F.col("c"), "mean_completion": F.when(F.col("u") >= least, F.col("m") * F.log1p("u"))}[mode]
    return g.select("item_id", key.alias("s")).where("s is not null").orderBy(*_order("s")).limit(n)


def candidates(p: DataFrame, users: DataFrame, pool: DataFrame) -> DataFrame:
    """Each user's history and the pool, history first, with features and their fills.

    An item in both keeps is_hist = 1 and the cand_rank 99999; pool items have zero history features.
    """
    hist = p.join(users, "user_id", "left_semi").select("user_id", "item_id", F.lit(1).alias("is_hist"), F.lit(None).cast("long").alias("cand_rank")).distinct()
    cold = users.crossJoin(F.broadcast(pool.select("item_id", "cand_rank"))).select("user_id", "item_id", F.lit(0).alias("is_hist"), "cand_rank")
    both = hist.unionByName(cold)
    first = both.groupBy("user_id", "item_id").agg(F.max("is_hist").alias("is_hist"), F.max("cand_rank").alias("cr"))
    first = first.select("user_id", "item_id", "is_hist", F.when(F.col("is_hist") == 1, F.lit(99999)).otherwise(F.col("cr")).cast("long").alias("cand_rank"))
    pairs = temporal.pair_features(p.join(users, "user_id", "left_semi")).select("user_id", "item_id", "plays", "decay_plays", "mean_f", "recency")
    out = first.join(pairs, ["user_id", "item_id"], "left").join(temporal.item_stats(p).select("item_id", "pop", "trend"), "item_id", "left").join(temporal.user_features(p).select("user_id", "u_plays"), "user_id", "left")
    return out.fillna({"plays": 0, "decay_plays": 0.0, "mean_f": 0.0, "recency": 0, "pop": 0, "trend": 0.0})


def popular(log: DataFrame, n: int) -> DataFrame:
    """Items by distinct listeners."""
    return log.groupBy("item_id").agg(F.countDistinct("user_id").alias("listeners")).orderBy(F.desc("listeners"), "item_id").limit(n)


def user_history(log: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """Each user's items by plays, then seconds."""
    g = log.join(users, "user_id", "left_semi").groupBy("user_id", "item_id").agg(F.count("*").alias("plays"), F.sum("listened").alias("secs"))
    w = Window.partitionBy("user_id").orderBy(F.desc("plays"), F.desc(F.round("secs", 6)), "item_id")
    return g.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def decayed_history(p: DataFrame, users: DataFrame, k: int) -> DataFrame:
    g = p.join(users, "user_id", "left_semi").groupBy("user_id", "item_id").agg(F.sum("decay").alias("s"))
    return top_k(g, k)


def waterfall(sources: list[DataFrame], users: DataFrame, k: int) -> DataFrame:
    """Fill k slots from ordered sources of (user_id, item_id, rank): an item counts in its first source, sources come one after another.

    Sources without user_id are offered to every user.
    """
    parts = [(s if "user_id" in s.columns else users.crossJoin(F.broadcast(s))).select("user_id", "item_id", F.lit(i).alias("src"), "rank") for i, s in enumerate(sources)]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    first = every.groupBy("user_id", "item_id").agg(F.min(F.struct("src", "rank")).alias("at"))
    w = Window.partitionBy("user_id").orderBy("at.src", "at.rank", "item_id")
    return first.withColumn("slot", F.row_number().over(w).cast("long")).where(F.col("slot") <= k).select("user_id", "item_id", F.col("slot").alias("rank"))


def history_then_popular(log: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """History, then popular items; users without history get nothing."""
    hist = user_history(log, users, k).select("user_id", "item_id", "rank")
    pop = popular(log, 2 * k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("listeners"), "item_id")).cast("long"))  # 2k rows
    return waterfall([hist, pop.select("item_id", "rank")], hist.select("user_id").distinct(), k)


def blend(p: DataFrame, users: DataFrame, k: int, n_hist: int, days: int = 7) -> DataFrame:
    """Decayed history up to n_hist, then unseen trending items; users without history are padded too."""
    hist = decayed_history(p, users, n_hist).select("user_id", "item_id", "rank")
    trend = trending_pool(p, 2 * k + n_hist, days).select("item_id", (F.col("cand_rank") + 1).alias("rank"))
    return waterfall([hist, trend], users, k)


def history_scores(p: DataFrame, users: DataFrame) -> DataFrame:
    """All scoring modes of a pair at once: decay_plays, full_plays, decay_full, recency, decay_x_meanf, decay_plays_recency."""
    g = p.join(users, "user_id", "left_semi").groupBy("user_id", "item_id").agg(F.sum("decay").alias("decay_plays"), F.sum("f").alias("full_plays"), F.sum(F.col("f") * F.col("decay")).alias("decay_full"), F.avg("f").alias("m"), F.min("age").alias("r"))
    return g.select("user_id", "item_id", "decay_plays", "full_plays", "decay_full", (-F.col("r")).alias("recency"), (F.col("decay_plays") * F.col("m")).alias("decay_x_meanf"), (F.col("decay_plays") / (1 + F.col("r") / 30)).alias("decay_plays_recency"))


def artist_discovery(p: DataFrame, users: DataFrame, n_artists: int, n_items: int) -> DataFrame:
    """Unseen items of each user's best artists: affinity times log1p of the item's plays."""
    mine = p.join(users, "user_id", "left_semi")
    aff = mine.groupBy("user_id", "artist").agg(F.sum("decay").alias("a"))
    w = Window.partitionBy("user_id").orderBy(F.desc(F.round("a", 9)), "artist")
    aff = aff.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_artists).drop("_r")
    best = p.groupBy("artist", "item_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("artist").orderBy(F.desc("n"), "item_id")
    best = best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_items).drop("_r")
    return aff.join(best, "artist").select("user_id", "item_id", (F.col("a") * F.log1p("n")).alias("s")).join(mine.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def personal_tail(p: DataFrame, users: DataFrame, pool: DataFrame, per_user: int, offset: int = 1000) -> DataFrame:
    """The pool for everyone, and up to per_user artist discoveries beyond it with cand_rank from the offset."""
    tail = artist_discovery(p, users, 10, 10).join(pool.select("item_id"), "item_id", "left_anti")
    tail = top_k(tail, per_user).select("user_id", "item_id", (F.col("rank") - 1 + offset).alias("cand_rank"))
    return users.crossJoin(F.broadcast(pool.select("item_id", "cand_rank"))).select("user_id", "item_id", "cand_rank").union(tail)


def power_user_pool(p: DataFrame, least: int, n: int) -> DataFrame:
    """The trending pool of users with enough plays."""
    heavy = p.groupBy("user_id").count().where(F.col("count") >= least)
    return trending_pool(p.join(heavy, "user_id", "left_semi"), n)


def model_free(cands: DataFrame, k: int) -> DataFrame:
    """History by decayed plays, then the pool by rank: the flagship ranker."""
    w = Window.partitionBy("user_id").orderBy(F.desc("is_hist"), F.desc(F.round("decay_plays", 9)), "cand_rank", "item_id")
    return cands.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("user_id", "item_id", "is_hist", "rank")


def average_rank(score: str, per: list[str]) -> Column:
    """Ascending rank, ties averaged."""
    w = Window.partitionBy(*per).orderBy(F.round(score, 9))
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*per, F.round(score, 9))) - 1) / 2


def rank_average(scores: DataFrame, cols: list[str]) -> DataFrame:
    """Mean of the per-user average ranks of several scores."""
    ranked = scores.select("user_id", "item_id", *[average_rank(c, ["user_id"]).alias(f"_r{i}") for i, c in enumerate(cols)])
    return ranked.select("user_id", "item_id", (sum(F.col(f"_r{i}") for i in range(len(cols))) / len(cols)).alias("s"))


def reciprocal_rank_fusion(scores: DataFrame, cols: list[str], c: int = 60) -> DataFrame:
    """Sum of 1 / (c + rank) over scores, best rank 1."""
    ranked = scores.select("user_id", "item_id", *[F.rank().over(Window.partitionBy("user_id").orderBy(F.desc(F.round(x, 9)))).alias(f"_r{i}") for i, x in enumerate(cols)])
    return ranked.select("user_id", "item_id", sum(1 / (c + F.col(f"_r{i}")) for i in range(len(cols))).alias("s"))


def zscore_blend(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of standardised scores; one row of means and deviations is joined."""
    stats = scores.agg(*[f(c).alias(f"_{n}_{c}") for c in weights for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = sum(w * (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9) for c, w in weights.items())
    return scores.crossJoin(F.broadcast(stats)).select("user_id", "item_id", z.alias("s"))


def biased(scored: DataFrame, bonus: float) -> DataFrame:
    """A bonus for what isn't history."""
    return scored.withColumn("s", F.col("s") + bonus * (F.col("is_hist") == 0).cast("int"))


def split_slots(scored: DataFrame, k: int, n_hist: int) -> DataFrame:
    """n_hist history slots and the rest new, each by its own order; slots that one side can't fill go to the other."""
    side = Window.partitionBy("user_id", "is_hist").orderBy(*_order("s"))
    r = scored.withColumn("_r", F.row_number().over(side))
    quota = F.when(F.col("is_hist") == 1, F.lit(n_hist)).otherwise(F.lit(k - n_hist))
    w = Window.partitionBy("user_id").orderBy((F.col("_r") > quota).cast("int"), *_order("s"))
    return r.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("_r")


def _lot(keys: list[str], seed: int) -> Column:
    """A repeatable draw for a row, the same in every engine."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the hash of a key: repeatable."""
    return df.orderBy(_lot([key], seed), key).limit(n)


def downsample_negatives(df: DataFrame, positive: Column, permille: int, keys: list[str], seed: int = 0) -> DataFrame:
    """All positives, and so many in a thousand of the others."""
    return df.where(positive | (F.conv(F.substring(_lot(keys, seed), 1, 8), 16, 10).cast("long") % 1000 < permille))


def last_of(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The last k rows of an order that has no ties."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)
