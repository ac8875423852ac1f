"""Features of users, items and pairs as of a cut-off day.

Logs have user_id, item_id, d, listened (and ts); items have item_id, duration, artist, genre. Nothing on or after
the cut-off is read. Item tables are joined plainly: Spark broadcasts them while they are small.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

HALFLIFE = 5.0


def quantised(f: Column) -> Column:
    """To quarters; halves go up."""
    return F.floor(4 * f + 0.5) / 4


def decayed(age: Column, halflife: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(float(halflife)))


def prep(log: DataFrame, items: DataFrame, cut: dt.date, halflife: float = HALFLIFE) -> DataFrame:
    """Plays before the cut-off with age (days, 1 or more), f (share listened, 0 to 1), decay and week; items without a positive duration are left out."""
    age = F.datediff(F.lit(cut), "d")
    before = log.where(F.col("d") < F.lit(cut)).join(items, "item_id").where(F.col("duration") > 0)
    return before.withColumn("age", age).withColumns({"f": F.least(F.greatest(F.col("listened") / F.col("duration"), F.lit(0.0)), F.lit(1.0)), "decay": decayed(F.col("age"), halflife), "week": F.floor(F.col("age") / 7)})


def item_stats(p: DataFrame, days: int = 14) -> DataFrame:
    """Listeners, mean share, recent plays, all plays, trend and stickiness of items."""
    g = p.groupBy("item_id").agg(F.countDistinct("user_id").alias("pop"), F.avg("f").alias("mean_f"), F.count_if(F.col("age") <= days).alias("recent"), F.count("*").alias("plays"))
    return g.withColumns({"trend": F.col("recent") / (F.col("plays") + 1), "stickiness": F.col("plays") / (F.col("pop") + 1)})


def pair_features(p: DataFrame) -> DataFrame:
    """Per (user, item)."""
    return p.groupBy("user_id", "item_id").agg(
        F.count("*").alias("plays"), F.sum("f").alias("full_plays"), F.sum("decay").alias("decay_plays"), F.sum(F.col("f") * F.col("decay")).alias("decay_full"), F.avg("f").alias("mean_f"), F.max("f").alias("max_f"), F.min("f").alias("min_f"),
        F.min("age").alias("recency"), F.max("age").alias("first_age"), F.countDistinct("d").alias("n_days"), F.countDistinct("week").alias("n_weeks"), F.count_if(F.col("age") <= 7).alias("plays_7"), F.count_if(F.col("age") <= 14).alias("plays_14"), F.sum("listened").alias("secs"),
    ).withColumn("span", F.col("first_age") - F.col("recency"))


def user_features(p: DataFrame) -> DataFrame:
    g = p.groupBy("user_id").agg(F.count("*").alias("u_plays"), F.countDistinct("item_id").alias("u_items"), F.count_if(F.col("age") <= 7).alias("u_plays_7"), F.min("age").alias("u_recency"), F.avg("f").alias("u_mean_f"))
    return g.withColumn("u_repeat_rate", 1 - F.col("u_items") / F.col("u_plays"))


def affinity(p: DataFrame, by: str) -> DataFrame:
    """Decayed plays, share of them and distinct items of each user's artists or genres."""
    g = p.groupBy("user_id", by).agg(F.sum("decay").alias("decay_plays"), F.countDistinct("item_id").alias("n_items"))
    total = p.groupBy("user_id").agg(F.sum("decay").alias("total"))
    return g.join(total, "user_id").withColumn("share", F.col("decay_plays") / (F.col("total") + 1e-6)).drop("total")


def momentum(p: DataFrame) -> DataFrame:
    """Spread, weekly consistency, momentum, short windows and the item's place in the user's history."""
    g = p.groupBy("user_id", "item_id").agg(F.coalesce(F.stddev_samp("f"), F.lit(0.0)).alias("std_f"), F.countDistinct("week").alias("weeks"), F.count_if(F.col("age") <= 3).alias("plays_3"), F.count_if(F.col("age") <= 7).alias("plays_7"), F.count_if(F.col("age") <= 14).alias("plays_14"), F.sum("decay").alias("decay_plays"), (F.floor(F.max("age") / 7) + 1).alias("lived"))
    rank = F.rank().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("decay_plays", 9))))
    return g.withColumns({"week_consistency": F.col("weeks") / F.col("lived"), "momentum": F.col("plays_7") / (F.col("plays_14") - F.col("plays_7") + 1), "rank_in_user": rank.cast("long")}).drop("weeks", "lived")


def multi_decay(p: DataFrame, halflives: list[float]) -> DataFrame:
    return p.groupBy("user_id", "item_id").agg(*[F.sum(decayed(F.col("age"), h)).alias(f"decay_{h:g}") for h in halflives], *[F.sum(F.col("f") * decayed(F.col("age"), h)).alias(f"full_{h:g}") for h in halflives])


def anchored_decay(p: DataFrame, halflife: float = 21.0) -> DataFrame:
    """Ages from each user's own last day; u_gap is that day's age."""
    last = p.groupBy("user_id").agg(F.min("age").alias("u_gap"))
    rel = p.join(last, "user_id").withColumn("age_rel", F.col("age") - F.col("u_gap"))
    return rel.groupBy("user_id", "item_id").agg(F.sum(decayed(F.col("age_rel"), halflife)).alias("decay_plays_rel"), F.sum(F.col("f") * decayed(F.col("age_rel"), halflife)).alias("decay_full_rel"), F.min("age_rel").alias("recency_rel"), F.count_if(F.col("age_rel") <= 7).alias("plays_7_rel"), F.first("u_gap").alias("u_gap"))


def cadence(pairs: DataFrame) -> DataFrame:
    """How long between a user's returns to an item, and how overdue the next is; from pair_features."""
    gap = F.col("span") / F.greatest(F.col("n_days") - 1, F.lit(1))
    return pairs.select("user_id", "item_id", gap.alias("cadence"), (F.col("recency") / F.greatest(gap, F.lit(0.5))).alias("overdue"), F.log1p(gap).alias("log_cadence"))


def play_shape(p: DataFrame) -> DataFrame:
    g = p.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.count_if(F.col("f") > 0.9).alias("n_full"), F.count_if(F.col("f") < 0.1).alias("n_skip"), F.count_if(F.col("f").between(0.1, 0.9)).alias("n_part"), F.coalesce(F.stddev_samp("f"), F.lit(0.0)).alias("std_f"))
    return g.withColumns({"full_rate": F.col("n_full") / F.col("n"), "skip_rate": F.col("n_skip") / F.col("n")})


def target(log: DataFrame, items: DataFrame, lo: dt.date, hi: dt.date) -> DataFrame:
    """Quantised share listened in [lo, hi) for each pair, one full play at most."""
    w = log.where((F.col("d") >= F.lit(lo)) & (F.col("d") < F.lit(hi))).join(items, "item_id").where(F.col("duration") > 0)
    total = w.groupBy("user_id", "item_id").agg(F.sum(F.col("listened") / F.col("duration")).alias("x"))
    return total.select("user_id", "item_id", F.least(quantised(F.greatest(F.col("x"), F.lit(0.0))), F.lit(1.0)).alias("frac"))


def first_seen(p: DataFrame) -> DataFrame:
    """Items and plays by the age of the item's first play."""
    first = p.groupBy("item_id").agg(F.max("age").alias("a"), F.count("*").alias("n"))
    bucket = F.when(F.col("a") <= 7, "0-7").when(F.col("a") <= 14, "8-14").otherwise("15+")
    return first.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("items"), F.sum("n").alias("plays"))


def same_song(log: DataFrame, items: DataFrame) -> DataFrame:
    """Songs, by normalised title and artist, that a user played under several ids."""
    song = F.concat_ws("\x1f", F.trim(F.lower("track")), F.trim(F.lower("artist")))
    p = log.join(items.select("item_id", song.alias("song")), "item_id")
    g = p.groupBy("user_id", "song").agg(F.countDistinct("item_id").alias("ids"), F.count("*").alias("plays"))
    return g.where("ids > 1")


def transitions(log: DataFrame, minutes: int = 60) -> DataFrame:
    """Counts of (a, b): b follows a of the same user within the gap, a is not b."""
    w = Window.partitionBy("user_id").orderBy("ts")
    nxt = log.select(F.col("item_id").alias("a"), F.lead("item_id").over(w).alias("b"), ((F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("gap"))
    return nxt.where((F.col("gap") <= minutes * 60) & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))


def symmetric(t: DataFrame) -> DataFrame:
    return t.union(t.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def sessions(log: DataFrame, gap: int, min_listened: float = 30.0) -> DataFrame:
    """Plays with sid, the number of the user's session; a gap of exactly ``gap`` seconds stays inside."""
    w = Window.partitionBy("user_id").orderBy("ts")
    kept = log.where(F.col("listened") >= min_listened)
    new = F.coalesce(((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6 > gap).cast("int"), F.lit(1))
    return kept.withColumn("_new", new).withColumn("sid", F.sum("_new").over(w)).drop("_new")


def sameday_split(log: DataFrame) -> DataFrame:
    """Plays in the first and the second half of each user's listening time on a day."""
    sec = log.withColumn("sec", F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts"))
    mid = sec.groupBy("user_id", "d").agg(F.percentile("sec", 0.5).alias("mid"))
    return sec.join(mid, ["user_id", "d"]).groupBy("user_id").agg(F.count_if(F.col("sec") <= F.col("mid")).alias("early"), F.count_if(F.col("sec") > F.col("mid")).alias("late"))


def drift(log: DataFrame, windows: list[tuple[dt.date, dt.date]]) -> DataFrame:
    """Plays, users, items and mean duration of each window: a table of windows is joined, not looped over."""
    spark = log.sparkSession
    w = spark.createDataFrame([(str(lo), str(hi)) for lo, hi in windows], "lo string, hi string")
    j = log.join(F.broadcast(w), (F.col("d") >= F.to_date("lo")) & (F.col("d") < F.to_date("hi")))
    return j.groupBy("lo").agg(F.count("*").alias("plays"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.avg("listened").alias("mean_listened"))


def retention(log: DataFrame, start: dt.date, days: int) -> DataFrame:
    """Users active in each window of days, and how many of them are in the next."""
    k = F.floor(F.datediff("d", F.lit(start)) / days)
    active = log.select("user_id", k.alias("w")).distinct()
    nxt = active.select("user_id", (F.col("w") - 1).alias("w"), F.lit(1).alias("kept"))
    return active.join(nxt, ["user_id", "w"], "left").groupBy("w").agg(F.count("*").alias("active"), F.count("kept").alias("kept"))


def periodicity(p: DataFrame) -> DataFrame:
    """Mean share listened by recency bin and number of plays, bins of recency across."""
    g = p.groupBy("user_id", "item_id").agg(F.min("age").alias("r"), F.count("*").alias("n"), F.avg("f").alias("m"))
    b = g.select(F.when(F.col("r") <= 3, "r3").when(F.col("r") <= 7, "r7").otherwise("r_more").alias("rb"), F.least("n", F.lit(3)).alias("plays"), "m")
    agg = b.groupBy("rb", "plays").agg(F.avg("m").alias("m"))
    return agg.groupBy("plays").pivot("rb", ["r3", "r7", "r_more"]).agg(F.first("m"))


def with_code(df: DataFrame, col: str, out: str) -> DataFrame:
    """A category as the place of its value among all, from 0; null for a null. Only distinct values are ranked."""
    codes = df.select(col).where(F.col(col).isNotNull()).distinct().select(F.col(col).alias("_v"), (F.row_number().over(Window.orderBy(col)) - 1).cast("long").alias(out))
    return df.join(codes, df[col] == codes["_v"], "left").drop("_v")


def metadata_features(cands: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Like, download and play ratios of items, like rate and codes of users, and whether the user's top genre is among the item's; nulls are 0.

    cands: user_id, item_id, pop. items: item_id, likes, dislikes, downloads, genres. users: user_id, liked, disliked, segment, nation, top_genre.
    """
    c = F.col
    i = items.select("item_id", "likes", "genres", (c("likes") / (c("likes") + c("dislikes") + 1)).alias("like_ratio"), (c("downloads") / (c("likes") + 1)).alias("download_ratio"))
    u = with_code(users, "segment", "u_segment").select("user_id", "u_segment", c("nation").alias("u_nation"), (c("liked") / (c("liked") + c("disliked") + 1)).alias("u_like_rate"), "top_genre")
    out = cands.join(i, "item_id", "left").join(u, "user_id", "left")
    match = F.coalesce(F.contains("genres", "top_genre").cast("int"), F.lit(0))
    out = out.select("user_id", "item_id", "like_ratio", "download_ratio", (c("likes") / (c("pop") + 1)).alias("like_per_play"), "u_segment", "u_nation", "u_like_rate", match.alias("genre_match"))
    return out.fillna(0)


def percentiles(df: DataFrame, col: str, at: list[float]) -> DataFrame:
    """Linear percentiles in one pass, a row for each."""
    row = df.agg(F.percentile(col, F.array(*[F.lit(x) for x in at])).alias("v"))
    return row.select(F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in at]).alias("q"), "v")).alias("z")).select(F.col("z.q").alias("q"), F.col("z.v").alias("x"))


def quartile_labels(df: DataFrame, col: str) -> DataFrame:
    """Quarter 0 to 3 by the table's own quartiles; a value equal to one is below it."""
    cuts = df.agg(F.percentile(col, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("quarter", F.aggregate("_q", F.lit(0), lambda a, q: a + (F.col(col) > q).cast("int"))).drop("_q")


def tie_quantile(log: DataFrame, least: int = 8) -> DataFrame:
    """user_id, d, ts, q: the quarter (1 newest) of each play among the plays of its user and day, where there are enough."""
    w = Window.partitionBy("user_id", "d")
    r = log.withColumn("_r", F.row_number().over(w.orderBy(F.desc("ts"), "item_id"))).withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least)
    return r.select("user_id", "d", "ts", "item_id", F.least(F.greatest(F.ceil(F.col("_r") / F.col("_n") * 4), F.lit(1)), F.lit(4)).alias("q"))


def histogram(df: DataFrame, col: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts in n equal bins; 0 is below them and n + 1 from their end on."""
    return df.groupBy(F.width_bucket(F.col(col), F.lit(float(lo)), F.lit(float(hi)), F.lit(n)).alias("bin")).agg(F.count("*").alias("n"))


def disguised_replays(log: DataFrame, items: DataFrame, cut: dt.date) -> DataFrame:
    """Plays from the cut on of items new to the user, how many are songs known under another id, and users who have any."""
    song = F.concat_ws("\x1f", F.trim(F.lower("track")), F.trim(F.lower("artist")))
    p = log.join(items.select("item_id", song.alias("song")), "item_id")
    old, new = p.where(F.col("d") < F.lit(cut)), p.where(F.col("d") >= F.lit(cut))
    fresh = new.join(old.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    known = fresh.join(old.select("user_id", "song", F.lit(1).alias("_k")).distinct(), ["user_id", "song"], "left")
    return known.agg(F.count("*").alias("new_plays"), F.count("_k").alias("disguised"), F.countDistinct(F.when(F.col("_k") == 1, F.col("user_id"))).alias("users"))
