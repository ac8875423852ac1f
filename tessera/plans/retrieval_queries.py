"""Queries on retrieval over all items, metadata, distributions, samples and the graphs of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import graph as gr, ranking as rk, temporal as tm, vectors as vc
from tessera.plans.interaction_queries import _pool, _prep, _truth
from tessera.plans.registry import register
from tessera.plans.vector_queries import _V, _all, _flat, _near
from tessera.runtime import table
from tessera.sources import fixtures as fx

_CO = """r AS (SELECT user_id, item_id, min(age) AS age FROM p WHERE age <= 14 AND listened >= 30 GROUP BY 1, 2),
seeds AS (SELECT user_id, item_id FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY age, item_id) <= 10),
co AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS co FROM r a JOIN r b USING (user_id) GROUP BY 1, 2),
rs AS (SELECT user_id, j AS item_id, sum(co) AS co, any_value(pop) AS pop FROM seeds JOIN co ON item_id = i JOIN (SELECT item_id AS j, count(*) AS pop FROM r GROUP BY 1) USING (j) GROUP BY 1, 2),
found AS (SELECT user_id, item_id, co / pow(greatest(pop, 1), 0.5) AS s, row_number() OVER (PARTITION BY user_id ORDER BY round(co / pow(greatest(pop, 1), 0.5), 9) DESC, item_id) AS rank FROM rs QUALIFY rank <= 20),"""


def _scores(s, d) -> DataFrame:
    return gr.retrieval_scores(_prep(s, d), fx.cohort(s, d), 14, 10)


def _new(s, d) -> DataFrame:
    return _truth(s, d).join(_prep(s, d).select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


register("retrieve_all_items", "user_id item_id s:f rank", lambda s, d: gr.retrieve(_scores(s, d), 20), "SELECT * FROM found", _CO)
register(
    "retrieval_recall", "popular:f per_user:f mixed:f", lambda s, d: gr.retrieval_recall(gr.retrieve(_scores(s, d), 20), _pool(s, d).select("item_id", (F.col("cand_rank") + 1).alias("rank")), _new(s, d), 20),
    """SELECT sum(CASE WHEN g <= 20 THEN frac ELSE 0 END) / sum(frac) AS popular, sum(CASE WHEN u <= 20 THEN frac ELSE 0 END) / sum(frac) AS per_user, sum(CASE WHEN g <= 10 OR u <= 10 THEN frac ELSE 0 END) / sum(frac) AS mixed
    FROM (SELECT frac, cand_rank + 1 AS g, rank AS u FROM (FROM truth ANTI JOIN p USING (user_id, item_id)) n LEFT JOIN pool USING (item_id) LEFT JOIN found f ON n.user_id = f.user_id AND n.item_id = f.item_id)""", _CO,
)
register(
    "retrieval_sweep", "damp:f hits value:f", lambda s, d: gr.retrieval_sweep(_scores(s, d), _pool(s, d), _prep(s, d), _truth(s, d), [0.2, 0.3, 0.4], 8),
    """SELECT damp, count(frac) AS hits, coalesce(sum(frac), 0) AS value FROM (SELECT damp, user_id, item_id FROM (FROM rs SEMI JOIN pool USING (item_id)) c ANTI JOIN p USING (user_id, item_id), (VALUES (0.2::DOUBLE), (0.3), (0.4)) v(damp)
    QUALIFY row_number() OVER (PARTITION BY damp, user_id ORDER BY round(co / pow(greatest(pop, 1), damp), 9) DESC, item_id) <= 8) LEFT JOIN truth USING (user_id, item_id) GROUP BY 1""", _CO,
)


def _item_meta(s, d) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_size").alias("likes"), F.length("p_name").alias("dislikes"), F.floor(F.col("p_retailprice") / 100).alias("downloads"), F.concat(F.lit("['"), F.col("p_type"), F.lit("', '"), F.col("p_brand"), F.lit("']")).alias("genres"))


def _user_meta(s, d) -> DataFrame:
    plays = _prep(s, d).groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    top = plays.groupBy("user_id").agg(F.max(F.struct("n", "genre")).alias("b")).select("user_id", F.col("b.genre").alias("top_genre"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.floor(F.abs("c_acctbal") / 100).alias("liked"), F.lit(7).alias("disliked"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return c.join(top, "user_id", "left")


register(
    "metadata_features", "user_id item_id like_ratio:f download_ratio:f like_per_play:f u_segment u_nation u_like_rate:f genre_match",
    lambda s, d: tm.metadata_features(tm.pair_features(_prep(s, d)).select("user_id", "item_id").join(tm.item_stats(_prep(s, d)).select("item_id", "pop"), "item_id"), _item_meta(s, d), _user_meta(s, d)),
    """SELECT pairs.user_id, pairs.item_id, p_size / (p_size + length(p_name) + 1) AS like_ratio, floor(p_retailprice / 100) / (p_size + 1) AS download_ratio, p_size / (pop + 1) AS like_per_play, coalesce(seg, 0) AS u_segment, coalesce(c_nationkey, 0) AS u_nation,
    coalesce(floor(abs(c_acctbal) / 100) / (floor(abs(c_acctbal) / 100) + 8), 0) AS u_like_rate, coalesce(CAST(contains('[''' || p_type || ''', ''' || p_brand || ''']', g.genre) AS INT), 0) AS genre_match
    FROM pairs JOIN stats USING (item_id) JOIN part ON pairs.item_id = p_partkey LEFT JOIN customer ON c_custkey = pairs.user_id LEFT JOIN segs USING (c_mktsegment) LEFT JOIN g ON g.user_id = pairs.user_id""",
    """segs AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS seg FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)),
    g AS (SELECT user_id, genre FROM (SELECT user_id, genre, count(*) AS n FROM p GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre DESC) = 1),""",
)
register("category_codes", "c_custkey code", lambda s, d: tm.with_code(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "code"), "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM customer")
register("percentile_list", "q:f x:f", lambda s, d: tm.percentiles(fx.interactions(s, d), "listened", [0.1, 0.5, 0.9, 0.99]), "SELECT unnest([0.1, 0.5, 0.9, 0.99]) AS q, unnest(quantile_cont(listened, [0.1, 0.5, 0.9, 0.99])) AS x FROM log")
register(
    "quartile_labels", "user_id quarter", lambda s, d: tm.quartile_labels(tm.user_features(_prep(s, d)), "u_mean_f"),
    "SELECT user_id, CAST(u_mean_f > q[1] AS INT) + CAST(u_mean_f > q[2] AS INT) + CAST(u_mean_f > q[3] AS INT) AS quarter FROM ufeat, (SELECT quantile_cont(u_mean_f, [0.25, 0.5, 0.75]) AS q FROM ufeat)",
)
register(
    "tie_quantiles", "user_id item_id q", lambda s, d: tm.tie_quantile(fx.interactions(s, d), 3),
    "SELECT user_id, item_id, least(greatest(ceil(r / n * 4), 1), 4) AS q FROM (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY ts DESC, item_id) AS r, count(*) OVER (PARTITION BY user_id, d) AS n FROM log) WHERE n >= 3",
)
register("value_histogram", "bin n", lambda s, d: tm.histogram(fx.interactions(s, d), "listened", 0, 200, 20), "SELECT CASE WHEN listened < 0 THEN 0 WHEN listened >= 200 THEN 21 ELSE floor(listened / 10) + 1 END AS bin, count(*) AS n FROM log GROUP BY 1")
register(
    "disguised_replays", "new_plays disguised users", lambda s, d: tm.disguised_replays(fx.interactions(s, d), fx.items(s, d), fx.CUT),
    "SELECT count(*) AS new_plays, count(k) AS disguised, count(DISTINCT user_id) FILTER (k = 1) AS users FROM (SELECT n.user_id, k.k FROM (SELECT * FROM song WHERE d >= DATE '2024-01-21') n ANTI JOIN old USING (user_id, item_id) LEFT JOIN (SELECT DISTINCT user_id, track, artist, 1 AS k FROM old) k ON n.user_id = k.user_id AND n.track = k.track AND n.artist = k.artist)",
    "song AS (SELECT user_id, item_id, d, trim(lower(track)) AS track, trim(lower(artist)) AS artist FROM log JOIN items USING (item_id)), old AS (SELECT * FROM song WHERE d < DATE '2024-01-21'),",
)
register("seeded_sample", "user_id", lambda s, d: rk.exact_sample(fx.cohort(s, d), "user_id", 10, 3), "SELECT user_id FROM users ORDER BY md5(user_id || ':3'), user_id LIMIT 10")
register(
    "negative_downsample", "user_id item_id is_hist", lambda s, d: rk.downsample_negatives(rk.candidates(_prep(s, d), fx.cohort(s, d), _pool(s, d)), F.col("is_hist") == 1, 300, ["user_id", "item_id"], 5),
    "SELECT user_id, item_id, is_hist FROM cands WHERE is_hist = 1 OR CAST('0x' || substr(md5(user_id || ':' || item_id || ':5'), 1, 8) AS BIGINT) % 1000 < 300",
)
register("last_events", "user_id item_id", lambda s, d: rk.last_of(fx.interactions(s, d), 25, ["ts", "user_id"]), "SELECT user_id, item_id FROM log ORDER BY ts DESC, user_id DESC LIMIT 25")
register(
    "recent_by_date", "item_id listeners", lambda s, d: rk.popular(_prep(s, d).where(F.col("d") >= F.date_sub(F.lit(fx.CUT), 5)), 20),
    "SELECT item_id, count(DISTINCT user_id) AS listeners FROM p WHERE d >= DATE '2024-01-21' - 5 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
register(
    "key_alignment", "left_only right_only repeated", lambda s, d: _alignment(rk.candidates(_prep(s, d), fx.cohort(s, d), _pool(s, d)), tm.pair_features(_prep(s, d))),
    "SELECT count(*) FILTER (b.user_id IS NULL) AS left_only, count(*) FILTER (a.user_id IS NULL) AS right_only, 0 + count(*) - count(DISTINCT (coalesce(a.user_id, b.user_id), coalesce(a.item_id, b.item_id))) AS repeated FROM cands a FULL JOIN pairs b ON a.user_id = b.user_id AND a.item_id = b.item_id",
)


def _alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys that only one of two cached tables holds, and rows beyond one a key."""
    keys = ["user_id", "item_id"]
    n = a.groupBy(keys).agg(F.count("*").alias("x")).join(b.groupBy(keys).agg(F.count("*").alias("y")), keys, "full")
    return n.agg(F.count_if(F.col("y").isNull()).alias("left_only"), F.count_if(F.col("x").isNull()).alias("right_only"), F.sum(F.coalesce("x", F.lit(1)) * F.coalesce("y", F.lit(1)) - 1).alias("repeated"))


# graphs of vectors
def _verified(near: DataFrame) -> DataFrame:
    """Second and first neighbours stand for pairs that another method verified."""
    return near.where(F.col("rank") == F.col("src") % 2 + 1).select("src", "dst", F.floor(F.col("sim") * 100).alias("n"))


def _injected(near: DataFrame) -> DataFrame:
    return gr.inject_edges(gr.affinity_graph(near), _verified(near).where("n >= 40").select("src", "dst", F.lit(0.5).alias("w")))


def _baked(vectors: DataFrame, near: DataFrame) -> DataFrame:
    return vc.bake_disagreeing(vectors, _verified(near), near, vectors, 0.7, 30)


_SYM = _V + "ed AS (SELECT src, dst, pow(greatest(sim, 0), 3) AS w FROM near), sym AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, w FROM ed UNION ALL SELECT dst, src, w FROM ed) GROUP BY 1, 2), deg AS (SELECT src, sum(w) AS g FROM sym GROUP BY 1),"
register(
    "inject_edges", "src dst w:f", lambda s, d: _injected(_near(s, d)),
    """SELECT src, dst, max(w) AS w FROM (SELECT sym.src, sym.dst, w / sqrt(a.g * b.g) AS w FROM sym JOIN deg a ON sym.src = a.src JOIN deg b ON sym.dst = b.src WHERE w > 0
    UNION ALL SELECT src, dst, 0.5 FROM ver UNION ALL SELECT dst, src, 0.5 FROM ver) GROUP BY 1, 2""",
    _SYM + "ver AS (SELECT src, dst FROM near WHERE rank = src % 2 + 1 AND floor(sim * 100) >= 40),",
)
register(
    "bake_disagreeing", "vec_id i x:f", lambda s, d: _flat(_baked(_all(s, d), _near(s, d))),
    """SELECT vec_id, generate_subscripts(c, 1) - 1 AS i, unnest(list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-12))) AS x
    FROM (SELECT q.vec_id, CASE WHEN g.v IS NULL THEN q.v ELSE list_transform(list_zip(q.v, g.v), lambda z: z[1] + 0.7 * z[2]) END AS c FROM u q LEFT JOIN (SELECT src, dst FROM near WHERE rank = src % 2 + 1 AND rank <> 1 AND floor(sim * 100) >= 30) n ON n.src = q.vec_id LEFT JOIN u g ON g.vec_id = n.dst)""", _V,
)
register(
    "margin_sweep", "margin:f turned mean_gain:f", lambda s, d: vc.margin_sweep(_two_views(s, d), [-0.2, -0.1, 0.0, 0.05]),
    "SELECT margin, count(gain) AS turned, avg(gain) AS mean_gain FROM (VALUES (-0.2::DOUBLE), (-0.1), (0.0), (0.05)) m(margin) LEFT JOIN (SELECT n.src, max(b.s) - any_value(n.sim) AS gain FROM near n JOIN turned b ON n.src = b.src WHERE n.rank = 1 GROUP BY 1) ON gain > margin GROUP BY 1",
    _V + "turned AS (SELECT a.vec_id AS src, max(round(list_dot_product(list_reverse(a.v), b.v), 6)) AS s FROM u a, u b WHERE a.vec_id <> b.vec_id GROUP BY 1),",
)


def _two_views(s, d) -> DataFrame:
    """The first neighbours' similarities of each vector and of its reverse."""
    turned = vc.neighbours(_all(s, d).withColumn("v", F.reverse("v")), _all(s, d), 1)
    view = lambda n, k: n.where("rank = 1").select(F.col("src").alias("vec_id"), F.lit(k).alias("view"), "sim")
    return view(_near(s, d), 0).union(view(turned, 1))


register(
    "graph_connectivity", "components largest single", lambda s, d: gr.connectivity(_near(s, d).where("rank <= 2"), _all(s, d).select(F.col("vec_id").alias("node"))),
    "SELECT count(*) AS components, max(n) AS largest, count(*) FILTER (n = 1) AS single FROM (SELECT c, count(*) AS n FROM (SELECT x, min(y) AS c FROM reach GROUP BY 1) GROUP BY 1)",
    _V + "links AS (SELECT src AS x, dst AS y FROM near WHERE rank <= 2 UNION ALL SELECT dst, src FROM near WHERE rank <= 2), reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),",
)
register(
    "power_mean_pool", "vec_id i x:f", lambda s, d: _flat(_all(s, d).select("vec_id", vc.power_mean(F.array(*[F.slice("v", k, 16) for k in (1, 17, 33, 49)])).alias("v"))),
    "SELECT vec_id, unnest(range(16)) AS i, unnest(list_transform(range(1, 17), lambda k: pow((pow(greatest(v[k], 1e-6), 3) + pow(greatest(v[k + 16], 1e-6), 3) + pow(greatest(v[k + 32], 1e-6), 3) + pow(greatest(v[k + 48], 1e-6), 3)) / 4, 1 / 3.0))) AS x FROM v", _V,
)
