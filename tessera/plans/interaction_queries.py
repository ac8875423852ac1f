"""Queries on the interaction log: features, pools, rankers, metrics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tessera.operators import evaluation as ev, graph as gr, ranking as rk, temporal as tm
from tessera.plans.registry import register
from tessera.sources import fixtures as fx

K = 10


def _prep(s, d) -> DataFrame:
    return tm.prep(fx.interactions(s, d), fx.items(s, d), fx.CUT)


def _mine(s, d) -> DataFrame:
    return _prep(s, d).join(fx.cohort(s, d), "user_id", "left_semi")


def _truth(s, d) -> DataFrame:
    return tm.target(fx.interactions(s, d), fx.items(s, d), fx.CUT, fx.HI)


def _pool(s, d) -> DataFrame:
    return rk.trending_pool(_prep(s, d), 40)


def _cands(s, d) -> DataFrame:
    return rk.candidates(_prep(s, d), fx.cohort(s, d), _pool(s, d))


def _recs(s, d) -> DataFrame:
    return rk.model_free(_cands(s, d), K)


def _scores(s, d) -> DataFrame:
    return rk.history_scores(_prep(s, d), fx.cohort(s, d))


register("prep_events", "user_id item_id age f:f decay:f week", _prep, "SELECT * FROM p")
register("item_stats", "item_id pop mean_f:f recent plays trend:f stickiness:f", lambda s, d: tm.item_stats(_prep(s, d)), "SELECT * FROM stats")
register("pair_features", "user_id item_id plays full_plays:f decay_plays:f decay_full:f mean_f:f max_f:f min_f:f recency first_age n_days n_weeks plays_7 plays_14 secs:f span", lambda s, d: tm.pair_features(_prep(s, d)), "SELECT * FROM pairs")
register("user_features", "user_id u_plays u_items u_plays_7 u_recency u_mean_f:f u_repeat_rate:f", lambda s, d: tm.user_features(_prep(s, d)), "SELECT * FROM ufeat")
for by in ("artist", "genre"):
    register(
        f"{by}_affinity", f"user_id {by}:s decay_plays:f n_items share:f", lambda s, d, by=by: tm.affinity(_prep(s, d), by),
        f"SELECT user_id, {by}, sum(decay) AS decay_plays, count(DISTINCT item_id) AS n_items, sum(decay) / (sum(sum(decay)) OVER (PARTITION BY user_id) + 1e-6) AS share FROM p GROUP BY 1, 2",
    )
register("trending_pool", "item_id s:f cand_rank", _pool, "SELECT * FROM pool")
register("candidates", "user_id item_id is_hist cand_rank plays decay_plays:f mean_f:f recency pop trend:f u_plays", _cands, "SELECT * FROM cands")
register("target_quantised", "user_id item_id frac:f", _truth, "SELECT * FROM truth")
register(
    "momentum_features", "user_id item_id std_f:f week_consistency:f plays_3 plays_7 plays_14 momentum:f rank_in_user", lambda s, d: tm.momentum(_prep(s, d)),
    """SELECT user_id, item_id, coalesce(stddev_samp(f), 0) AS std_f, count(DISTINCT week) / (max(age) // 7 + 1) AS week_consistency, count(*) FILTER (age <= 3) AS plays_3, count(*) FILTER (age <= 7) AS plays_7,
    count(*) FILTER (age <= 14) AS plays_14, count(*) FILTER (age <= 7) / (count(*) FILTER (age <= 14) - count(*) FILTER (age <= 7) + 1) AS momentum,
    rank() OVER (PARTITION BY user_id ORDER BY round(sum(decay), 9) DESC) AS rank_in_user FROM p GROUP BY 1, 2""",
)
register(
    "multi_decay", "user_id item_id decay_7:f decay_60:f full_7:f full_60:f", lambda s, d: tm.multi_decay(_prep(s, d), [7, 60]),
    "SELECT user_id, item_id, sum(pow(0.5, age / 7.0)) AS decay_7, sum(pow(0.5, age / 60.0)) AS decay_60, sum(f * pow(0.5, age / 7.0)) AS full_7, sum(f * pow(0.5, age / 60.0)) AS full_60 FROM p GROUP BY 1, 2",
)
register(
    "anchored_decay", "user_id item_id decay_plays_rel:f decay_full_rel:f recency_rel plays_7_rel u_gap", lambda s, d: tm.anchored_decay(_prep(s, d)),
    """SELECT user_id, item_id, sum(pow(0.5, (age - g) / 21.0)) AS decay_plays_rel, sum(f * pow(0.5, (age - g) / 21.0)) AS decay_full_rel, min(age - g) AS recency_rel, count(*) FILTER (age - g <= 7) AS plays_7_rel, any_value(g) AS u_gap
    FROM (SELECT *, min(age) OVER (PARTITION BY user_id) AS g FROM p) GROUP BY 1, 2""",
)
register(
    "cadence", "user_id item_id cadence:f overdue:f log_cadence:f", lambda s, d: tm.cadence(tm.pair_features(_prep(s, d))),
    "SELECT user_id, item_id, span / greatest(n_days - 1, 1) AS cadence, recency / greatest(span / greatest(n_days - 1, 1), 0.5) AS overdue, ln(1 + span / greatest(n_days - 1, 1)) AS log_cadence FROM pairs",
)
register(
    "play_shape", "user_id item_id n n_full n_skip n_part std_f:f full_rate:f skip_rate:f", lambda s, d: tm.play_shape(_prep(s, d)),
    """SELECT user_id, item_id, count(*) AS n, count(*) FILTER (f > 0.9) AS n_full, count(*) FILTER (f < 0.1) AS n_skip, count(*) FILTER (f BETWEEN 0.1 AND 0.9) AS n_part, coalesce(stddev_samp(f), 0) AS std_f,
    count(*) FILTER (f > 0.9) / count(*) AS full_rate, count(*) FILTER (f < 0.1) / count(*) AS skip_rate FROM p GROUP BY 1, 2""",
)
register("popular_topk", "item_id listeners", lambda s, d: rk.popular(_prep(s, d), 20), "SELECT item_id, count(DISTINCT user_id) AS listeners FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_HIST = "hist AS (SELECT user_id, item_id, plays, secs, row_number() OVER (PARTITION BY user_id ORDER BY plays DESC, round(secs, 6) DESC, item_id) AS rank FROM pairs SEMI JOIN users USING (user_id) QUALIFY rank <= 10),"
register("history_topk", "user_id item_id plays rank", lambda s, d: rk.user_history(_prep(s, d), fx.cohort(s, d), K), "SELECT * FROM hist", _HIST)
_FILL = "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY src, rank, item_id) AS rank FROM (SELECT user_id, item_id, min(src) AS src, arg_min(rank, src) AS rank FROM every GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY src, rank, item_id) <= {k}"
register(
    "history_pad", "user_id item_id rank", lambda s, d: rk.history_then_popular(_prep(s, d), fx.cohort(s, d), 30), _FILL.format(k=30),
    _HIST.replace("rank <= 10", "rank <= 30") + """pop AS (SELECT item_id, row_number() OVER (ORDER BY count(DISTINCT user_id) DESC, item_id) AS rank FROM p GROUP BY 1 QUALIFY rank <= 60),
    every AS (SELECT user_id, item_id, 0 AS src, rank FROM hist UNION ALL SELECT user_id, item_id, 1, rank FROM (SELECT DISTINCT user_id FROM hist), pop),""",
)
register("recent_popular", "item_id listeners", lambda s, d: rk.popular(_prep(s, d).where("age <= 7"), 20), "SELECT item_id, count(DISTINCT user_id) AS listeners FROM p WHERE age <= 7 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_DECAYED = "decayed AS (SELECT user_id, item_id, decay_plays AS s, row_number() OVER (PARTITION BY user_id ORDER BY round(decay_plays, 9) DESC, item_id) AS rank FROM pairs SEMI JOIN users USING (user_id) QUALIFY rank <= {n}),"
register("decayed_history", "user_id item_id s:f rank", lambda s, d: rk.decayed_history(_prep(s, d), fx.cohort(s, d), K), "SELECT * FROM decayed", _DECAYED.format(n=10))
register(
    "blend_waterfall", "user_id item_id rank", lambda s, d: rk.blend(_prep(s, d), fx.cohort(s, d), K, 6), _FILL.format(k=10),
    _DECAYED.format(n=6) + "every AS (SELECT user_id, item_id, 0 AS src, rank FROM decayed UNION ALL SELECT user_id, item_id, 1, cand_rank + 1 FROM users, pool WHERE cand_rank < 26),",
)
register(
    "trend_modes", "mode:s item_id s:f", lambda s, d: _modes(s, d),
    """SELECT mode, item_id, s FROM (SELECT unnest(['users', 'plays', 'completion', 'mean_completion']) AS mode, item_id, unnest([u, n, c, m]) AS s FROM (
      SELECT item_id, count(DISTINCT user_id)::DOUBLE AS u, count(*)::DOUBLE AS n, sum(f) AS c, CASE WHEN count(DISTINCT user_id) >= 5 THEN avg(f) * ln(1 + count(DISTINCT user_id)) END AS m FROM p WHERE age <= 7 GROUP BY 1))
    WHERE s IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mode ORDER BY round(s, 9) DESC, item_id) <= 20""",
)


def _modes(s, d) -> DataFrame:
    parts = [rk.trend_list(_prep(s, d), 20, m).select(F.lit(m).alias("mode"), "item_id", "s") for m in ("users", "plays", "completion", "mean_completion")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


register(
    "history_score_modes", "user_id item_id decay_plays:f full_plays:f decay_full:f recency decay_x_meanf:f decay_plays_recency:f", _scores,
    "SELECT user_id, item_id, decay_plays, full_plays, decay_full, -recency AS recency, decay_plays * mean_f AS decay_x_meanf, decay_plays / (1 + recency / 30) AS decay_plays_recency FROM pairs SEMI JOIN users USING (user_id)",
)
_DISCOVER = """aff AS (SELECT user_id, artist, sum(decay) AS a FROM mine GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(sum(decay), 9) DESC, artist) <= 10),
best AS (SELECT artist, item_id, count(*) AS n FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY artist ORDER BY count(*) DESC, item_id) <= 10),
found AS (SELECT user_id, item_id, a * ln(1 + n) AS s FROM aff JOIN best USING (artist) ANTI JOIN mine USING (user_id, item_id)),"""
register("artist_discovery", "user_id item_id s:f", lambda s, d: rk.artist_discovery(_prep(s, d), fx.cohort(s, d), 10, 10), "SELECT * FROM found", _DISCOVER)
register(
    "personal_tail", "user_id item_id cand_rank", lambda s, d: rk.personal_tail(_prep(s, d), fx.cohort(s, d), _pool(s, d), 5),
    "SELECT user_id, item_id, cand_rank FROM users, pool UNION ALL SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) - 1 + 1000 AS r FROM found ANTI JOIN pool USING (item_id) QUALIFY r < 1005", _DISCOVER,
)
register(
    "power_user_pool", "item_id s:f cand_rank", lambda s, d: rk.power_user_pool(_prep(s, d), 45, 20),
    """SELECT item_id, s, row_number() OVER (ORDER BY round(s, 9) DESC, item_id) - 1 AS cand_rank FROM (SELECT item_id, sum(f) AS s FROM p SEMI JOIN (SELECT user_id FROM p GROUP BY 1 HAVING count(*) >= 45) h USING (user_id)
    WHERE age <= 7 GROUP BY 1) QUALIFY cand_rank < 20""",
)
register(
    "first_seen_age", "bucket:s items plays", lambda s, d: tm.first_seen(_prep(s, d)),
    "SELECT CASE WHEN a <= 7 THEN '0-7' WHEN a <= 14 THEN '8-14' ELSE '15+' END AS bucket, count(*) AS items, sum(n) AS plays FROM (SELECT item_id, max(age) AS a, count(*) AS n FROM p GROUP BY 1) GROUP BY 1",
)
register(
    "same_song", "user_id song:s ids plays", lambda s, d: tm.same_song(fx.interactions(s, d), fx.items(s, d)),
    "SELECT user_id, trim(lower(track)) || chr(31) || trim(lower(artist)) AS song, count(DISTINCT item_id) AS ids, count(*) AS plays FROM log JOIN items USING (item_id) GROUP BY 1, 2 HAVING count(DISTINCT item_id) > 1",
)
_MOVES = """moves AS (SELECT a, b, count(*) AS n FROM (SELECT item_id AS a, lead(item_id) OVER w AS b, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts))
WHERE gap <= 21600 AND a <> b GROUP BY 1, 2),"""
register("transitions", "a b n", lambda s, d: tm.transitions(fx.interactions(s, d), 360), "SELECT * FROM moves", _MOVES)
register("transitions_sym", "a b n", lambda s, d: tm.symmetric(tm.transitions(fx.interactions(s, d), 360)), "SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM moves UNION ALL SELECT b, a, n FROM moves) GROUP BY 1, 2", _MOVES)
_SESSIONS = """sess AS (SELECT user_id, item_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM (
SELECT *, coalesce(CAST((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 > 21600 AS INT), 1) AS fresh FROM log WHERE listened >= 30)),"""
register(
    "sessions", "user_id sid plays items", lambda s, d: tm.sessions(fx.interactions(s, d), 21600).groupBy("user_id", "sid").agg(F.count("*").alias("plays"), F.countDistinct("item_id").alias("items")),
    "SELECT user_id, sid, count(*) AS plays, count(DISTINCT item_id) AS items FROM sess GROUP BY 1, 2", _SESSIONS,
)
register(
    "sameday_split", "user_id early late", lambda s, d: tm.sameday_split(fx.interactions(s, d)),
    """SELECT user_id, count(*) FILTER (sec <= mid) AS early, count(*) FILTER (sec > mid) AS late FROM (SELECT *, quantile_cont(sec, 0.5) OVER (PARTITION BY user_id, d) AS mid FROM (
    SELECT user_id, d, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sec FROM log)) GROUP BY 1""",
)
register(
    "drift_windows", "lo:s plays users items mean_listened:f", lambda s, d: tm.drift(fx.interactions(s, d), fx.WINDOWS),
    """SELECT lo, count(*) AS plays, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, avg(listened) AS mean_listened FROM log
    JOIN (VALUES ('2024-01-07', '2024-01-14'), ('2024-01-14', '2024-01-21'), ('2024-01-21', '2024-01-31')) w(lo, hi) ON d >= CAST(lo AS DATE) AND d < CAST(hi AS DATE) GROUP BY 1""",
)
register(
    "retention", "w active kept", lambda s, d: tm.retention(fx.interactions(s, d), dt.date(2024, 1, 1), 5),
    "SELECT a.w, count(*) AS active, count(b.user_id) AS kept FROM act a LEFT JOIN act b ON a.user_id = b.user_id AND b.w = a.w + 1 GROUP BY 1", "act AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', d) // 5 AS w FROM log),",
)
register(
    "pivot_replay", "plays r3:f r7:f r_more:f", lambda s, d: tm.periodicity(_prep(s, d)),
    """SELECT least(plays, 3) AS plays, avg(mean_f) FILTER (recency <= 3) AS r3, avg(mean_f) FILTER (recency > 3 AND recency <= 7) AS r7, avg(mean_f) FILTER (recency > 7) AS r_more FROM pairs GROUP BY 1""",
)

# rankers and fusion
register("model_free_rank", "user_id item_id is_hist rank", _recs, "SELECT * FROM recs")
_AVG = "(rank() OVER (PARTITION BY user_id ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY user_id, round({c}, 9)) - 1) / 2)"
_HSCORES = "hs AS (SELECT user_id, item_id, decay_plays, full_plays FROM pairs SEMI JOIN users USING (user_id)),"
register("rank_average", "user_id item_id s:f", lambda s, d: rk.rank_average(_scores(s, d), ["decay_plays", "full_plays"]), f"SELECT user_id, item_id, ({_AVG.format(c='decay_plays')} + {_AVG.format(c='full_plays')}) / 2 AS s FROM hs", _HSCORES)
register(
    "rrf", "user_id item_id s:f", lambda s, d: rk.reciprocal_rank_fusion(_scores(s, d), ["decay_plays", "full_plays"]),
    "SELECT user_id, item_id, 1 / (60 + rank() OVER (PARTITION BY user_id ORDER BY round(decay_plays, 9) DESC)) + 1 / (60 + rank() OVER (PARTITION BY user_id ORDER BY round(full_plays, 9) DESC)) AS s FROM hs", _HSCORES,
)
register(
    "zscore_blend", "user_id item_id s:f", lambda s, d: rk.zscore_blend(_scores(s, d), {"decay_plays": 0.7, "full_plays": 0.3}),
    "SELECT user_id, item_id, 0.7 * (decay_plays - ma) / (sa + 1e-9) + 0.3 * (full_plays - mb) / (sb + 1e-9) AS s FROM hs, (SELECT avg(decay_plays) AS ma, stddev_samp(decay_plays) AS sa, avg(full_plays) AS mb, stddev_samp(full_plays) AS sb FROM hs)", _HSCORES,
)
_SCORED = "scored AS (SELECT user_id, item_id, is_hist, decay_plays + trend + 0.5 * CAST(is_hist = 0 AS INT) AS s FROM cands),"


def _scored(s, d) -> DataFrame:
    return rk.biased(_cands(s, d).select("user_id", "item_id", "is_hist", (F.col("decay_plays") + F.col("trend")).alias("s")), 0.5)


register(
    "split_slots", "user_id item_id is_hist rank", lambda s, d: rk.split_slots(_scored(s, d), K, 6),
    """SELECT user_id, item_id, is_hist, row_number() OVER (PARTITION BY user_id ORDER BY CAST(r > CASE WHEN is_hist = 1 THEN 6 ELSE 4 END AS INT), round(s, 9) DESC, item_id) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, is_hist ORDER BY round(s, 9) DESC, item_id) AS r FROM scored) QUALIFY rank <= 10""", _SCORED,
)
register("discovery_bias", "user_id item_id rank", lambda s, d: rk.top_k(_scored(s, d), K), "SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS rank FROM scored QUALIFY rank <= 10", _SCORED)
register(
    "slot_allocation", "n_hist hits value:f", lambda s, d: ev.allocation_sweep(_scored(s, d), _truth(s, d), K, [0, 3, 6, 10]),
    """SELECT h AS n_hist, count(*) AS hits, sum(frac) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, is_hist ORDER BY round(s, 9) DESC, item_id) AS r FROM scored) x
    JOIN (VALUES (0), (3), (6), (10)) v(h) ON (is_hist = 1 AND r <= h) OR (is_hist = 0 AND r <= 10 - h) JOIN truth USING (user_id, item_id) GROUP BY 1""", _SCORED,
)

# metrics and reports
register(
    "metric_variants", "metric_a:f metric_b:f metric_c:f metric_d:f metric_e:f metric_f:f", lambda s, d: ev.metrics(_recs(s, d), _truth(s, d), fx.cohort(s, d), K),
    "SELECT sum(s) / nu / 10 AS metric_a, sum(s) / count(*) / 10 AS metric_b, sum(s / least(n, 10)) / count(*) AS metric_c, sum(coalesce(s / nullif(ideal, 0), 0)) / count(*) AS metric_d, sum(s / least(n, 10)) / nu AS metric_e, sum(coalesce(s / nullif(ideal, 0), 0)) / nu AS metric_f FROM per, (SELECT count(*) AS nu FROM users) GROUP BY nu",
    """tops AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frac DESC, item_id) AS r FROM truth SEMI JOIN users USING (user_id)),
    hits AS (SELECT user_id, sum(frac) AS s FROM recs JOIN truth USING (user_id, item_id) GROUP BY 1),
    per AS (SELECT t.user_id, n, ideal, coalesce(s, 0) AS s FROM (SELECT user_id, count(*) AS n, sum(frac) FILTER (r <= 10) AS ideal FROM tops GROUP BY 1) t LEFT JOIN hits USING (user_id)),""",
)
register("oracle_topk", "user_id item_id rank frac:f", lambda s, d: ev.oracle_top(_truth(s, d), K), "SELECT user_id, item_id, frac, row_number() OVER (PARTITION BY user_id ORDER BY frac DESC, item_id) AS rank FROM truth QUALIFY rank <= 10")
register(
    "pool_recall", "pairs pair_recall:f value_recall:f", lambda s, d: ev.pool_recall(_truth(s, d).join(fx.cohort(s, d), "user_id", "left_semi"), _cands(s, d)),
    "SELECT count(*) AS pairs, avg(CAST(c.user_id IS NOT NULL AS INT)) AS pair_recall, sum(frac * CAST(c.user_id IS NOT NULL AS INT)) / sum(frac) AS value_recall FROM (FROM truth SEMI JOIN users USING (user_id)) t LEFT JOIN cands c ON t.user_id = c.user_id AND t.item_id = c.item_id",
)
register("anti_new_items", "user_id item_id frac:f", lambda s, d: ev.anti_new(_truth(s, d), _prep(s, d)), "SELECT * FROM truth ANTI JOIN p USING (user_id, item_id)")
register("semi_history", "user_id item_id frac:f", lambda s, d: ev.semi_history(_truth(s, d), _prep(s, d)), "SELECT * FROM truth SEMI JOIN p USING (user_id, item_id)")
register(
    "strata", "bucket n mean:f", lambda s, d: ev.strata(tm.user_features(_prep(s, d)), "u_mean_f", "u_plays", [20, 40, 60]),
    "SELECT CAST(u_plays >= 20 AS INT) + CAST(u_plays >= 40 AS INT) + CAST(u_plays >= 60 AS INT) AS bucket, count(*) AS n, avg(u_mean_f) AS mean FROM ufeat GROUP BY 1",
)
register(
    "segments", "comes_back users items value:f", lambda s, d: ev.segments(_truth(s, d), _prep(s, d)),
    "SELECT CAST(h.user_id IS NOT NULL AS INT) AS comes_back, count(DISTINCT t.user_id) AS users, count(*) AS items, sum(frac) AS value FROM truth t LEFT JOIN (SELECT DISTINCT user_id FROM p) h ON t.user_id = h.user_id GROUP BY 1",
)
register(
    "repeat_ratio", "quarter users mean_value:f", lambda s, d: ev.repeat_ratio(_truth(s, d), _prep(s, d)),
    "SELECT least(floor(4 * r), 3) AS quarter, count(*) AS users, avg(v) AS mean_value FROM (SELECT t.user_id, avg(CAST(h.user_id IS NOT NULL AS INT)) AS r, sum(frac) AS v FROM truth t LEFT JOIN (SELECT DISTINCT user_id, item_id FROM p) h ON t.user_id = h.user_id AND t.item_id = h.item_id GROUP BY 1) GROUP BY 1",
)
register(
    "spearman_leak", "spearman:f pearson:f", lambda s, d: ev.spearman(tm.item_stats(_prep(s, d)), "pop", "plays"),
    "SELECT corr(ra, rb) AS spearman, corr(pop, plays) AS pearson FROM (SELECT pop, plays, rank() OVER (ORDER BY pop) + (count(*) OVER (PARTITION BY pop) - 1) / 2 AS ra, rank() OVER (ORDER BY plays) + (count(*) OVER (PARTITION BY plays) - 1) / 2 AS rb FROM stats)",
)
register(
    "ks_stat", "ks:f", lambda s, d: ev.ks_statistic(fx.interactions(s, d).select(F.round("listened", 2).alias("x"), (F.col("user_id") % 3 == 0).alias("g")), "x", F.col("g")),
    "SELECT max(abs(cx / nx - cy / ny)) AS ks FROM (SELECT sum(x) OVER (ORDER BY v) AS cx, sum(y) OVER (ORDER BY v) AS cy, sum(x) OVER () AS nx, sum(y) OVER () AS ny FROM (SELECT round(listened, 2) AS v, count(*) FILTER (user_id % 3 = 0) AS x, count(*) FILTER (user_id % 3 <> 0) AS y FROM log GROUP BY 1))",
)
register(
    "output_contract", "wrong_size doubled missing unasked bad_rank", lambda s, d: ev.contract(_recs(s, d), fx.cohort(s, d), K),
    """SELECT count(*) FILTER (n <> 10) AS wrong_size, count(*) FILTER (u <> n) AS doubled, count(*) FILTER (n IS NULL) AS missing, 0 AS unasked, count(*) FILTER (lo <> 1 OR hi <> n) AS bad_rank
    FROM users LEFT JOIN (SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS u, min(rank) AS lo, max(rank) AS hi FROM recs GROUP BY 1) USING (user_id)""",
)
register(
    "slots_by_kind", "is_hist slots hits value:f", lambda s, d: ev.slots_by_kind(_recs(s, d), _truth(s, d)),
    "SELECT is_hist, count(*) AS slots, count(frac) AS hits, coalesce(sum(frac), 0) AS value FROM recs LEFT JOIN truth USING (user_id, item_id) GROUP BY 1",
)
register(
    "list_comparison", "users equal overlap:f", lambda s, d: ev.compare_lists(_recs(s, d), rk.top_k(_scored(s, d), K)),
    """SELECT count(*) AS users, count(*) FILTER (x = y) AS equal, avg(len(list_intersect(x, y))) AS overlap FROM (SELECT user_id, list(item_id ORDER BY rank) AS x FROM recs GROUP BY 1)
    JOIN (SELECT user_id, list(item_id ORDER BY rank) AS y FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item_id) AS rank FROM scored QUALIFY rank <= 10) GROUP BY 1) USING (user_id)""", _SCORED,
)
register(
    "coverage_gap", "covered users value:f", lambda s, d: ev.coverage_gap(_truth(s, d), gr.incidence(_prep(s, d), 3, 100.0)),
    "SELECT CAST(h.user_id IS NOT NULL AS INT) AS covered, count(DISTINCT t.user_id) AS users, sum(frac) AS value FROM truth t LEFT JOIN (SELECT DISTINCT user_id FROM p WHERE age <= 3 AND listened >= 100) h ON t.user_id = h.user_id GROUP BY 1",
)
register("user_weights", "user_id weight:f", lambda s, d: ev.user_weights(_truth(s, d), 50, 0.5), "SELECT user_id, pow(50 / least(count(*), 50), 0.5) AS weight FROM truth GROUP BY 1")
