"""Sparse products over the log as joins and sums: co-visitation, walks, neighbours, co-occurrence, affinity graphs.

R is the set of distinct (user, item) pairs of a window; pop is an item's users plus one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators import grid
from tessera.runtime import Scratch

#: Users are joined on items where that makes at most so many times the rows; else they meet in a grid, in blocks of so many users.
JOIN_GROWTH, BLOCK_USERS = 20, 8_192
#: Users of either side that are multiplied at a time, and numbers of such a table that is written out.
CHUNK, TILE, NUMBERS = 512, 2_048, 2_000_000


def incidence(p: DataFrame, days: int, least: float) -> DataFrame:
    """Distinct pairs of the last days that were listened to long enough, with their least age."""
    return p.where((F.col("age") <= days) & (F.col("listened") >= least)).groupBy("user_id", "item_id").agg(F.min("age").alias("age"))


def seeds(r: DataFrame, users: DataFrame, n: int) -> DataFrame:
    """Each user's n most recent items, seed 1 first; ties by item."""
    w = Window.partitionBy("user_id").orderBy("age", "item_id")
    return r.join(users, "user_id", "left_semi").withColumn("seed", F.row_number().over(w)).where(F.col("seed") <= n)


def item_similarity(r: DataFrame, left: DataFrame, right: DataFrame, damp: float = 0.5) -> DataFrame:
    """sim(i, j) = users of both over damped popularities, for items of left and right only.

    Both sides are cut to their items before the join on users, so rows grow with what is asked for, not with the log.
    """
    pop = r.groupBy("item_id").agg((F.count("*") + 1).alias("pop"))
    d = r.join(pop, "item_id").select("user_id", "item_id", F.pow("pop", F.lit(-damp)).alias("w"))
    a = d.join(left.select("item_id").distinct(), "item_id", "left_semi").select("user_id", F.col("item_id").alias("i"), F.col("w").alias("wi"))
    b = d.join(right.select("item_id").distinct(), "item_id", "left_semi").select("user_id", F.col("item_id").alias("j"), F.col("w").alias("wj"))
    return a.join(b, "user_id").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("sim"))


def covisitation(p: DataFrame, users: DataFrame, pool: DataFrame, days: int = 30, n_seeds: int = 20, least: float = 30.0, damp: float = 0.5) -> DataFrame:
    """Sum over a user's seeds of their similarity to each pool item."""
    r = incidence(p, days, least)
    s = seeds(r, users, n_seeds)
    sim = item_similarity(r, s, pool, damp)
    return s.join(sim, s["item_id"] == sim["i"]).groupBy("user_id", F.col("j").alias("item_id")).agg(F.sum("sim").alias("covis"))


def covisitation_ranked(*args, **more) -> DataFrame:
    g = covisitation(*args, **more)
    return g.withColumn("covis_rank", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("covis", 9)))).cast("long"))


def covisitation_stats(p: DataFrame, users: DataFrame, pool: DataFrame, days: int = 30, n_seeds: int = 20, least: float = 30.0, halflife: float = 7.0) -> DataFrame:
    """Sum, max, mean over all seeds, mean of the best three, age-weighted sum and the last seed's similarity, with three ranks."""
    r = incidence(p, days, least)
    s = seeds(r, users, n_seeds)
    sim = item_similarity(r, s, pool)
    n = s.groupBy("user_id").agg(F.count("*").alias("n"))
    j = s.join(sim, s["item_id"] == sim["i"]).select("user_id", F.col("j").alias("item_id"), "seed", "age", "sim")
    g = j.groupBy("user_id", "item_id").agg(
        F.sum("sim").alias("cv_sum"), F.max("sim").alias("cv_max"), F.slice(F.sort_array(F.collect_list("sim"), False), 1, 3).alias("top"), F.sum(F.col("sim") * F.pow(F.lit(0.5), F.col("age") / halflife)).alias("cv_wsum"), F.coalesce(F.sum(F.when(F.col("seed") == 1, F.col("sim"))), F.lit(0.0)).alias("cv_last")
    )
    g = g.join(n, "user_id").withColumns({"cv_mean": F.col("cv_sum") / F.col("n"), "cv_top3": F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.least("n", F.lit(3))})
    rank = lambda c: F.rank().over(Window.partitionBy("user_id").orderBy(F.desc(F.round(c, 9)))).cast("long")
    return g.select("user_id", "item_id", "cv_sum", "cv_max", "cv_mean", "cv_top3", "cv_wsum", "cv_last", *[rank(c).alias(f"{c}_rank") for c in ("cv_max", "cv_wsum", "cv_top3")])


def session_covisitation(sessions: DataFrame, users: DataFrame, pool: DataFrame, n_seeds: int = 30, damp: float = 0.5) -> DataFrame:
    """Co-visitation with sessions as rows; seeds are the user's most played items."""
    r = sessions.select(F.struct("user_id", "sid").alias("user_id"), "item_id").distinct()
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "item_id")
    s = sessions.join(users, "user_id", "left_semi").groupBy("user_id", "item_id").agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_seeds)
    sim = item_similarity(r, s, pool, damp)
    return s.join(sim, s["item_id"] == sim["i"]).groupBy("user_id", F.col("j").alias("item_id")).agg(F.sum("sim").alias("scovis"))


def three_step_walk(p: DataFrame, users: DataFrame, pool: DataFrame, days: int = 30, least: float = 30.0, beta: float = 0.4) -> DataFrame:
    """user to item to user to item, each step by degree, damped by popularity; the middle is one item-item matrix."""
    r = incidence(p, days, least)
    du = r.groupBy("user_id").agg(F.count("*").alias("du"))
    di = r.groupBy("item_id").agg(F.count("*").alias("di"))
    e = r.join(du, "user_id").join(di, "item_id").select("user_id", "item_id", (1 / F.col("du")).alias("pu"), (1 / F.col("di")).alias("pi"), "di")
    ends = e.join(pool.select("item_id"), "item_id", "left_semi").select("user_id", F.col("item_id").alias("j"), F.col("pu").alias("pj"), (F.col("di") + 1).alias("pop"))
    middle = e.select("user_id", F.col("item_id").alias("i"), "pi").join(ends, "user_id").groupBy("i", "j").agg(F.sum(F.col("pi") * F.col("pj")).alias("m"), F.first("pop").alias("pop"))
    starts = e.join(users, "user_id", "left_semi").select("user_id", F.col("item_id").alias("i"), "pu")
    g = starts.join(middle, "i").groupBy("user_id", F.col("j").alias("item_id")).agg(F.sum(F.col("pu") * F.col("m")).alias("rp3b0"), F.first("pop").alias("pop"))
    return g.select("user_id", "item_id", (F.col("rp3b0") / F.pow("pop", F.lit(beta))).alias("rp3"), "rp3b0")


def _rows_of_users(pairs: DataFrame, weight: str) -> DataFrame:
    """A row for each user: items and their weights."""
    both = F.collect_list(F.struct("item_id", F.col(weight).cast("double").alias("w")))
    return pairs.groupBy("user_id").agg(both.alias("b")).select("user_id", F.col("b.item_id").alias("items"), F.col("b.w").alias("ws"))


def _dense_pays(pairs: DataFrame) -> bool:
    """Whether a join of pairs with themselves on the item makes many times more rows than they have."""
    n = pairs.groupBy("item_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * F.col("n")).alias("joined")).first()
    return (n.joined or 0) > JOIN_GROWTH * (n.rows or 0)


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Users of a batch of rows, and the row, item and weight of each of their pairs."""
    users, items, ws = (batch.column(batch.schema.get_field_index(c)) for c in ("user_id", "items", "ws"))
    return users.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(users)), pc.list_value_length(items).to_numpy(zero_copy_only=False)), items.flatten().to_numpy(), ws.flatten().to_numpy()


def _dense(rows: np.ndarray, items: np.ndarray, ws: np.ndarray, n: int, columns: np.ndarray, kind=float) -> np.ndarray:
    """n rows over the given items, others left out."""
    at = np.minimum(np.searchsorted(columns, items), len(columns) - 1)
    here = columns[at] == items
    out = np.zeros((n, len(columns)), kind)
    out[rows[here], at[here]] = ws[here]
    return out


def _tiles(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """Sparse rows of at most so many users that they are small when written out over ``width`` items."""
    step = max(16, min(TILE, NUMBERS // max(1, width)))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield _sparse(b.slice(lo, step))


def _without_self(products: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    order = np.argsort(theirs)
    at = np.minimum(np.searchsorted(theirs[order], mine), len(theirs) - 1)
    here = np.flatnonzero(theirs[order[at]] == mine)
    products[here, order[at[here]]] = 0
    return products


def _alike(n: int, digits: int = 9) -> Callable:
    """Cells that give, for each user of the left, all of the right that are not under its n-th most alike there."""

    def work(head: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_sparse(b) for b in head]
        columns, least = np.unique(np.concatenate([p[2] for p in parts])), [np.full((len(p[0]), n), -np.inf) for p in parts]
        held, kept = [], 0

        def given() -> Iterator[pa.RecordBatch]:
            for p, i, v, sim in held:
                ok = sim.round(digits) >= least[p][i, -1]
                if ok.any():
                    yield pa.record_batch([pa.array(parts[p][0][i[ok]]), pa.array(v[ok]), pa.array(sim[ok])], ["u", "v", "sim"])

        for users, rows, items, ws in _tiles(rest, len(columns)):
            theirs = _dense(rows, items, ws, len(users), columns).T
            for p, own in enumerate(parts):
                step = max(16, min(CHUNK, NUMBERS // len(columns)))
                for at in range(0, len(own[0]), step):
                    lo, hi = np.searchsorted(own[1], [at, at + step])
                    mine = own[0][at : at + step]
                    sims = _without_self(_dense(own[1][lo:hi] - at, own[2][lo:hi], own[3][lo:hi], len(mine), columns) @ theirs, mine, users)
                    i, j = np.divmod(np.flatnonzero((sims > 0) & (sims >= least[p][at : at + step, -1:] - 10.0**-digits)), len(users))
                    if not len(i):
                        continue
                    sim, i = sims[i, j], i + at
                    held.append((p, i, users[j], sim))
                    kept += len(i)
                    touched = np.unique(i)
                    r, s = np.concatenate([i, np.repeat(touched, n)]), np.concatenate([sim.round(digits), least[p][touched].ravel()])
                    order = np.lexsort((-s, r))
                    order = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < n]
                    least[p][touched] = s[order].reshape(-1, n)
                    if kept > NUMBERS:  # what is under the n-th now goes; the ties that are left are passed on
                        yield from given()
                        held, kept = [], 0
        yield from given()

    return work


def user_neighbours(p: DataFrame, users: DataFrame, n: int, days: int = 30, least: float = 30.0, halflife: float = 21.0, alpha: float = 0.5) -> DataFrame:
    """The n most alike users (cosine of damped rows) of each user of the cohort; ties at the last are all kept.

    Where items are shared by so many users that a join would multiply the rows, users meet in the cells of a grid.
    """
    scratch = Scratch(p.sparkSession, "alike")
    r = scratch.write(p.where((F.col("age") <= days) & (F.col("listened") >= least)).groupBy("user_id", "item_id").agg(F.sum(F.pow(F.lit(0.5), F.col("age") / halflife)).alias("x")), "plays")
    pop = r.groupBy("item_id").agg((F.sum("x") + 1).alias("pop"))
    d = r.join(pop, "item_id").select("user_id", "item_id", (F.col("x") / F.pow("pop", F.lit(alpha))).alias("w"))
    norm = d.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    d = d.join(norm, "user_id").select("user_id", "item_id", (F.col("w") / F.col("norm")).alias("w"))
    if _dense_pays(r):
        rows = scratch.write(_rows_of_users(d.where("user_id is not null and item_id is not null"), "w"), "rows")
        sims = _met(rows.join(users, "user_id", "left_semi"), rows, _alike(n), "u long, v long, sim double")
    else:
        a = d.join(users, "user_id", "left_semi").select(F.col("user_id").alias("u"), "item_id", F.col("w").alias("wu"))
        sims = a.join(d, "item_id").where("u != user_id").groupBy("u", F.col("user_id").alias("v")).agg(F.sum(F.col("wu") * F.col("w")).alias("sim"))
    return sims.withColumn("_r", F.rank().over(Window.partitionBy("u").orderBy(F.desc(F.round("sim", 9))))).where(F.col("_r") <= n).drop("_r")


def _met(left: DataFrame, right: DataFrame, work: Callable, schema: str) -> DataFrame:
    return grid.meet(left, right, "user_id", grid.sides(left.count(), right.count(), BLOCK_USERS, left.sparkSession.sparkContext.defaultParallelism), work, schema)


def user_based(p: DataFrame, users: DataFrame, n: int, days: int = 30, least: float = 30.0, halflife: float = 21.0, exclude_seen: bool = False) -> DataFrame:
    """Items of neighbours, weighted by similarity and their decayed plays."""
    r = p.where((F.col("age") <= days) & (F.col("listened") >= least)).groupBy("user_id", "item_id").agg(F.sum(F.pow(F.lit(0.5), F.col("age") / halflife)).alias("x"))
    near = user_neighbours(p, users, n, days, least, halflife)
    g = near.join(r, near["v"] == r["user_id"]).groupBy(F.col("u").alias("user_id"), "item_id").agg(F.sum(F.col("sim") * F.col("x")).alias("s"))
    return g.join(r.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti") if exclude_seen else g


def _listened_with(head: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each user of the left and each item, how many of the right share an item with the user and hold this one."""
    parts = [_sparse(b) for b in head]
    columns, most = np.unique(np.concatenate([p[2] for p in parts])), sum(len(p[0]) for p in parts)
    items_, sums = np.zeros(0, np.int64), [np.zeros((len(p[0]), 0)) for p in parts]

    def given() -> Iterator[pa.RecordBatch]:
        for own, s in zip(parts, sums, strict=True):
            for at in range(0, len(s), CHUNK):
                i, j = np.nonzero(s[at : at + CHUNK])
                if len(i):
                    yield pa.record_batch([pa.array(own[0][at + i]), pa.array(items_[j]), pa.array(s[at + i, j].astype(np.int64))], ["user_id", "item_id", "n"])

    for users, rows, items, ws in _tiles(rest, len(columns)):
        new = np.unique(items)
        if len(wider := np.union1d(items_, new)) > len(items_):
            if len(items_) and most * len(wider) > 4 * NUMBERS:  # partial sums are passed on
                yield from given()
                items_, wider, sums = items_[:0], new, [s[:, :0] for s in sums]
            grown = [np.zeros((len(s), len(wider))) for s in sums]
            for g, s in zip(grown, sums, strict=True):
                g[:, np.searchsorted(wider, items_)] = s
            items_, sums = wider, grown
        theirs, held = _dense(rows, items, ws, len(users), columns, np.float32).T, _dense(rows, items, ws, len(users), new, np.float32)
        to = np.searchsorted(items_, new)
        for own, s in zip(parts, sums, strict=True):
            step = max(16, min(CHUNK, NUMBERS // len(columns)))
            for at in range(0, len(own[0]), step):
                lo, hi = np.searchsorted(own[1], [at, at + step])
                mine = own[0][at : at + step]
                shared = _without_self(_dense(own[1][lo:hi] - at, own[2][lo:hi], own[3][lo:hi], len(mine), columns, np.float32) @ theirs, mine, users)
                s[at : at + step, to] += (shared > 0).astype(np.float32) @ held
    yield from given()


def co_listeners(p: DataFrame, users: DataFrame, days: int = 7) -> DataFrame:
    """How many of a user's co-listeners played each item; pairs of users are counted in the cells of a grid where they would be many rows."""
    scratch = Scratch(p.sparkSession, "co_listeners")
    r = scratch.write(p.where(F.col("age") <= days).select("user_id", "item_id").distinct(), "plays")
    if _dense_pays(r):
        rows = scratch.write(_rows_of_users(r.where("user_id is not null and item_id is not null").withColumn("x", F.lit(1.0)), "x"), "rows")
        sums = _met(rows.join(users, "user_id", "left_semi"), rows, _listened_with, "user_id long, item_id long, n long")
        return sums.groupBy("user_id", "item_id").agg(F.sum("n").alias("n"))
    a = r.join(users, "user_id", "left_semi").select(F.col("user_id").alias("u"), "item_id")
    pairs = a.join(r, "item_id").where("u != user_id").select("u", F.col("user_id").alias("v")).distinct()
    return pairs.join(r, pairs["v"] == r["user_id"]).groupBy(F.col("u").alias("user_id"), "item_id").agg(F.count("*").alias("n"))


def ppmi(p: DataFrame, days: int = 30, least: float = 30.0) -> DataFrame:
    """Positive pointwise mutual information of items sharing users."""
    r = incidence(p, days, least)
    a, b = r.select("user_id", F.col("item_id").alias("i")), r.select("user_id", F.col("item_id").alias("j"))
    co = a.join(b, "user_id").where("i != j").groupBy("i", "j").agg(F.count("*").alias("n"))
    marg = co.groupBy("i").agg(F.sum("n").alias("ni"))
    total = co.agg(F.sum("n").alias("t"))
    x = co.join(marg, "i").join(marg.select(F.col("i").alias("j"), F.col("ni").alias("nj")), "j").crossJoin(F.broadcast(total))
    return x.select("i", "j", F.greatest(F.log(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj"))), F.lit(0.0)).alias("ppmi")).where("ppmi > 0")


def affinity_graph(edges: DataFrame, gamma: float = 3.0) -> DataFrame:
    """Directed neighbours (src, dst, sim) to a symmetric graph of clipped, powered weights, normalised by degrees."""
    e = edges.select("src", "dst", F.pow(F.greatest("sim", F.lit(0.0)), F.lit(gamma)).alias("w"))
    sym = e.union(e.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    deg = sym.groupBy("src").agg(F.sum("w").alias("deg"))
    out = sym.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("deg2")), "dst")
    return out.select("src", "dst", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg2"))).alias("w")).where("w > 0")


def inject_edges(graph: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified edges of weight w in both directions, the larger weight wins."""
    v = verified.select("src", "dst", "w")
    return graph.union(v).union(v.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def diffuse(graph: DataFrame, start: DataFrame, alpha: float = 0.9, steps: int = 3) -> DataFrame:
    """Truncated series sum of alpha^k S^k start, for start of (query, node, x)."""
    total = cur = start
    for _ in range(steps):
        cur = cur.join(graph, cur["node"] == graph["src"]).groupBy("query", F.col("dst").alias("node")).agg((alpha * F.sum(F.col("x") * F.col("w"))).alias("x"))
        total = total.union(cur)
    return total.groupBy("query", "node").agg(F.sum("x").alias("x"))


def retrieval_scores(p: DataFrame, users: DataFrame, days: int = 30, n_seeds: int = 20, least: float = 30.0) -> DataFrame:
    """user_id, item_id, co, pop over all items, no pool: how often listeners of the user's seeds played the item, and its listeners.

    One item-item table of counts, cut to seeds on one side, serves all users.
    """
    r = incidence(p, days, least).select("user_id", "item_id", "age")
    s = seeds(r, users, n_seeds).select("user_id", "item_id")
    a = r.join(s.select("item_id").distinct(), "item_id", "left_semi").select("user_id", F.col("item_id").alias("i"))
    co = a.join(r.select("user_id", F.col("item_id").alias("j")), "user_id").groupBy("i", "j").agg(F.count("*").alias("co"))
    pop = r.groupBy(F.col("item_id").alias("j")).agg(F.count("*").alias("pop"))
    g = s.join(co, s["item_id"] == co["i"]).groupBy("user_id", "j").agg(F.sum("co").alias("co"))
    return g.join(pop, "j").select("user_id", F.col("j").alias("item_id"), "co", "pop")


def retrieve(scores: DataFrame, n: int, damp: float = 0.5) -> DataFrame:
    """The n best items of each user, damped on the item's side only."""
    from tessera.operators.ranking import top_k

    return top_k(scores.select("user_id", "item_id", (F.col("co") / F.pow(F.greatest("pop", F.lit(1)), F.lit(damp))).alias("s")), n)


def retrieval_recall(found: DataFrame, popular: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """Shares of the value of ``new`` that n popular items, n items of each user, and half of both cover. popular: item_id, rank from 1."""
    j = new.join(popular.select("item_id", F.col("rank").alias("g")), "item_id", "left").join(found.select("user_id", "item_id", F.col("rank").alias("u")), ["user_id", "item_id"], "left")
    share = lambda c: F.sum(F.when(c, F.col("frac")).otherwise(0.0)) / F.sum("frac")
    half = n // 2
    return j.agg(share(F.col("g") <= n).alias("popular"), share(F.col("u") <= n).alias("per_user"), share((F.col("g") <= half) | (F.col("u") <= half)).alias("mixed"))


def retrieval_sweep(scores: DataFrame, pool: DataFrame, history: DataFrame, truth: DataFrame, damps: list[float], slots: int) -> DataFrame:
    """Value found in the slots by each damping exponent, new items of the pool only: one table of counts, joined to the exponents."""
    spark = scores.sparkSession
    c = scores.join(pool.select("item_id"), "item_id", "left_semi").join(history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    c = c.crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in damps], "damp double"))).withColumn("s", F.col("co") / F.pow(F.greatest("pop", F.lit(1)), F.col("damp")))
    w = Window.partitionBy("damp", "user_id").orderBy(F.desc(F.round("s", 9)), "item_id")
    best = c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= slots)
    return best.join(truth, ["user_id", "item_id"], "left").groupBy("damp").agg(F.count("frac").alias("hits"), F.coalesce(F.sum("frac"), F.lit(0.0)).alias("value"))


def connectivity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Components of an undirected graph: how many, the largest, and single nodes. edges: src, dst; nodes: node."""
    from tessera.operators.components import components
    from tessera.runtime import Scratch

    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), Scratch(edges.sparkSession, "connectivity"))
    sizes = nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("single"))
