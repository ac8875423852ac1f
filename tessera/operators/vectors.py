"""Vector retrieval on (vec_id, v): normalising, whitening, exact neighbours, expansion, matching and hit rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import grid
from tessera.runtime import Scratch

#: Neighbours come from a broadcast matrix up to so many numbers, from a grid of both sides beyond.
BROADCAST_NUMBERS = 500_000
#: A block of queries holds about so many numbers.
BLOCK_NUMBERS = 4_000_000
#: Queries and gallery rows that are multiplied at a time, and pairs of them that are looked at once more.
CHUNK, TILE, SLICE = 512, 2_048, 32_768


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for each row; written into a lambda, it is computed for every element."""
    return F.transform(F.array(value), use)[0]


def l2(v: Column) -> Column:
    return once(v, lambda w: once(F.sqrt(dot(w, w)) + 1e-12, lambda n: F.transform(w, lambda x: x / n)))


def normalised(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("v", l2(F.col("v")))


def power_mean(tokens: Column, p: float = 3.0, eps: float = 1e-6) -> Column:
    """Generalised mean over an array of token vectors, per dimension."""
    powered = F.transform(tokens, lambda t: F.transform(t, lambda x: F.pow(F.greatest(x, F.lit(eps)), F.lit(p))))
    summed = F.aggregate(powered, F.transform(tokens[0], lambda _: F.lit(0.0)), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    return F.transform(summed, lambda x: F.pow(x / F.size(tokens), F.lit(1 / p)))


def blocks(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Join blocks by id, normalise each, weight and concatenate."""
    out = parts[0][0].select("vec_id", F.transform(l2(F.col("v")), _times(parts[0][1])).alias("v"))
    for df, weight in parts[1:]:
        nxt = df.select("vec_id", F.transform(l2(F.col("v")), _times(weight)).alias("_n"))
        out = out.join(nxt, "vec_id").select("vec_id", F.concat("v", "_n").alias("v"))
    return out


def _times(weight: float | Column):
    return lambda x: x * weight


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-12)


def _matrix(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit rows of a batch with vec_id and v."""
    ids = batch.column(batch.schema.get_field_index("vec_id"))
    ids = np.array(ids.to_pylist(), str) if pa.types.is_string(ids.type) else ids.to_numpy(zero_copy_only=False)
    return ids, _unit(batch.column(batch.schema.get_field_index("v")).flatten().to_numpy().reshape(len(ids), dims))


class _Nearest:
    """The k nearest of a block of queries among rows that come in tiles; memory is the block and a tile.

    Single precision, with a bound on its error, tells which pairs may be among the k; these are computed in double.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int, exclude_self: bool, digits: int):
        self.ids, self.rows, self.k, self.exclude_self, self.digits = ids, rows, k, exclude_self, digits
        self.short = rows.astype(np.float32)
        self.error = (rows.shape[1] + 8) * 2.0**-23 + 0.5 * 10.0**-digits
        self.sim, self.dst = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), ids.dtype)

    def feed(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for lo in range(0, len(ids), TILE):
            tile_ids, tile = ids[lo : lo + TILE], rows[lo : lo + TILE]
            short = tile.astype(np.float32).T
            for at in range(0, len(self.ids), CHUNK):
                self._tile(at, tile_ids, tile, self.short[at : at + CHUNK] @ short)

    def _tile(self, at: int, ids: np.ndarray, tile: np.ndarray, near: np.ndarray) -> None:
        k, most = self.k, min(self.k + 1, near.shape[1])
        may = near >= (self.sim[at : at + CHUNK, -1:] - self.error).astype(np.float32)
        if np.count_nonzero(may) > 4 * most * len(near):
            known = np.where(np.isnan(near), -np.inf, near)
            may &= near >= np.partition(known, near.shape[1] - most, axis=1)[:, [near.shape[1] - most]] - np.float32(2 * self.error)
        i, j = np.divmod(np.flatnonzero(may), near.shape[1])
        if not len(i):
            return
        i += at
        sim = np.concatenate([np.einsum("ij,ij->i", self.rows[i[s : s + SLICE]], tile[j[s : s + SLICE]]) for s in range(0, len(i), SLICE)]).round(self.digits)
        dst, last = ids[j], self.sim[i, -1]
        keep = (sim > last) | ((sim == last) & (dst < self.dst[i, -1]))
        if self.exclude_self:
            keep &= dst != self.ids[i]
        i, sim, dst = i[keep], sim[keep], dst[keep]
        if not len(i):
            return
        touched = np.unique(i)
        i, sim, dst = np.concatenate([i, np.repeat(touched, k)]), np.concatenate([sim, self.sim[touched].ravel()]), np.concatenate([dst, self.dst[touched].ravel()])
        order = np.lexsort((dst, -sim, i))
        i = i[order]
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
        self.dst = self.dst.astype(np.promote_types(self.dst.dtype, dst.dtype), copy=False)  # texts may be longer
        self.sim[touched], self.dst[touched] = sim[order].reshape(-1, k), dst[order].reshape(-1, k)

    def found(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), 8192):
            sim = self.sim[at : at + 8192].ravel()
            there = np.isfinite(sim)
            src, dst = np.repeat(self.ids[at : at + 8192], self.k)[there], self.dst[at : at + 8192].ravel()[there]
            yield pa.record_batch([pa.array(src.tolist(), kind), pa.array(dst.tolist(), kind), pa.array(sim[there])], ["src", "dst", "sim"])


def neighbours(queries: DataFrame, gallery: DataFrame, k: int, exclude_self: bool = True, digits: int = 6) -> DataFrame:
    """src, dst, sim, rank: the exact k nearest by cosine, ties (at ``digits``) by id; a written table, so it is found once.

    A gallery that a count proves small is one broadcast matrix; a larger one meets the queries in the cells of a grid,
    each of which holds a block of queries, streams its share of the gallery and keeps k for each query.
    """
    spark, kind = queries.sparkSession, gallery.schema["vec_id"].dataType.simpleString()
    scratch = Scratch(spark, "neighbours")
    first = gallery.select("v").first() or queries.select("v").first()
    dims = len(first.v) if first else 1
    q, g = (x.select(F.col("vec_id").cast(kind).alias("vec_id"), F.col("v").cast("array<double>").alias("v")) for x in (queries, gallery))
    rows, schema = gallery.count(), f"src {kind}, dst {kind}, sim double"
    if rows * dims <= BROADCAST_NUMBERS:
        held = [_matrix(b, dims) for b in g.toArrow().to_batches()]  # so many numbers at most
        shared = spark.sparkContext.broadcast((held, dims))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tiles, dims = shared.value
            for b in batches:
                if b.num_rows:
                    best = _Nearest(*_matrix(b, dims), k, exclude_self, digits)
                    for tile in tiles:
                        best.feed(*tile)
                    yield from best.found(b.schema.field(0).type)

        found = q.mapInArrow(near, schema)
    else:

        def cell(head: list[pa.RecordBatch], rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, own = zip(*[_matrix(b, dims) for b in head])
            best = _Nearest(np.concatenate(ids), np.concatenate(own), k, exclude_self, digits)
            for b in rest:
                best.feed(*_matrix(b, dims))
            yield from best.found(head[0].schema.field(0).type)

        found = grid.meet(q, g, "vec_id", grid.sides(queries.count(), rows, BLOCK_NUMBERS // dims, spark.sparkContext.defaultParallelism), cell, schema)
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return scratch.write(found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k), "near")


def hit_rates(near: DataFrame, labels: DataFrame, ks: tuple = (1, 3, 10)) -> DataFrame:
    """Share of queries with a neighbour of their own label among the first k, and the mean and median first rank."""
    j = near.join(labels.select(F.col("vec_id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("vec_id").alias("dst"), F.col("label").alias("b")), "dst")
    first = j.groupBy("src").agg(F.min(F.when(F.col("a") == F.col("b"), F.col("rank"))).alias("r"))
    return first.agg(*[F.avg((F.coalesce("r", F.lit(1 << 30)) <= k).cast("double")).alias(f"hit_{k}") for k in ks], F.avg(F.col("r").cast("double")).alias("mean_rank"), F.percentile("r", 0.5).alias("median_rank"))


def expand(queries: DataFrame, near: DataFrame, gallery: DataFrame, alpha: float = 3.0) -> DataFrame:
    """alpha query expansion: the query plus its neighbours weighted by sim^alpha, normalised. Vectors stay whole: a row for each neighbour."""
    g = gallery.select(F.col("vec_id").alias("dst"), l2(F.col("v")).alias("v"))
    weight = F.pow(F.greatest("sim", F.lit(0.0)), F.lit(alpha))
    parts = near.join(g, "dst").select(F.col("src").alias("vec_id"), "dst", once(weight, lambda w: F.transform("v", _times(w))).alias("v"))
    own = queries.select("vec_id", F.lit(None).cast(parts.schema["dst"].dataType).alias("dst"), l2(F.col("v")).alias("v"))
    every = own.union(parts).where(F.size("v") > 0).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("dst", "v"))).alias("every"))  # the query comes first
    add = lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x + y)
    summed = F.aggregate(F.slice("every", F.lit(2), F.size("every")), F.col("every")[0]["v"], lambda s, x: F.zip_with(s, x["v"], add))
    return every.select("vec_id", l2(summed).alias("v"))


def averaged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Normalised mean of two normalised views."""
    j = a.select("vec_id", l2(F.col("v")).alias("x")).join(b.select("vec_id", l2(F.col("v")).alias("y")), "vec_id")
    return j.select("vec_id", l2(F.zip_with("x", "y", lambda x, y: x + y)).alias("v"))


def mutual(ab: DataFrame, ba: DataFrame) -> DataFrame:
    """Pairs that are each other's nearest, from two tables of neighbours."""
    f, b = ab.where("rank = 1"), ba.where("rank = 1").select(F.col("src").alias("dst"), F.col("dst").alias("_back"))
    return f.join(b, "dst").where("_back = src").select("src", "dst", "sim")


def bake(queries: DataFrame, pairs: DataFrame, gallery: DataFrame, weight: float, least: float) -> DataFrame:
    """q becomes l2(q + weight g) for mutual pairs above a similarity; other queries stay."""
    p = pairs.where(F.col("sim") >= least).join(gallery.select(F.col("vec_id").alias("dst"), l2(F.col("v")).alias("g")), "dst").select(F.col("src").alias("vec_id"), "g")
    j = queries.join(p, "vec_id", "left")
    return j.select("vec_id", F.when(F.col("g").isNull(), l2(F.col("v"))).otherwise(l2(F.zip_with(l2(F.col("v")), F.col("g"), lambda x, y: x + weight * y))).alias("v"))


def orient(views: DataFrame, margin: float, strict: bool = True) -> DataFrame:
    """(vec_id, view, sim): the best view if it gains the margin over view 0, else view 0."""
    best = views.groupBy("vec_id").agg(F.max(F.struct(F.round("sim", 9).alias("s"), (-F.col("view")).alias("nv"))).alias("b"), F.max(F.when(F.col("view") == 0, F.round("sim", 9))).alias("base"))
    gain = F.col("b.s") - F.col("base")
    return best.select("vec_id", F.when(gain > margin if strict else gain >= margin, -F.col("b.nv")).otherwise(0).alias("view"))


def contested(near: DataFrame, top_n: int) -> DataFrame:
    """Queries among the most confident that claim one target: the best keeps it, others go to their best unclaimed one."""
    first = near.where("rank = 1")
    sure = first.orderBy(F.desc("sim"), "src").limit(top_n)
    w = Window.partitionBy("dst").orderBy(F.desc("sim"), "src")
    claims = sure.withColumn("_r", F.row_number().over(w))
    losers = claims.where("_r > 1").select("src", F.col("dst").alias("lost"))
    free = near.join(losers, "src").join(claims.select("dst").distinct(), "dst", "left_anti").where("sim > 0")
    w = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return free.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("src", "lost", "dst", "sim")


def sinkhorn(sims: DataFrame, iterations: int = 30, temperature: float = 0.05, every: int = 6) -> DataFrame:
    """(src, dst, sim) to each src's best dst after alternating normalisation; plans are cut every few rounds."""
    scratch = Scratch(sims.sparkSession, "sinkhorn")
    top = sims.groupBy("src").agg(F.max("sim").alias("top"))
    p = sims.join(top, "src").select("src", "dst", F.exp((F.col("sim") - F.col("top")) / temperature).alias("p"))
    for i in range(iterations):
        p = p.withColumn("p", F.col("p") / (F.sum("p").over(Window.partitionBy("src")) + 1e-9))
        p = p.withColumn("p", F.col("p") / (F.sum("p").over(Window.partitionBy("dst")) + 1e-9))
        if i % every == every - 1:
            p = scratch.write(p, "p")
    w = Window.partitionBy("src").orderBy(F.desc(F.round("p", 9)), "dst")
    return p.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("src", "dst")


class Whitening:
    """Mean, basis and scale of a set of vectors; the D x D moments are sums, only they reach the driver."""

    def __init__(self, vectors: DataFrame, keep: int | None = None, alpha: float = 0.5, eps: float = 1e-6):
        def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, s, c = 0, 0.0, 0.0
            for b in batches:
                if len(b):
                    x = np.stack(b.v.to_numpy())
                    n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
            if n:
                yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

        rows = vectors.select("v").mapInPandas(moments, "n long, s array<double>, c array<double>").collect()  # a row for each partition
        n = sum(r.n for r in rows)
        self.mean = sum(np.array(r.s) for r in rows) / n
        d = len(self.mean)
        cov = sum(np.array(r.c) for r in rows).reshape(d, d) / n - np.outer(self.mean, self.mean)
        values, basis = np.linalg.eigh(cov)
        order = np.argsort(-values)[:keep]
        self.matrix = basis[:, order] / np.power(np.maximum(values[order], 0) + eps, alpha)

    def apply(self, vectors: DataFrame) -> DataFrame:
        mean, matrix = self.mean, self.matrix

        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    y = (np.stack(b.v.to_numpy()) - mean) @ matrix
                    y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-12
                    yield pd.DataFrame({"vec_id": b.vec_id, "v": y.tolist()})

        return vectors.select("vec_id", "v").mapInPandas(project, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<double>")


def residuals(locals_: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, v) local descriptors to one vector each: residual sums at nearest centroids, signed roots, normalised."""
    j = locals_.crossJoin(F.broadcast(centroids.select("c", F.col("v").alias("m"))))  # a codebook of fixed size
    apart = F.aggregate(F.zip_with("v", "m", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    near = j.withColumn("_d", F.round(apart, 9)).groupBy("vec_id", "part").agg(F.min(F.struct("_d", "c", F.zip_with("v", "m", lambda x, y: x - y).alias("r"))).alias("b"))
    flat = near.select("vec_id", F.col("b.c").alias("c"), F.posexplode("b.r").alias("i", "x")).groupBy("vec_id", "c", "i").agg(F.sum("x").alias("x"))
    return flat.select("vec_id", "c", "i", (F.signum("x") * F.sqrt(F.abs("x"))).alias("x"))


def all_finite(vectors: DataFrame) -> DataFrame:
    bad = F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    return vectors.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))


def changed(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """How many queries changed their first neighbour between two tables, and the mean overlap of the first k."""
    both = a.where("rank = 1").select("src", F.col("dst").alias("x")).join(b.where("rank = 1").select("src", F.col("dst").alias("y")), "src")
    first = both.agg(F.count("*").alias("n"), F.count_if(F.col("x") != F.col("y")).alias("moved"))
    shared = a.where(F.col("rank") <= k).select("src", "dst").join(b.where(F.col("rank") <= k).select("src", "dst"), ["src", "dst"]).agg(F.count("*").alias("shared"))
    return first.crossJoin(shared)


def bake_disagreeing(queries: DataFrame, verified: DataFrame, near: DataFrame, gallery: DataFrame, weight: float, least: int) -> DataFrame:
    """Bake only pairs that are verified well enough and aren't the query's own first neighbour. verified: src, dst, n."""
    first = near.where("rank = 1").select("src", F.col("dst").alias("_own"))
    pairs = verified.where(F.col("n") >= least).join(first, "src", "left").where(~F.col("dst").eqNullSafe(F.col("_own"))).select("src", "dst", F.lit(1.0).alias("sim"))
    return bake(queries, pairs, gallery, weight, 0.0)


def margin_sweep(views: DataFrame, margins: list[float]) -> DataFrame:
    """For each margin, how many vectors another view turns, and their mean gain. views: vec_id, view, sim."""
    g = views.groupBy("vec_id").agg((F.max(F.when(F.col("view") != 0, F.col("sim"))) - F.max(F.when(F.col("view") == 0, F.col("sim")))).alias("gain"))
    m = F.broadcast(views.sparkSession.createDataFrame([(float(x),) for x in margins], "margin double"))
    return m.join(g, F.col("gain") > F.col("margin"), "left").groupBy("margin").agg(F.count("gain").alias("turned"), F.avg("gain").alias("mean_gain"))
