"""Toxicity from the nearest labelled examples.

Terms are words and their first 4, 5 and 6 bytes, so inflected forms share a term. Those that a log-likelihood test
ties to the toxic label are kept; texts are TF-IDF vectors over them, with document frequencies of the whole table.
An inverted index of the labelled examples keeps, for each term and block of examples, the largest weight: a block
whose bound can't reach the k-th best cosine so far is skipped, which leaves the k nearest exact. Their labels vote
with weights that fall with distance, and an isotonic fit on leave-one-out votes makes the vote a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm import textbytes
from tessera.llm.neardup import samples, sets_of, without
from tessera.runtime import Scratch

#: At most so many labelled rows are learnt from (by the hash of their ids).
EXAMPLES = 20_000
#: A term whose log-likelihood ratio is under LEAST_G2 weighs nothing.
NEIGHBOURS, BLOCK, LEAST_G2, THRESHOLD = 15, 64, 14.0, 0.3
KEYS = 6
_TRAILING = np.zeros(256, bool)
_TRAILING[list(b".,!?;:'\")")] = True
PREFIXES = (4, 5, 6)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _terms(w: textbytes.Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all terms of a chunk."""
    end = w.end.copy()
    for _ in range(3):
        end -= _TRAILING[w.data[end - 1]] & (end - 1 > w.begin) if len(end) else 0
    row = np.repeat(np.arange(len(w.starts) - 1), np.diff(w.starts))
    rows, hashes = [row], [textbytes.runs(w, w.begin, end, 1)]
    for n in PREFIXES:
        long = end - w.begin >= n
        rows.append(row[long])
        hashes.append(textbytes.runs(w, w.begin[long], w.begin[long] + n, 1 + n))
    return np.concatenate(rows), np.concatenate(hashes)


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, half, toxic documents, other documents) of each chunk; labels are 0 and 1, and 2 and 3 in the second half."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
        for w in textbytes.words(batch.column(0)):
            rows, terms = _terms(w)
            order = np.lexsort((rows, terms))
            rows, terms = rows[order], terms[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
            own = label[w.rows][rows[new]]
            found, at = np.unique(terms[new], return_inverse=True)
            n = np.bincount(4 * at + own, minlength=4 * len(found)).reshape(-1, 4)
            for half in (0, 1):
                some = n[:, 2 * half] + n[:, 2 * half + 1] > 0
                yield pa.record_batch([pa.array(found[some].view(np.int64)), pa.array(np.full(some.sum(), half, np.int32)), pa.array(n[some, 2 * half + 1]), pa.array(n[some, 2 * half])], ["term", "half", "n1", "n0"])


def _vectors(kept: np.ndarray):
    """(doc_id, positions of kept terms, their counts) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in textbytes.words(batch.column(1)):
                rows, terms = _terms(w)
                at = np.minimum(np.searchsorted(kept, terms), max(len(kept) - 1, 0))
                hit = kept[at] == terms if len(kept) else np.zeros(len(terms), bool)
                n = w.rows.stop - w.rows.start
                keys, counts = np.unique(rows[hit] * max(len(kept), 1) + at[hit], return_counts=True)
                offsets = pa.array(np.searchsorted(keys // max(len(kept), 1), np.arange(n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (keys % max(len(kept), 1), counts)]
                yield pa.record_batch([batch.column(0).slice(w.rows.start, n), *lists], ["doc_id", "terms", "counts"])

    return run


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, KEYS keys): texts that are near copies share one of them with high probability."""
    for batch in batches:
        for w in textbytes.words(batch.column(1)):
            keys = np.array([samples(s)[: 3 * KEYS] if len(s) else np.zeros(3 * KEYS, np.uint32) for s in sets_of(w, 5)]).astype(np.uint64).reshape(-1, KEYS, 3)
            keys = textbytes.mix(textbytes.mix(keys[:, :, 0] << np.uint64(32) | keys[:, :, 1]) + keys[:, :, 2])
            keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), KEYS).cast(pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0).slice(w.rows.start, len(keys)), keys], ["doc_id", "keys"])


def _thinned(rows: list) -> list[int]:
    """Ids, ascending, of those that share no key with an earlier one that is kept."""
    seen: list[set] = [set() for _ in range(KEYS)]
    kept = []
    for r in sorted(rows, key=lambda r: r.doc_id):
        if not any(k in s for k, s in zip(r["keys"], seen, strict=True)):
            kept.append(r.doc_id)
            for k, s in zip(r["keys"], seen, strict=True):
                s.add(k)
    return kept


class BlockMaxIndex:
    """Exact k nearest examples by cosine."""

    def __init__(self, ids, vectors: list[tuple[np.ndarray, np.ndarray]], labels, idf: np.ndarray):
        weighted = [self.weigh(t, c, idf) for t, c in vectors]
        order = sorted(range(len(ids)), key=lambda i: (vectors[i][0].tolist(), ids[i]))  # alike examples share blocks
        self.idf, self.ids = idf, np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], float)
        example = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        terms = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weights = np.concatenate([weighted[i] for i in order]) if order else np.zeros(0)
        by = np.lexsort((example, terms))
        self.posting, self.weight = example[by], weights[by]
        self.first = np.searchsorted(terms[by], np.arange(len(idf) + 1))
        self.blocks = -(-len(order) // BLOCK)
        self.bound = np.zeros((len(idf), self.blocks))
        np.maximum.at(self.bound, (terms[by], self.posting // BLOCK), self.weight)

    @staticmethod
    def weigh(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * idf[terms]
        return w / np.sqrt((w * w).sum())

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Examples (positions) and cosines, the best first, ties by position; ``skip`` is left out."""
        query = self.weigh(terms, counts, self.idf)
        bounds = query @ self.bound[terms]
        best: list[tuple[float, int]] = []
        spans = [(self.first[t], self.first[t + 1], q) for t, q in zip(terms, query, strict=True)]
        for block in np.argsort(-bounds, kind="stable"):
            # a bound equal to the k-th best may still hold a tie with a smaller position
            if bounds[block] <= 0 or len(best) == k and bounds[block] < best[-1][0] * -1 - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for lo, hi, q in spans:
                part = self.posting[lo:hi]
                a, b = lo + np.searchsorted(part, block * BLOCK), lo + np.searchsorted(part, (block + 1) * BLOCK)
                scores[self.posting[a:b] - block * BLOCK] += q * self.weight[a:b]
            found = [(-round(float(scores[i]), 12), int(block * BLOCK + i)) for i in np.flatnonzero(scores > 0)]
            best = sorted(best + [x for x in found if x[1] != skip])[:k]
        return np.array([i for _, i in best], int), np.array([-s for s, _ in best])

    def vote(self, at: np.ndarray, cosines: np.ndarray, prior: float) -> float:
        """Labels weighted by the inverse of distance; the prior counts as one example at distance 1."""
        weights = 1 / (0.05 + 1 - np.minimum(cosines, 1))
        lone = 1 / 1.05
        return float((weights @ self.labels[at] + lone * prior) / (weights.sum() + lone))


def isotonic(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares nondecreasing fit of labels to votes."""
    x, at = np.unique(votes, return_inverse=True)
    level = lambda s, n: (s + 0.01) / (n + 0.02)  # noqa: E731  never quite 0 or 1
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for v, s, n in zip(x, np.bincount(at, labels), np.bincount(at), strict=True):
        blocks.append([s, n, v, v])
        while len(blocks) > 1 and level(*blocks[-2][:2]) >= level(*blocks[-1][:2]):
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    return np.array([b[k] for b in blocks for k in (2, 3)]), np.repeat([level(*b[:2]) for b in blocks], 2)


class Model:
    """What scoring needs; its size is bounded by EXAMPLES."""

    def __init__(self, index: BlockMaxIndex | None, bare: float, knots: tuple[np.ndarray, np.ndarray]):
        self.index, self.bare, self.knots = index, bare, knots

    def score(self, terms: np.ndarray, counts: np.ndarray, skip: int | None = None) -> tuple[float, list[int]]:
        if self.index is None or not len(terms):
            return self.bare, []
        at, cosines = self.index.nearest(terms, counts, skip=skip)
        vote = self.index.vote(at, cosines, self.bare)
        return float(np.clip(np.interp(vote, *self.knots), 0, 1)) if len(self.knots[0]) else vote, self.index.ids[at].tolist()


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and doc_id, terms, counts of every row of docs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("label"))
    sample = scratch.write(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES), "sample")
    # near copies are one piece of evidence; EXAMPLES rows at most pass through the driver
    keys = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text").mapInArrow(_copy_keys, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, keys array<long>").collect()
    lone = spark.createDataFrame([(i,) for i in dict.fromkeys(_thinned(keys))], "doc_id long")
    chosen = texts.join(F.broadcast(sample.join(F.broadcast(lone), "doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"))
    chosen = scratch.write(chosen, "chosen")
    total = chosen.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    by_half = lambda h, x: F.sum(F.when(F.col("half") == h, F.col(x)).otherwise(0)).alias(f"{x}_{h}")
    counts = chosen.select("text", (F.col("label") + 2 * F.col("half")).alias("label")).mapInArrow(_label_counts, "term long, half int, n1 long, n0 long").groupBy("term").agg(*[by_half(h, x) for h in (0, 1) for x in ("n1", "n0")], F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    p, n = float(total.p or 0), float(total.n)
    kept = np.zeros(0, np.uint64)
    if 0 < p < n:
        both = F.col("n1") + F.col("n0")
        part = lambda x, share: F.when(x > 0, x * F.log(x / (both * share))).otherwise(0.0)
        # by chance alone a term seldom leans to the label in both halves of the examples
        told = lambda h: F.col(f"n1_{h}") * (n - p) > 3 * F.col(f"n0_{h}") * p
        g2 = 2 * (part(F.col("n1"), p / n) + part(F.col("n0"), 1 - p / n))
        # terms of EXAMPLES documents at most
        telling = counts.where(told(0) & told(1) & (F.col("n1") / p > F.col("n0") / (n - p))).withColumn("g2", g2).where(F.col("g2") >= LEAST_G2).select("term").collect()
        kept = np.sort(np.array([r.term for r in telling], np.int64).view(np.uint64))
    kind = texts.schema["doc_id"].dataType.simpleString()
    vectors = scratch.write(texts.mapInArrow(_vectors(kept), f"doc_id {kind}, terms array<int>, counts array<int>"), "vectors")
    if not len(kept):
        return Model(None, p / n if n else 0.0, (np.zeros(0), np.zeros(0))), vectors
    frequency = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row for each kept term
    idf = np.ones(len(kept))
    rows = vectors.count()
    for r in frequency:
        idf[r.t] = np.log(1 + rows / r["count"])
    got = vectors.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("terms", "counts", "label")).alias("x")).select("doc_id", "x.*")
    bare = got.where(F.size("terms") == 0).agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    bare = (float(bare.p or 0) + 0.01) / (bare.n + 1)
    found = sorted(got.where(F.size("terms") > 0).collect(), key=lambda r: r.doc_id)  # EXAMPLES rows at most
    index = BlockMaxIndex([r.doc_id for r in found], [(np.array(r.terms), np.array(r.counts)) for r in found], [r.label for r in found], idf)
    raw = Model(index, bare, (np.zeros(0), np.zeros(0)))
    place = {int(d): i for i, d in enumerate(index.ids)}
    if not found:
        return raw, vectors
    # every example is voted on without itself, on the executors
    each = spark.createDataFrame([(i, place[r.doc_id], r.terms, r.counts) for i, r in enumerate(found)], "i int, skip int, terms array<int>, counts array<int>")
    votes = np.zeros(len(found))
    for r in each.mapInArrow(_left_out(spark.sparkContext.broadcast(raw)), "i int, vote double").collect():
        votes[r.i] = r.vote
    knots = isotonic(votes, np.array([r.label for r in found]))
    return Model(index, bare, knots), vectors


def _left_out(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [shared.value.score(np.array(t, int), np.array(c, int), skip=k)[0] for k, t, c in zip(*[batch.column(j).to_pylist() for j in (1, 2, 3)], strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(votes, pa.float64())], ["i", "vote"])

    return run


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = shared.value, {}
        for batch in batches:
            scores, evidence = [], []
            for terms, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = (tuple(terms), tuple(counts))
                if key not in seen:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen[key] = model.score(np.array(terms, int), np.array(counts, int))
                scores.append(seen[key][0])
                evidence.append(seen[key][1])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    return run


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) for each row.

    Null and empty texts, and texts without a telling term, get the rate of label 1 among such examples; without
    labels of both kinds every score is the rate itself (0 for none). A null id is scored and isn't held out. Repeated
    rows get equal scores; an id with several texts is an example by the least of them; ties among examples go to the
    first by terms and id. Other columns aren't used.
    """
    model, vectors = fit(docs, labels, label_col, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = vectors.schema["doc_id"].dataType.simpleString()
    # the table of vectors has few files; scoring takes its time by row
    dealt = vectors.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = dealt.mapInArrow(_scored(shared), f"doc_id {kind}, score double, evidence array<long>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, **more) -> DataFrame:
    """The rows that score under the threshold, all columns as they are; rows with a null id stay."""
    bad = score(docs, labels, id_col=id_col, threshold=threshold, **more).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return without(docs, bad, id_col, Scratch(docs.sparkSession, "toxicity"))
