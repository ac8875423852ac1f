"""Quality from random-indexing word vectors and a small network.

Words, and their shapes (case, digits, closing signs, whether a word repeats the one before), are hashed to a fixed
number of entries. Each entry has a sparse ternary index vector; its context vector is the sum of its neighbours'
index vectors over the whole table. A text is the mean and the spread of its words' context vectors and the mean of
its shapes'. A two-layer network turns that into a score, and a temperature fitted on rows it wasn't trained on
makes the score a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import textbytes
from tessera.llm.toxicity import held_out
from tessera.runtime import Scratch

#: Entries for words and for shapes, length of vectors, and the most labelled rows that are learnt from (by hashed id).
WORDS, SHAPES, SIZE, EXAMPLES = 31_744, 1024, 32, 20_000
HIDDEN, EPOCHS, THRESHOLD = 24, 60, 0.7
_SLABS = 16


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(1729)
    vectors = np.zeros((WORDS + SHAPES, SIZE), np.float32)
    places = np.argsort(rng.random(vectors.shape), axis=1)[:, :4]
    np.put_along_axis(vectors, places, rng.choice(np.array([-1, 1], np.float32), places.shape), axis=1)
    return vectors


_INDEX = _index_vectors()
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 0 sign
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3


def entries(w: textbytes.Words) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each word of a chunk and of its shape."""
    kinds = _CLASS[w.data]
    below = [np.concatenate([[0], np.cumsum(kinds == k)]) for k in (1, 2, 3)]
    upper, lower, digit = (b[w.end] - b[w.begin] for b in below)
    last = w.data[w.end - 1] * (kinds[w.end - 1] == 0) if len(w.end) else np.zeros(0, np.uint8)
    before = w.data[w.end - 2] * (kinds[w.end - 2] == 0) * (w.end - w.begin > 1) if len(w.end) else last
    same = np.zeros(len(w.hashes), bool)
    same[1:] = w.hashes[1:] == w.hashes[:-1]
    same[w.starts[:-1][w.starts[:-1] < len(same)]] = False
    packed = np.minimum(upper, 2) + 3 * (lower > 0) + 6 * (digit > 0) + 12 * same + 24 * last.astype(np.int64) + 24 * 256 * before.astype(np.int64)
    shapes = textbytes.mix(packed.astype(np.uint64) + np.uint64(77)) % np.uint64(SHAPES)
    return (w.hashes % np.uint64(WORDS)).astype(np.int64), shapes.astype(np.int64) + WORDS


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's sums of neighbours' index vectors, in slabs of entries."""
    total, held, size = np.zeros((SIZE, WORDS + SHAPES)), [], 0

    def add() -> None:
        at = np.concatenate([e for e, _ in held])
        near = np.concatenate([v for _, v in held])
        for d in range(SIZE):
            total[d] += np.bincount(at, near[:, d], WORDS + SHAPES)

    for batch in batches:
        for w in textbytes.words(batch.column(0)):
            if len(w.hashes) < 2:
                continue
            words, shapes = entries(w)
            vectors = _INDEX[words] + _INDEX[shapes]
            near = np.zeros_like(vectors)
            inside = np.ones(len(words) - 1, bool)
            firsts = w.starts[1:-1]
            inside[firsts[(firsts > 0) & (firsts < len(words))] - 1] = False
            near[1:] += vectors[:-1] * inside[:, None]
            near[:-1] += vectors[1:] * inside[:, None]
            held += [(words, near), (shapes, near)]
            size += len(words)
            if size > 1 << 18:
                add()
                held, size = [], 0
    if held:
        add()
    if total.any():
        slabs = [np.ascontiguousarray(x).tobytes() for x in np.split(total.T.astype("<f4"), _SLABS)]
        yield pa.record_batch([pa.array(range(_SLABS), pa.int32()), pa.array(slabs, pa.binary())], ["slab", "sums"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[slab] = sums.get(slab, 0) + np.frombuffer(x, "<f4").astype(float)
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slab", "sums"])


def context_vectors(texts: DataFrame) -> np.ndarray:
    """Normalised context vectors of all entries, from every text; a table of fixed size."""
    parts = texts.mapInArrow(_contexts, "slab int, sums binary").repartition(_SLABS, "slab").mapInArrow(_summed, "slab int, sums binary")
    vectors = np.zeros((WORDS + SHAPES, SIZE))
    rows = (WORDS + SHAPES) // _SLABS
    for r in parts.collect():
        vectors[r.slab * rows : (r.slab + 1) * rows] += np.frombuffer(bytes(r.sums)).reshape(rows, SIZE)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return np.round(vectors, 5).astype(np.float32)  # sums in another order differ in later digits


def pooled(w: textbytes.Words, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread over words and mean over shapes, for each row of a chunk; zeros for a row without words."""
    words, shapes = entries(w)
    rows = len(w.starts) - 1
    out = np.zeros((rows, 3 * SIZE))
    full = np.flatnonzero(np.diff(w.starts) > 0)
    if len(full):
        at, n = w.starts[full], np.diff(w.starts)[full][:, None]
        v = vectors[words]
        mean = np.add.reduceat(v, at, axis=0, dtype=float) / n
        square = np.add.reduceat(v * v, at, axis=0, dtype=float) / n
        out[full] = np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.add.reduceat(vectors[shapes], at, axis=0, dtype=float) / n])
    return out


class Network:
    """Standardisation, two layers and a temperature."""

    def __init__(self, inputs: int):
        rng = np.random.default_rng(5)
        self.mean, self.scale, self.temperature = np.zeros(inputs), np.ones(inputs), 1.0
        self.weights = [rng.normal(size=(inputs, HIDDEN)) / np.sqrt(inputs), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b) @ c + d[0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the cross-entropy of four fifths of the rows; the temperature minimises it on the rest."""
        rng = np.random.default_rng(6)
        order = rng.permutation(len(x))
        rest, train = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[train].mean(0), x[train].std(0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.weights]
        step, size = 0, 256
        for epoch in range(EPOCHS):
            rate = 0.01 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            for i in range(0, len(train), size):
                part = rng.choice(train, min(size, len(train)), replace=False)
                a, b, c, d = self.weights
                h = np.tanh(z[part] @ a + b)
                error = (1 / (1 + np.exp(-np.clip(h @ c + d[0], -30, 30))) - y[part]) / len(part)
                back = np.outer(error, c) * (1 - h * h)
                step += 1
                for p, g, (m, v) in zip(self.weights, (z[part].T @ back + 1e-4 * a, back.sum(0), h.T @ error, error.sum(keepdims=True)), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        held = self.logits(x[rest]) if len(rest) else np.zeros(0)
        loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[rest] > 0, 1, -1) * held / t))
        self.temperature = min(np.geomspace(0.5, 20, 75), key=loss) if len(rest) else 1.0
        return self


def _pool(vectors_shared, network_shared=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = vectors_shared.value
        for batch in batches:
            for w in textbytes.words(batch.column(1)):
                x = pooled(w, vectors)
                ids = batch.column(0).slice(w.rows.start, len(x))
                if network_shared is None:
                    yield pa.record_batch([ids, pa.array([r.tobytes() for r in x], pa.binary())], ["key", "x"])
                else:
                    yield pa.record_batch([ids, pa.array(np.round(network_shared.value.predict(x), 9))], ["key", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row.

    Null and empty texts share one score, that of a zero vector. With labels of one kind only every score is their
    mean; without labels it is 1. A null id is scored and isn't held out; repeated rows get equal scores; other
    columns aren't used.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("label"))
    sample = scratch.write(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES), "sample")
    vectors = spark.sparkContext.broadcast(context_vectors(texts.select("text")))
    # EXAMPLES rows at most, of 3 * SIZE numbers; repeated ids are one example
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    got = rows.select(F.col("label").alias("key"), "text").mapInArrow(_pool(vectors), "key double, x binary").collect()
    got.sort(key=lambda r: (r.key, bytes(r.x)))
    y = np.array([r.key for r in got])
    kind = texts.schema["doc_id"].dataType.simpleString()
    if len(y) and 0 < y.mean() < 1:
        network = spark.sparkContext.broadcast(Network(3 * SIZE).fit(np.array([np.frombuffer(bytes(r.x)) for r in got]), y))
        out = texts.mapInArrow(_pool(vectors, network), f"key {kind}, score double").withColumnRenamed("key", "doc_id")
    else:
        out = texts.select("doc_id", F.lit(float(y.mean()) if len(y) else 1.0).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
