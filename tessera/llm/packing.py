"""Packing along a space-filling curve.

Each document's token counts are hashed into a vector, the vector is projected to a few dimensions, and the
Hilbert index of the quantised point is its key. Documents are range-partitioned and sorted by (key, doc_id),
so neighbours on the curve share sequences. Every partition is one stream cut at ``length`` tokens; what is left
at its end is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import tokens
from tessera.runtime import Scratch

LENGTH = 4096
#: Ids of a partition: so many bytes at most, and as few as this where the cluster has the tasks for it.
PART_BYTES, LEAST_BYTES = 64 << 20, 6 << 20
DIMENSIONS, BITS, BUCKETS = 4, 10, 64


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n x d) with ``bits`` bits each.

    The coordinates are made the curve's transposed index from the top bit down: where a bit is set, the low
    bits of the first axis are inverted, else they are swapped with that axis; a Gray decoding ends it.
    """
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for k in range(len(x)):
            high = (x[k] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ flip) >> level) & 1
    return key


def _projection() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id its bucket and sign, and the matrix from buckets to dimensions."""
    rng = np.random.default_rng(811)
    return rng.integers(0, BUCKETS, 1 << 16), rng.choice([-1.0, 1.0], 1 << 16), rng.normal(size=(BUCKETS, DIMENSIONS))


_BUCKET, _SIGN, _PROJECT = _projection()


def curve_keys(ids: list[bytes]) -> np.ndarray:
    """Hilbert key of each document's hashed, damped and normalised token counts."""
    counts = np.array([len(x) // 2 for x in ids])
    flat = np.frombuffer(b"".join(ids), "<u2")
    doc = np.repeat(np.arange(len(ids)), counts)
    vectors = np.bincount(doc * BUCKETS + _BUCKET[flat], _SIGN[flat], len(ids) * BUCKETS).reshape(-1, BUCKETS)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    spread = 1 / (1 + np.exp(-1.702 * (vectors @ _PROJECT)))  # coordinates are about normal: near uniform after this
    return hilbert_key(np.minimum(spread * (1 << BITS), (1 << BITS) - 1).astype(np.int64), BITS)


def _tokenised(path: str | None, cache: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.trim()
        encoder = tokens.encoder(path, cache)
        end = np.array([tokens.SEPARATOR], "<u2").tobytes()
        for batch in batches:
            ids_column = batch.column(0)
            for first, texts in tokens.chunks(batch.column(1).to_pylist()):
                ids = encoder.encode(texts)
                keys = curve_keys(ids)
                ids = [x + end for x in ids]
                yield pa.record_batch([ids_column.slice(first, len(ids)), pa.array(keys), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "curve_key", "doc_tokens", "ids"])

    return run


def tokenise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, cache: int = tokens.CACHE) -> DataFrame:
    """doc_id, curve_key, doc_tokens, ids (16-bit little-endian, the separator last); a null text is empty."""
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(_tokenised(tokenizer, cache), f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, curve_key long, doc_tokens long, ids binary")


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _packed(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens.forget()  # this worker may have tokenised before
        base = TaskContext.get().partitionId() << 32
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids]
        done, open_pieces, fill = 0, [], 0

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            types = [id_type, *[pa.int64()] * 6, pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols[: len(names)], types, strict=False)], names)

        def piece(doc, start, ids, total, sequence, offset):
            return (doc, start, len(ids) // 2, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()), total, base + sequence, offset, ids)

        id_type = pa.int64()
        for batch in batches:
            id_type, out = batch.schema.field(0).type, []
            for doc, total, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                start = 0
                while start < total:
                    take = min(length - fill, total - start)
                    open_pieces.append((doc, start, ids[2 * start : 2 * (start + take)], total, fill))
                    start, fill = start + take, fill + take
                    if fill == length:
                        out += [piece(d, s, x, t, done, o) for d, s, x, t, o in open_pieces]
                        done, open_pieces, fill = done + 1, [], 0
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)
        if fill:  # the rest of the stream: sequences of a power of two each
            out, at, cuts = [], 0, _powers(fill)
            room = cuts[at]
            for doc, start, ids, total, _ in open_pieces:
                while ids:
                    x, ids = ids[: 2 * room], ids[2 * room :]
                    out.append(piece(doc, start, x, total, done, cuts[at] - room))
                    start, room = start + len(x) // 2, room - len(x) // 2
                    if not room:
                        done, at = done + 1, at + 1
                        room = cuts[at] if at < len(cuts) else 0
            yield batch_of(out)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = True, cache: int = tokens.CACHE) -> DataFrame:
    """One row for each piece of a document in a sequence of at most ``length`` tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (16-bit little-endian bytes).
    A null or empty text is the separator alone; repeated rows are packed once each; a null id stays null;
    other columns aren't used, whatever their names; an empty table gives no rows. Texts of any length are cut
    freely. Sequences shorter than ``length`` have a power of two of tokens, so none needs padding.
    """
    spark = docs.sparkSession
    held = Scratch(spark, "packing").write(tokenise(docs, id_col, text_col, tokenizer, cache), "tokens")
    size = 2 * (held.agg(F.sum("doc_tokens")).first()[0] or 0)
    parts = max(1, -(-size // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES)))
    ordered = held.repartitionByRange(parts, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")
    kind = held.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return ordered.select("doc_id", "doc_tokens", "ids").mapInArrow(_packed(length, with_ids), schema)
