"""Training-order materialisation.

All texts, by ascending document id, are one token stream, cut into sequences of fixed length and numbered in order,
whatever partitions the table or the cluster has; a keyed Feistel permutation, walked until it falls inside the number
of sequences, sends each number to its own slot. A shard is one task: it holds ``per_shard`` slots in order, slot s at
(s % per_shard) * stride, so training reads shards from end to end and resumes at any slot by arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import tokens
from tessera.llm.names import need_whole_ids
from tessera.runtime import Scratch, stored_bytes

#: A range of ids is about so many stored bytes.
RANGE_BYTES = 32 << 20

LENGTH, PER_SHARD, ROUNDS, PAD = 2048, 4096, 4, 0


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1: a Feistel network on the least even number of bits, with cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        with np.errstate(over="ignore"):
            for k in keys:
                f = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return left << np.uint64(half) | right

    out = once(np.asarray(x, np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _placed(length: int, path: str | None):
    """Sorted (doc_id, text) to (part, at, doc_id, ids): runs of up to ``length`` ids and their places in the partition's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        end = np.array([tokens.SEPARATOR], "<u2").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, texts in tokens.chunks(batch.column(1).to_pylist()):
                owner, places, pieces = [], [], []
                for doc, ids in zip(docs[first:], tokens.encoder(path).encode(texts), strict=False):
                    ids += end
                    for k in range(0, len(ids), 2 * length):
                        pieces.append(ids[k : k + 2 * length])
                        owner.append(doc)
                        places.append(at)
                        at += len(pieces[-1]) // 2
                yield pa.record_batch([pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(owner, pa.int64()), pa.array(pieces, pa.binary())], ["part", "at", "doc_id", "ids"])

    return run


def stream(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None) -> tuple[DataFrame, dict[int, int], int]:
    """(part, at, doc_id, ids), where each part's stream begins, and the number of all ids.

    Rows go by ascending id, null ids first, those of one id by the hash of their texts; a null text is empty, and so
    its separator alone. A number for each range of ids passes through the driver. Ids are whole numbers.
    """
    need_whole_ids(docs, id_col)
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(stored_bytes(docs.select(id_col, text_col)) or 0) // RANGE_BYTES))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = picked.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    placed = scratch.write(ranged.mapInArrow(_placed(length, tokenizer), "part int, at long, doc_id long, ids binary"), "stream")
    sizes = placed.groupBy("part").agg(F.sum(F.octet_length("ids")).alias("n")).collect()
    base, at = {}, 0
    for r in sorted(sizes):
        base[r.part], at = at, at + r.n // 2
    return placed, base, at


def _pieces(base: dict[int, int], n: int, key: int, length: int):
    """Runs of ids to pieces of sequences: (slot, sequence_id, offset, doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset, owner, pieces = [], [], [], []
            for part, at, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, place = divmod(base[part] + at, length)
                room = 2 * (length - place)
                for x, k, o in ((ids[:room], number, place), (ids[room:], number + 1, 0)):
                    if x:
                        sequence.append(k)
                        offset.append(o)
                        owner.append(doc)
                        pieces.append(x)
            if sequence:
                slots = permute(np.array(sequence), n, key)
                yield pa.record_batch([pa.array(slots), pa.array(sequence, pa.int64()), pa.array(offset, pa.int32()), pa.array(owner, pa.int64()), pa.array(pieces, pa.binary())], ["slot", "sequence_id", "offset", "doc_id", "ids"])

    return run


def _local(folder: str) -> str | None:
    parsed = urlparse(folder)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def _filesystem(folder: str):
    from pyarrow import fs

    return (fs.LocalFileSystem(), _local(folder)) if _local(folder) else fs.FileSystem.from_uri(folder)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _written(folder: str, length: int, per_shard: int):
    """Pieces sorted by (slot, offset), a shard to a task: writes it under a name of this attempt and renames it, so a repeated task leaves the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        filesystem, root = _filesystem(folder)
        filesystem.create_dir(root, recursive=True)
        stream, shard, temporary, held, rows = None, None, "", [], []

        def finish() -> None:
            """The held pieces are one sequence."""
            nonlocal stream, shard, temporary
            slot, number, _, first, _ = held[0]
            plain = b"".join(x for *_, x in held)
            size = len(plain) // 2
            plain += np.full(length - size, PAD, "<u2").tobytes()
            if slot // per_shard != shard:
                close()
                shard = slot // per_shard
                temporary = f"{root}/.{shard_name(shard)}-{TaskContext.get().taskAttemptId()}"
                stream = filesystem.open_output_stream(temporary)
            stream.write(plain)
            rows.append((slot, number, first, len(held), size, shard, slot % per_shard * 2 * length, zlib.crc32(plain)))
            held.clear()

        def close() -> None:
            if stream is not None:
                stream.close()
                filesystem.move(temporary, f"{root}/{shard_name(shard)}")

        def manifest() -> pa.RecordBatch:
            names = ["slot", "sequence_id", "first_doc", "n_pieces", "n_tokens", "shard", "byte_offset", "crc32"]
            out = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != piece[0]:
                    finish()
                held.append(piece)
            if rows:
                yield manifest()
        if held:
            finish()
        close()
        if rows:
            yield manifest()

    return run


def materialise(placed: DataFrame, base: dict[int, int], total: int, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 20_240_501) -> DataFrame:
    """Writes the shards and returns the manifest: slot, sequence_id, first_doc, n_pieces, n_tokens, shard, byte_offset, crc32.

    Slots are dense, so all files but the last are full; only the last sequence is padded.
    """
    n = -(-total // length)
    pieces = placed.mapInArrow(_pieces(base, n, key, length), "slot long, sequence_id long, offset int, doc_id long, ids binary")
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    dealt = pieces.repartitionById(max(1, -(-n // per_shard)), shard).sortWithinPartitions("slot", "offset")
    return dealt.mapInArrow(_written(folder, length, per_shard), "slot long, sequence_id long, first_doc long, n_pieces long, n_tokens long, shard long, byte_offset long, crc32 long")


def read_slots(folder: str, start: int, stop: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> np.ndarray:
    """Sequences of slots start..stop-1, by arithmetic on the shards alone."""
    filesystem, root = _filesystem(folder)
    out = []
    while start < stop:
        shard, within = divmod(start, per_shard)
        take = min(stop - start, per_shard - within)
        with filesystem.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(within * 2 * length)
            out.append(np.frombuffer(f.read(take * 2 * length), "<u2").reshape(-1, length))
        start += take
    return np.concatenate(out) if out else np.zeros((0, length), "<u2")


def order(docs: DataFrame, folder: str | None = None, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 20_240_501, **more) -> DataFrame:
    """Tokenise, cut, permute and write; the manifest, which depends on the texts, ids and parameters alone.

    Null and repeated ids are passed on; an empty table gives no rows; other columns aren't used. Without a folder the
    shards are part of the run's intermediate data and go when the session ends: give a shared folder to keep them.
    """
    scratch = Scratch(docs.sparkSession, "training")
    placed, base, total = stream(docs, scratch, length=length, **more)
    manifest = scratch.write(materialise(placed, base, total, folder or f"{scratch.base}/shards", length, per_shard, key), "manifest")
    scratch.drop("stream")
    return manifest
