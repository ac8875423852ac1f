"""Near duplicates by MinHash bands, odd sketches and exact verification.

1. Each text's set of word shingles gives MinHash samples. Runs of ``ROWS`` samples are hashed to bands, and all
   samples are folded into an odd sketch: a bitmap whose bits hold parities, so the population count of two sketches'
   exclusive or tells the size of the difference of their samples. Equal sets are one class from here on.
2. Classes that share a band are compared by their sketches. What the sketches can't tell from a link, with five
   standard deviations to spare, joins them into a loose group; a bucket emits a spanning forest, never its pairs.
3. Loose groups are verified on full sets, again with one edge where it suffices. A group beyond ``GROUP`` classes is
   dealt into blocks: each block gets its own members and a few pivots; then members outside the group's largest
   component meet every block, so no link between two components is missed.
4. Connected components of the verified edges are the classes' groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import textbytes
from tessera.operators.components import components
from tessera.llm.groups import bounds, runs
from tessera.llm.names import fresh, need_whole_ids
from tessera.runtime import Scratch, broadcast_if_small

BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Sketches that differ in more bits are of sets with a similarity of about 0.6 or less (0.8 differs in 80 +- 10).
LOOSE_BITS = 135
BUCKET, GROUP, PIVOTS = 2048, 512, 8
BROADCAST_BYTES = 32 << 20

_rng = np.random.default_rng(40_006)
_FACTOR = _rng.integers(1, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_NUMBER = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set of 64-bit shingles."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 1024):
        np.minimum(out, (h[None, at : at + 1024] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1), out=out)
    return out


def bands_of(mins: np.ndarray) -> np.ndarray:
    """A hash of each band of each row of samples."""
    x = mins.astype(np.uint64).reshape(len(mins), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(mins), BANDS))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = out * np.uint64(0xD6E8FEB86659FD93) + x[:, :, k]
    return textbytes.mix(out)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parities of how many samples fall on each bit, as bytes."""
    with np.errstate(over="ignore"):
        bit = textbytes.mix(mins.astype(np.uint64) + _NUMBER) % np.uint64(SKETCH_BITS)
    row = np.arange(len(mins))[:, None] * SKETCH_BITS
    return np.packbits((np.bincount((row + bit.astype(np.int64)).ravel(), minlength=len(mins) * SKETCH_BITS) & 1).astype(bool).reshape(len(mins), SKETCH_BITS), axis=1)


def sets_of(w: textbytes.Words, width: int) -> list[np.ndarray]:
    hashes, starts = textbytes.shingles(w, width)
    return [np.unique(hashes[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in textbytes.words(batch.column(1)):
                sets = sets_of(w, width)
                mins = np.array([samples(s) for s in sets])
                full = np.array([len(s) > 0 for s in sets])
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()), pa.array(bands_of(mins)[full].ravel().view(np.int64)))
                yield pa.record_batch(
                    [batch.column(0).slice(w.rows.start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), bands, pa.array([x.tobytes() for x in odd_sketches(mins)], pa.binary())],
                    ["doc_id", "n", "same", "bands", "sketch"],
                )

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """Each row's component in a symmetric matrix of links, as the smallest row in it."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of spanning forests of buckets: (bucket, class, n, sketch) sorted by bucket."""
    for batch in runs(batches):
        keys, ids, n = (batch.column(k).to_numpy() for k in range(3))
        sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(len(keys), -1)
        starts = bounds(keys)
        size = np.diff(starts)
        found = []

        def close(i, j, n=n, sketch=sketch):
            fits = 10 * np.minimum(n[i], n[j]) >= 8 * np.maximum(n[i], n[j])
            return fits & (np.bitwise_count(sketch[i] ^ sketch[j]).sum(-1) <= LOOSE_BITS)

        two = starts[:-1][size == 2]
        two = two[close(two, two + 1)]
        found.append(np.stack([ids[two], ids[two + 1]], 1))
        for at, m in zip(starts[:-1][size > 2], size[size > 2], strict=True):
            label = np.arange(m)
            if m <= 64:
                i = np.arange(at, at + m)
                label = _forest(close(i[:, None], i[None, :]))
            else:  # a row at a time, against rows of other components only
                for k in range(m):
                    other = np.flatnonzero(label != label[k])
                    if len(other) and len(hit := other[close(at + k, at + other)]):
                        joined = np.unique(np.append(label[hit], label[k]))
                        label[np.isin(label, joined)] = joined[0]
            child = np.flatnonzero(label != np.arange(m))
            found.append(np.stack([ids[at + child], ids[at + label[child]]], 1))
        edges = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        yield pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def _verified(width: int, percent: int):
    """Edges of exact links among the rows of each group: (group, role, label, id, text) sorted by group.

    Role 0 rows are compared with each other and with those of role 1, which aren't compared among themselves. Rows
    of one label (if not null) are known to be connected.
    """

    def links(sets, role, label) -> list[tuple[int, int]]:
        every, where = np.unique(np.concatenate(sets), return_inverse=True)
        n = np.array([len(s) for s in sets])
        at = np.concatenate([[0], np.cumsum(n)])
        mark, out = np.zeros(len(every), bool), []
        for i in range(len(sets)):
            j = np.flatnonzero(label != label[i])
            j = j[((j > i) | (role[i] != role[j])) & ((role[i] == 0) | (role[j] == 0)) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
            if role[i] == 1:
                j = j[j > i]
            if not len(j):
                continue
            mark[where[at[i] : at[i + 1]]] = True
            if len(j) * 4 > len(sets):
                shared = np.add.reduceat(mark[where], at[:-1], dtype=np.int64)[j]
            else:
                shared = np.array([mark[where[at[x] : at[x + 1]]].sum() for x in j])
            mark[where[at[i] : at[i + 1]]] = False
            hit = j[100 * shared >= percent * (n[i] + n[j] - shared)]
            for x in hit:
                if label[x] != label[i]:
                    out.append((i, int(x)))
                    label[label == label[x]] = label[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            keys, role, known, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            sets = [s for w in textbytes.words(batch.column(4)) for s in sets_of(w, width)]
            found = []
            starts = bounds(keys)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                keep = [k for k in range(a, b) if len(sets[k])]
                if len(keep) > 1:
                    label = np.unique(known[keep], return_inverse=True)[1]
                    found += [(ids[keep[i]], ids[keep[j]]) for i, j in links([sets[k] for k in keep], role[keep], label)]
            if found:
                yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return run


def _blocks(n: str, size: int):
    return F.ceil(F.col(n) / size).cast("int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row.

    Texts are lower-cased in A-Z only and split at 0x20 and 0x09-0x0D; a text's set is its shingles of ``width`` words
    (its whole sequence if it has fewer). Sets are linked where 100 * intersection >= ``percent`` * union. A text
    without words (or null) has no shingles and no links. Rows that repeat an id are one document, which has the
    links of each; a null id isn't linked, has no component and is kept. Ids are whole numbers; other columns aren't
    used.
    """
    if percent < 80:
        raise ValueError("bands and sketches are laid out for links of 80 percent or more")
    need_whole_ids(docs, id_col)
    scratch = Scratch(docs.sparkSession, "neardup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.write(texts.mapInArrow(_signed(width), "doc_id long, n long, same binary, bands array<long>, sketch binary"), "signed")
    usable = signed.where("n > 0 and doc_id is not null")
    classes = scratch.write(usable.groupBy("same").agg(F.min("doc_id").alias("class")), "classes")
    reps = usable.join(classes, (usable["same"] == classes["same"]) & (usable["doc_id"] == classes["class"]), "left_semi").select(F.col("doc_id").alias("class"), "n", "bands", "sketch", "same").dropDuplicates(["class", "same"]).drop("same")
    reps = scratch.write(reps, "reps")
    banded = reps.select("class", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1")
    members = banded.join(full, "band").withColumn("parts", _blocks("m", BUCKET))
    # a bucket beyond BUCKET classes is dealt into blocks, and each pair of blocks is a bucket of its own
    part = F.pmod(F.xxhash64("class", "band"), F.col("parts")).cast("int")
    members = members.withColumn("part", part).select("class", "band", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    bucket = F.xxhash64("band", F.least("part", "other"), F.greatest("part", "other"))
    bucketed = members.select("class", bucket.alias("bucket")).join(reps.select("class", "n", "sketch"), "class").select("bucket", "class", "n", "sketch")
    loose = bucketed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_loose, "a long, b long").distinct()
    groups = components(loose, scratch, "loose")
    scratch.drop("reps")

    sizes = groups.groupBy("component").agg(F.count("*").alias("m"))
    grouped = groups.join(sizes, "component").withColumn("parts", _blocks("m", GROUP)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    grouped = scratch.write(grouped, "grouped")
    large = grouped.where("parts > 1")
    pivots = large.withColumn("_k", F.row_number().over(Window.partitionBy("component", "part").orderBy(F.xxhash64("node"), "node"))).where("_k = 1").orderBy(F.xxhash64("node"))
    pivots = pivots.where(f"pmod(part, greatest(parts div {PIVOTS}, 1)) = 0").select("node", "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = grouped.select("node", "component", "part", F.lit(0).alias("role"))
    work = own.union(pivots.select("node", "component", "part", F.lit(1).alias("role")))

    def verified(work: DataFrame, name: str) -> DataFrame:
        """work: node, component, part, role, label"""
        work = scratch.write(work, f"{name}_work")
        rows = texts.join(broadcast_if_small(work, BROADCAST_BYTES), texts["doc_id"] == work["node"])
        rows = rows.select(F.xxhash64("component", "part").alias("group"), "role", "label", "node", "text")
        found = rows.repartition("group").sortWithinPartitions("group", "role", "node").mapInArrow(_verified(width, percent), "a long, b long")
        found = scratch.write(found.distinct(), name)
        scratch.drop(f"{name}_work")
        return found

    exact = verified(work.withColumn("label", F.col("node")), "exact")
    if large.limit(1).count():
        so_far = components(exact, scratch, "so_far")
        joined = large.join(so_far.select("node", F.col("component").alias("strict")), "node", "left").withColumn("strict", F.coalesce("strict", "node"))
        joined = scratch.write(joined, "strict")
        counted = joined.groupBy("component", "strict").agg(F.count("*").alias("c"))
        main = counted.groupBy("component").agg(F.max(F.struct("c", "strict")).alias("x"), F.count("*").alias("kinds")).where("kinds > 1").select("component", F.col("x.strict").alias("main"))
        split = joined.join(main, "component")
        rest = split.where("strict != main").select("node", "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "strict")
        again = split.select("node", "component", "part", F.lit(0).alias("role"), "strict").union(rest).withColumnRenamed("strict", "label")
        exact = exact.union(verified(again, "again"))
    final = components(exact, scratch, "final")
    scratch.drop("grouped", "exact", "again", "strict")

    ids = signed.select("doc_id", "n", "same").join(classes, "same", "left").join(final, F.col("class") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id"))
    return ids.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of the smallest id of each group, all columns as they are; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, **more).where("not kept").select("doc_id").distinct()
    return without(docs, gone, id_col, Scratch(docs.sparkSession, "neardup"))


def without(docs: DataFrame, gone: DataFrame, id_col: str, scratch: Scratch) -> DataFrame:
    """The rows of docs whose id isn't among ``gone`` (one column), whatever the columns of docs are called."""
    key = fresh(docs)
    gone = broadcast_if_small(scratch.write(gone.toDF(key), "gone"), BROADCAST_BYTES)
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")
