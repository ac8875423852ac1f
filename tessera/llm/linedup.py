"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Lines with equal sets are one class, represented by the earliest. Words are ordered by
rarity (counts over the whole table, added up in a fixed number of cells; any order is exact, a rare one is fast), and
only a prefix of each set is indexed: two sets with Jaccard ``PERCENT`` or more share a word of their prefixes. Among
the sets of a word, those that can't match by length, by the words left after the shared one, or by the parities of
their words (a lower bound on the difference) are passed over; what is left is joined into loose groups, of which each
word's list emits a spanning forest only. Inside a group full sets decide whether a line has an earlier match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm import textbytes
from tessera.operators.components import components
from tessera.llm.groups import bounds, runs
from tessera.llm.names import fresh, need_whole_ids
from tessera.runtime import Scratch, broadcast_if_small

PERCENT = 80
_BLANKS = " \t\n\x0b\x0c\r"
CELLS, _SLABS = 1 << 18, 32
BROADCAST_BYTES = 32 << 20
#: Longer lists are compared in squares of so many; a loose group of more sets is dealt into blocks.
LIST, GROUP, PIVOTS = 512, 512, 8
LIST_BYTES = 4 << 20
#: Words counted so often, and 64 times as often as a cell's mean, are dealt into blocks before lists are made.
HOT, BLOCKS = 1 << 20, 64


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, same, line, k1, k2) of each line with words, keys of its bag of words; then the task's counts of words by cell, in slabs."""
    total = np.zeros(CELLS, np.int64)
    names = ["doc_id", "same", "line", "k1", "k2", "counts"]
    for batch in batches:
        for w in textbytes.words(batch.column(2)):
            if not len(w.hashes):
                continue
            total += np.bincount((w.hashes % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
            row, line, place = _tokens(w)
            at = bounds(place)[:-1]
            k1, k2 = _bag_keys(w.hashes, at)
            rows = pa.array(row[at] + w.rows.start)
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(line[at].astype(np.int32)), pa.array(k1), pa.array(k2), pa.nulls(len(at), pa.binary())], names)
    if total.any():
        none = pa.nulls(_SLABS, pa.int64())
        yield pa.record_batch([none, none, pa.array(range(_SLABS), pa.int32()), none, none, pa.array([x.tobytes() for x in np.split(total, _SLABS)], pa.binary())], names)


def _bag_keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.add.reduceat(textbytes.mix(hashes), at).view(np.int64), np.add.reduceat(textbytes.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at).view(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[slab] = sums.get(slab, 0) + np.frombuffer(x, np.int64)
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slab", "counts"])


def rarity(slabs: DataFrame) -> np.ndarray:
    """Counts of words by cell over the whole table: an array of fixed size."""
    out = np.zeros(CELLS, np.int64)
    for r in slabs.repartition(_SLABS, "slab").mapInArrow(_summed, "slab int, counts binary").collect():
        out[r.slab * (CELLS // _SLABS) : (r.slab + 1) * (CELLS // _SLABS)] += np.frombuffer(bytes(r.counts), np.int64)
    return out


def needed(n, m, percent: int):
    """Least intersection of sets of n and m words with the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def _tokens(w: textbytes.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its row, its line's number in the row, and its line's number in the chunk."""
    breaks = np.concatenate([[0], np.cumsum(w.data == 10)])
    row = np.repeat(np.arange(len(w.starts) - 1), np.diff(w.starts))
    at = breaks[w.begin]
    return row, at - breaks[w.row_bytes[row]], at + row


_POSTING = np.dtype([("word", "<u4"), ("n", "<u4"), ("place", "<u2"), ("node", "<i8"), ("p1", "<u8"), ("p2", "<u8")])


def _postings(counts, percent: int, parts: int):
    """(text, lines) to packed postings of the prefixes of the chosen lines, by part of their words.

    A word that may have a long list, by its count, is dealt into blocks by node instead, and each pair of blocks is
    a list of its own. However many blocks there are, every pair of postings of a word meets in one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        # an eighth of an octave is as fine as the order needs; words of one level are ordered by hash
        level = np.minimum(8 * np.log2(np.maximum(cells, 1)), 255).astype(np.uint64) << np.uint64(36)
        hot = max(HOT, 64 * int(cells.mean()))

        def dealt(found: list[tuple]) -> pa.RecordBatch:
            part, made = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(part, kind="stable")
            made, part = made[order], part[order]
            at = bounds(part)
            return pa.record_batch([pa.array(part[at[:-1]]), pa.array([made[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["list", "packed"])

        for batch in batches:
            found, held = [], 0
            for w in textbytes.words(batch.column(0)):
                if not len(w.hashes):
                    continue
                row, line, place = _tokens(w)
                base = (place - line)[w.starts[:-1].clip(max=len(place) - 1)]
                lists = batch.column(1).slice(w.rows.start, len(w.starts) - 1)
                chosen = np.zeros(int(place[-1]) + 2, bool)
                chosen[np.repeat(base, lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()] = True
                keep = chosen[place]
                h, p = w.hashes[keep], place[keep]
                if not len(h):
                    continue
                node, _ = _bag_keys(h, bounds(p)[:-1])
                rank = level[(h % np.uint64(CELLS)).astype(np.int64)]
                key = p.astype(np.uint64) << np.uint64(44) | rank | h >> np.uint64(28)
                order = np.argsort(key) if p[-1] < 1 << 20 else np.lexsort((key << np.uint64(20), p))
                h, p = h[order], p[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
                h, p = h[new], p[new]
                at = bounds(p)
                n = np.diff(at)
                bit, half = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) & np.uint64(1) == 1
                p1, p2 = (np.bitwise_xor.reduceat(np.where(half == x, bit, np.uint64(0)), at[:-1]) for x in (True, False))
                size = n + (-percent * n // 100) + 1  # n less the least overlap with any match, and one
                ends = np.cumsum(size)
                owner = np.repeat(np.arange(len(n)), size)
                within = np.arange(ends[-1]) - np.repeat(ends - size, size)
                words = h[at[:-1][owner] + within]
                long = cells[(words % np.uint64(CELLS)).astype(np.int64)] > hot
                made = np.empty(len(words), _POSTING)
                made["word"], made["n"], made["place"], made["node"], made["p1"], made["p2"] = (words >> np.uint64(33)).astype(np.uint32), n[owner], np.minimum(within, 65535), node[owner], p1[owner], p2[owner]
                part = (made["word"].astype(np.int64) * 2654435761 >> 7) % parts
                if long.any():
                    # each pair of a long list's blocks is a list of its own, below zero
                    count = np.minimum(-(-cells[(words[long] % np.uint64(CELLS)).astype(np.int64)] // hot), BLOCKS)
                    again = np.repeat(np.flatnonzero(long), count)
                    other = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                    with np.errstate(over="ignore"):
                        own = (textbytes.mix(made["node"][again].view(np.uint64)) % np.repeat(count, count).astype(np.uint64)).astype(np.int64)
                        pair = textbytes.mix(made["word"][again].astype(np.uint64) << np.uint64(20) | (np.minimum(own, other) << 10 | np.maximum(own, other)).astype(np.uint64))
                    made = np.concatenate([made[~long], made[again]])
                    part = np.concatenate([part[~long], -1 - (pair >> np.uint64(1)).astype(np.int64)])
                found.append((part, made))
                held += len(made)
                if held > 1 << 17:
                    yield dealt(found)
                    found, held = [], 0
            if found:
                yield dealt(found)

    return run


def _stars(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A forest with the components of edges: rows of (node, smallest node by position)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[child], nodes[label[child]]], 1)


def _pairs(at: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within runs, about a quarter of a million at a time."""
    most = 1 << 18
    for m in np.unique(size[(size > 1) & (size <= LIST)]):
        lists = at[:-1][size == m]
        p, q = np.triu_indices(m, 1)
        step = max(1, most // len(p))
        for k in range(0, len(lists), step):
            yield (lists[k : k + step, None] + p).ravel(), (lists[k : k + step, None] + q).ravel()
    for first, m in zip(at[:-1][size > LIST], size[size > LIST], strict=True):
        for a in range(0, m, LIST):
            rows = np.arange(a, min(a + LIST, m))
            for b in range(a, m, LIST):
                cols = np.arange(b, min(b + LIST, m))
                i, j = (x.ravel() for x in np.broadcast_arrays(rows[:, None], cols[None, :]))
                yield first + i[i < j], first + j[i < j]


def _loose(percent: int):
    """Forests of what may match in lists: (list, packed postings) sorted by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            found = []
            keys, packed = batch.column(0).to_numpy(), batch.column(1)
            starts = bounds(keys)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                x = np.frombuffer(b"".join(packed.slice(a, b - a).to_pylist()), _POSTING)
                x = x[np.argsort(x["word"], kind="stable")]
                word, node, p1, p2 = x["word"], *(np.ascontiguousarray(x[k]) for k in ("node", "p1", "p2"))
                n, place = x["n"].astype(np.int64), x["place"].astype(np.int64)
                at = bounds(word)
                size = np.diff(at)
                for i, j in _pairs(at, size):
                    fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                    i, j = i[fits], j[fits]
                    least = needed(n[i], n[j], percent)
                    # a match shares a word of what its own overlap leaves of both prefixes
                    fits = (place[i] <= n[i] - least) & (place[j] <= n[j] - least)
                    i, j, least = i[fits], j[fits], least[fits]
                    apart = np.bitwise_count(p1[i] ^ p1[j]).astype(np.int64) + np.bitwise_count(p2[i] ^ p2[j])
                    fits = apart <= n[i] + n[j] - 2 * least
                    if fits.any():
                        found.append(np.stack([node[i[fits]], node[j[fits]]], 1))
                    if sum(map(len, found)) > 1 << 20:
                        found = [_stars(*np.concatenate(found).T)]
            if found:
                edges = _stars(*np.concatenate(found).T)
                yield pa.record_batch([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return run


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen lines: (doc_id, same, [(line, component, part, parts)], text) to a row for each with the line's text."""
    names = ["component", "part", "parts", "doc_id", "same", "line", "words"]
    for batch in batches:
        chosen = [{x["line"]: x for x in row} for row in batch.column(2).to_pylist()]
        ids, sames = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for w in textbytes.words(batch.column(3)):
            if not len(w.hashes):
                continue
            row, line, place = _tokens(w)
            at = bounds(place)
            out = []
            for a, b, r, k in zip(at[:-1], at[1:], (row[at[:-1]] + w.rows.start).tolist(), line[at[:-1]].tolist(), strict=True):
                if (x := chosen[r].get(k)) is not None:
                    out.append((x["component"], x["part"], x["parts"], ids[r], sames[r], k, w.data[w.begin[a] : w.end[b - 1]].tobytes()))
            if out:
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _matched(percent: int):
    """Rows of role 0 or 2 with an earlier match in their group: (group, role, doc_id, same, line, words) sorted by group and place.

    Role 0 rows are compared with each other; roles 1 (only matched with) and 2 (only looked up) come from elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            keys, role = (batch.column(k).to_numpy() for k in range(2))
            flat = [np.unique(w.hashes[a:b]) for w in textbytes.words(batch.column(5).cast(pa.large_binary()).cast(pa.large_string())) for a, b in zip(w.starts[:-1], w.starts[1:], strict=True)]
            docs, sames, lines = (batch.column(k).to_numpy() for k in (2, 3, 4))
            starts, gone = bounds(keys), []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if b - a < 2:
                    continue
                every, where = np.unique(np.concatenate(flat[a:b]), return_inverse=True)
                n = np.array([len(x) for x in flat[a:b]])
                at = np.concatenate([[0], np.cumsum(n)])
                moved = (docs[a + 1 : b] != docs[a : b - 1]) | (sames[a + 1 : b] != sames[a : b - 1]) | (lines[a + 1 : b] != lines[a : b - 1])
                spot = np.concatenate([[0], np.cumsum(moved)])  # repeated rows share a place
                mark = np.zeros(len(every), bool)
                for i in range(1, b - a):
                    if role[a + i] == 1:
                        continue
                    j = np.arange(i)
                    j = j[(spot[j] < spot[i]) & ((role[a + j] == 0) | (role[a + i] == 0) & (role[a + j] == 1)) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
                    if not len(j):
                        continue
                    mark[where[at[i] : at[i + 1]]] = True
                    done = False
                    for part in np.array_split(j, -(-len(j) // 64)):
                        shared = np.array([mark[where[at[x] : at[x + 1]]].sum() for x in part])
                        if (shared >= needed(n[i], n[part], percent)).any():
                            done = True
                            break
                    mark[where[at[i] : at[i + 1]]] = False
                    if done:
                        gone.append(a + i)
            if gone:
                yield pa.record_batch([pa.array(docs[gone]), pa.array(sames[gone]), pa.array(lines[gone])], ["doc_id", "same", "line"])

    return run


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, same (a hash of the text) and lines: the numbers (from 0) of the lines with words that stay, for texts that have any.

    A line, between line feeds, goes if a line earlier by (doc_id, same, line) has 100 * intersection >= ``percent`` *
    union of their sets of words (lower-cased in A-Z only). Lines without words never match. Rows with equal ids and
    texts share their lines' fate; null ids and null texts take no part. Ids are whole numbers.
    """
    need_whole_ids(docs, id_col)
    spark = docs.sparkSession
    scratch = Scratch(spark, "linedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("same"), "text")
    held = scratch.write(texts.mapInArrow(_keys, "doc_id long, same long, line int, k1 long, k2 long, counts binary"), "lines")
    cells = rarity(held.where("counts is not null").select(F.col("line").alias("slab"), "counts"))
    counts = spark.sparkContext.broadcast(cells)
    lines = held.where("counts is null").drop("counts")
    classes = lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "same", "line")).alias("r")).select("k1", "k2", "r.*")
    classes = scratch.write(classes, "classes")
    scratch.drop("lines")
    firsts = scratch.write(classes.groupBy(F.col("doc_id").alias("_doc"), F.col("same").alias("_same")).agg(F.collect_list("line").alias("lines")), "firsts")
    rows = texts.join(broadcast_if_small(firsts, BROADCAST_BYTES), (F.col("doc_id") == F.col("_doc")) & (F.col("same") == F.col("_same"))).select("text", "lines")
    # about a quarter of all words is in prefixes; a list of all its words' postings is LIST_BYTES then
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(cells.sum()) * _POSTING.itemsize // (4 * LIST_BYTES))
    posted = rows.mapInArrow(_postings(counts, percent, parts), "list long, packed binary")
    loose = posted.repartition("list").sortWithinPartitions("list").mapInArrow(_loose(percent), "a long, b long").distinct()
    groups = components(loose, scratch, "loose")

    sizes = groups.groupBy("component").agg(F.count("*").alias("m")).select("component", F.ceil(F.col("m") / GROUP).cast("int").alias("parts"))
    placed = classes.select(F.col("k1").alias("node"), "doc_id", "same", "line").join(groups, "node").join(sizes, "component")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    wanted = placed.groupBy(F.col("doc_id").alias("_doc"), F.col("same").alias("_same")).agg(F.collect_list(F.struct("line", "component", "part", "parts")).alias("chosen"))
    wanted = broadcast_if_small(scratch.write(wanted, "wanted"), BROADCAST_BYTES)
    rows = texts.join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("same") == F.col("_same"))).select("doc_id", "same", "chosen", "text")
    sets = scratch.write(rows.mapInArrow(_wanted, "component long, part int, parts int, doc_id long, same long, line int, words binary"), "sets")
    scratch.drop("firsts", "wanted")
    columns = ["role", "doc_id", "same", "line", "words"]

    def matched(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.xxhash64("component", "part").alias("group"), *columns).repartition("group").sortWithinPartitions("group", "doc_id", "same", "line", "role")
        return rows.mapInArrow(_matched(percent), "doc_id long, same long, line int").distinct()

    own = sets.withColumn("role", F.lit(0))
    spread = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    first = own.where("parts > 1").withColumn("_k", F.row_number().over(Window.partitionBy("component", "part").orderBy("doc_id", "same", "line"))).where(f"_k = 1 and part < {PIVOTS}").drop("_k")
    first = first.withColumn("_from", F.col("part")).withColumn("part", spread).where("part != _from").withColumn("role", F.lit(1))
    gone = scratch.write(matched(own.unionByName(first.drop("_from"))), "gone")
    if sets.where("parts > 1").limit(1).count():
        rest = own.where("parts > 1").join(gone, ["doc_id", "same", "line"], "left_anti").withColumn("_from", F.col("part")).withColumn("part", spread).where("part != _from").withColumn("role", F.lit(2))
        gone = scratch.write(gone.union(matched(own.where("parts > 1").unionByName(rest.drop("_from")))).distinct(), "all_gone")
    scratch.drop("sets")

    kept = classes.select("doc_id", "same", "line").join(gone, ["doc_id", "same", "line"], "left_anti")
    return kept.groupBy("doc_id", "same").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, counted: bool = False, drop_emptied: bool = False) -> DataFrame:
    """docs with later matches of lines removed from the text; all other columns as they are.

    With ``counted`` also __n_lines and __n_removed (0 for a null text). A text that loses all its lines is empty;
    with ``drop_emptied`` such a row goes, while texts that were empty before stay.
    """
    kept = Scratch(docs.sparkSession, "linedup").write(kept_lines(docs, id_col, text_col, percent), "kept")
    own = fresh(docs)
    kept = broadcast_if_small(kept, BROADCAST_BYTES).select(F.col("doc_id").alias(f"{own}_id"), F.col("same").alias(f"{own}_same"), F.col("lines").alias(f"{own}_lines"))
    joined = docs.join(kept, (docs[id_col].cast("long") == kept[f"{own}_id"]) & (F.xxhash64(docs[text_col].cast("string")) == kept[f"{own}_same"]), "left")
    stay, taken = kept[f"{own}_lines"], docs[id_col].isNotNull() & docs[text_col].isNotNull()
    # generated, so that no later expression makes it again
    made = F.explode(F.array(_rest(F.split(docs[text_col], "\n", -1), stay, taken))).alias(own)
    joined = joined.select(*[docs[c] for c in docs.columns], made)
    left = F.col(f"{own}.left")
    if drop_emptied:
        joined = joined.where(left.isNull() | (F.trim(left, F.lit(_BLANKS)) != ""))
    more = [F.coalesce(F.col(f"{own}.{c}"), F.lit(0)).cast("long").alias(f"__{c}") for c in ("n_lines", "n_removed")] if counted else []
    return joined.select(*[F.coalesce(left, text_col).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *more)


def _rest(parts: Column, stay: Column, taken: Column) -> Column:
    """left (null if no line goes), n_lines and n_removed; each array is made once."""
    let = lambda value, body: F.transform(F.array(value), lambda x: body(x))[0]

    def counted(p: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(p) - 1)
        blank = F.filter(every, lambda i: F.trim(p[i], F.lit(_BLANKS)) == "")
        kept = F.array_sort(F.concat(F.coalesce(stay, F.expr("cast(array() as array<int>)")), blank))
        return let(F.when(taken, kept).otherwise(every), lambda k: F.struct(F.when(F.size(k) < F.size(p), F.array_join(F.transform(k, lambda i: p[i]), "\n")).alias("left"), F.size(p).alias("n_lines"), (F.size(p) - F.size(k)).alias("n_removed")))

    return let(parts, lambda p: F.when(p.isNotNull(), counted(p)))
