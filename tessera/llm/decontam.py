"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be very long, so the two are never compared by resemblance. Items are
partitioned by the power of two of their number of shingles (size classes). A partition's items are sketched with their
smallest hashes, in an order that puts shingles of fewer items first (min-wise hashing with weights), as many as the
item's threshold asks. No MinHash of a document is needed: of an item's q shingles a document must hold c = ceil(t q),
so it lacks q - c at most, and of any q - c + 1 of them, the smallest ones too, it holds one. Documents therefore probe
the sketches with all their shingles, and recall is exact; a document's own minima would say little of a short item.

Partitions are skipped by documents that are too short for the least item in them: such a document makes no shingles
for the partition's width, and what it finds in the sketches of higher partitions is passed over. Whatever is left is
verified by exact containment. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.neardup import without
from tessera.runtime import Scratch, broadcast_if_small

WIDTH, THRESHOLD = 5, 0.8
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits; none for a null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(of: Column, width: int) -> Column:
    n = F.size(of)
    made = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(of, i, F.lit(width))))
    return F.when(n >= width, made).otherwise(F.expr("cast(array() as array<bigint>)"))


def items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """item_id, width, shingles (distinct hashes). An item with fewer words is one shingle of all of them; one without words has none."""
    w = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w"))
    w = w.where(F.size("w") > 0).select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("width"))
    made = F.coalesce(*[F.when(F.col("width") == k, _shingles(F.col("w"), k)) for k in range(1, width + 1)])
    return w.select("item_id", "width", F.array_distinct(made).alias("shingles"))


def search(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs doc_id, item_id with n_shared and n_item (shingles) where n_shared >= threshold * n_item.

    Rows of one doc_id count as one document, as do items of one item_id that repeat; rows with a null id, null or
    empty texts and items without words have no pairs; other columns aren't used. Ids may be of any type.
    """
    scratch = Scratch(docs.sparkSession, "decontam")
    need = F.ceil(F.round(F.col("q") * F.lit(threshold), 6))
    shingle = items(benchmark.where(F.col(item_col).isNotNull()), item_col, item_text, width).select("item_id", "width", F.explode("shingles").alias("h")).distinct()
    sizes = shingle.groupBy("item_id").agg(F.count("*").alias("q"))
    shingle = scratch.write(shingle.join(sizes, "item_id").select("item_id", "width", "h", "q", need.alias("need"), F.floor(F.log2("q")).cast("int").alias("size_class")), "items")
    classes = partitions(shingle)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    if not classes:
        return texts.select("doc_id", F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("n_item")).where("false")
    holders = shingle.groupBy("width", "h").agg(F.count("*").alias("holders"))
    by_item = shingle.join(holders, ["width", "h"]).groupBy("item_id", "width", "q", "need", "size_class").agg(F.array_sort(F.collect_list(F.struct("holders", "h"))).alias("hs"))
    sketch = by_item.select("item_id", "width", "size_class", F.explode(F.slice("hs", F.lit(1), (F.col("q") - F.col("need") + 1).cast("int"))["h"]).alias("h"))
    sketch = scratch.write(sketch.groupBy("width", "h").agg(F.min("size_class").alias("lowest"), F.collect_set(F.struct("size_class", "item_id")).alias("found")), "sketch")
    probe = broadcast_if_small(sketch, BROADCAST_BYTES)

    # rows that repeat an id are one document, whose length no single row tells: none of them is skipped
    again = scratch.write(texts.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("doc_id").alias("again")), "again")
    if again.limit(1).count():
        texts = texts.join(broadcast_if_small(again, BROADCAST_BYTES), F.col("doc_id") == F.col("again"), "left")
        reached = F.when(F.col("again").isNotNull(), max(c for c, _, _ in classes)).otherwise(reach(F.size("w"), classes))
    else:
        reached = reach(F.size("w"), classes)
    texts = texts.select("doc_id", "w", reached.alias("reach")).where("reach is not null")

    def hashes(of: DataFrame) -> DataFrame:
        out = None
        for k in sorted({w for _, w, _ in classes}):
            lowest = min(c for c, w, _ in classes if w == k)
            part = of.where(F.col("reach") >= lowest).select("doc_id", "reach", F.lit(k).alias("width"), F.explode(_shingles(F.col("w"), k)).alias("h"))
            out = part if out is None else out.unionByName(part)
        return out

    hits = hashes(texts).join(probe, ["width", "h"]).where("lowest <= reach").select("doc_id", "reach", F.explode("found").alias("f"))
    candidates = scratch.write(hits.where("f.size_class <= reach").select("doc_id", "f.item_id").distinct(), "candidates")
    once = texts.join(broadcast_if_small(candidates.select("doc_id").distinct(), BROADCAST_BYTES), "doc_id", "left_semi")
    every = broadcast_if_small(shingle.select("width", "h", "item_id", "q", "need"), BROADCAST_BYTES)
    # pairs that no sketch proposed go before anything is grouped
    shared = hashes(once).select("doc_id", "width", "h").join(every, ["width", "h"]).join(broadcast_if_small(candidates, BROADCAST_BYTES), ["doc_id", "item_id"], "left_semi")
    shared = shared.groupBy("doc_id", "item_id", "h").agg(F.first("q").alias("q"), F.first("need").alias("need")).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("q").alias("n_item"), F.first("need").alias("need"))
    return shared.where("n_shared >= need").select("doc_id", "item_id", "n_shared", "n_item")


def partitions(shingle: DataFrame) -> list[tuple[int, int, int]]:
    """(size class, width, least number of words a document of it needs): a few rows for each power of two."""
    least = shingle.groupBy("size_class", "width").agg(F.min(F.col("need") + F.col("width") - 1).alias("words")).collect()
    return sorted((r.size_class, r.width, r.words) for r in least)


def reach(n_words: Column, classes: list[tuple[int, int, int]]) -> Column:
    """The highest size class with an item that so many words can hold; null if there is none."""
    out = F.lit(None).cast("int")
    least: dict[int, int] = {}
    for c, _, n in classes:
        least[c] = min(n, least.get(c, n))
    for c in sorted(least):
        out = F.when(n_words >= least[c], F.lit(c)).otherwise(out)
    return out


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (ascending) for each row; a null id is never contaminated."""
    pairs = search(docs, benchmark, id_col, **more).groupBy(F.col("doc_id").alias("__hit")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    out = ids.join(pairs, F.col("doc_id") == F.col("__hit"), "left")
    n = F.coalesce(F.size("item_ids"), F.lit(0))
    n = F.when(F.col("item_ids").isNull(), F.lit(0)).otherwise(n).cast("long")
    return out.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.concat_ws(",", F.col("item_ids").cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of documents that hold no test item; all columns as they are."""
    hits = search(docs, benchmark, id_col, **more).select("doc_id").distinct()
    return without(docs, hits, id_col, Scratch(docs.sparkSession, "decontam"))
