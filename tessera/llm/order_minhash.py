"""Order MinHash fingerprints.

A text's k-mers (runs of ``k`` words) are numbered by occurrence, so that a repeated k-mer counts as often as it
stands there. Each numbered k-mer is hashed; six bits choose one of 64 samplings and the rest rank it there (one
permutation split into many). A sampling keeps its ``picked`` smallest k-mers, puts them back in text order and
hashes that tuple. Two texts agree in a sampling only if they share the chosen k-mers and their order, so the share
of agreeing samplings falls with edit distance, not only with set overlap. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.names import need_whole_ids
from tessera.runtime import stored_bytes

#: A range of ids is about so many stored bytes.
RANGE_BYTES = 32 << 20
K, PICKED, SAMPLINGS = 2, 2, 64
#: A k-mer is a long of 35 hash bits above 28 bits for its place; the hash's top 6 bits are the sampling.
_PLACE, _HASH, _SAMPLING = 28, 35, 57
_LOW, _RANK = (1 << _PLACE) - 1, (1 << _HASH) - 1


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, picked: int = PICKED) -> DataFrame:
    """df with the column ``out``: sorted longs, a sampling's number above 32 bits of its tuple's hash.

    A text with fewer than ``k`` words is one k-mer; a text without words (or null) has an empty sketch. Columns
    named __omh_* are used in between.
    """
    keep = [c for c in df.columns if c != out]
    step = lambda df, name, sql, *gone: df.select(*[c for c in df.columns if c not in gone and c != name], F.expr(sql).alias(name))
    w, s, r, t = "__omh_w", "__omh_s", "__omh_r", "__omh_t"
    numbered = lambda x, n: f"(xxhash64(shiftright({x}, {_PLACE}), {n}) & {_RANK}L) * {1 << _PLACE}L + ({x} & {_LOW}L)"
    same = lambda a, b: f"shiftright({a}, {_PLACE}) = shiftright({b}, {_PLACE})"
    df = df.select(*keep, F.split(F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+").alias(w))
    # hashes of k-mers with their places, sorted: repeats stand together, in text order
    df = step(df, s, f"sort_array(transform(sequence(1, greatest(size({w}) - {k - 1}, 1)), i -> (xxhash64(slice({w}, i, {k})) & {_RANK}L) * {1 << _PLACE}L + (i - 1)))")
    df = step(df, s, f"if(size({w}) = 1 and {w}[0] = '', cast(array() as array<bigint>), {s})", w, s)
    df = step(df, r, f"filter({s}, (x, i) -> i > 0 and {same('x', f'{s}[i - 1]')})")  # second and later occurrences
    runs = f"filter(sequence(0, size({r}) - 1), i -> i = 0 or not {same(f'{r}[i]', f'{r}[i - 1]')})"
    df = step(df, "__omh_b", f"if(size({r}) = 0, cast(array() as array<int>), {runs})")
    later = f"flatten(transform(__omh_b, (b, j) -> transform(sequence(b, coalesce(get(__omh_b, j + 1), size({r})) - 1), i -> {numbered(f'{r}[i]', 'i - b + 1')})))"
    first = f"transform(filter({s}, (x, i) -> i = 0 or not {same('x', f'{s}[i - 1]')}), x -> {numbered('x', '0')})"
    df = step(df, t, f"sort_array(concat({first}, {later}))", s, r, "__omh_b")
    df = step(df, t, f"filter({t}, (x, i) -> i < {picked} or shiftright(x, {_SAMPLING}) != shiftright({t}[i - {picked}], {_SAMPLING}))", t)
    heads = f"filter({t}, (x, i) -> i = 0 or shiftright(x, {_SAMPLING}) != shiftright({t}[i - 1], {_SAMPLING}))"
    df = step(df, "__omh_g", f"transform({heads}, x -> shiftright(x, {_SAMPLING}))")
    if picked == 2:  # the usual case without inner filters
        swap = lambda p, q: f"if(({p} & {_LOW}L) < ({q} & {_LOW}L), xxhash64(shiftright({p}, {_PLACE}), shiftright({q}, {_PLACE})), xxhash64(shiftright({q}, {_PLACE}), shiftright({p}, {_PLACE})))"
        pair = f"transform({t}, (x, i) -> if(shiftright(x, {_SAMPLING}) = shiftright(get({t}, i + 1), {_SAMPLING}), {swap('x', f'get({t}, i + 1)')}, xxhash64(shiftright(x, {_PLACE}))))"
        df = step(df, "__omh_p", pair)
        made = f"filter(transform(arrays_zip({t}, __omh_p), (z, i) -> if(i > 0 and shiftright(z.{t}, {_SAMPLING}) = shiftright({t}[i - 1], {_SAMPLING}), null, shiftright(z.{t}, {_SAMPLING}) * 4294967296L + (z.__omh_p & 4294967295L))), x -> x is not null)"
        df = step(df, out, made, t, "__omh_p", "__omh_g")
    else:
        group = f"transform(array_sort(transform(filter({t}, y -> shiftright(y, {_SAMPLING}) = g), y -> (y & {_LOW}L) * {1 << _HASH}L + shiftright(y, {_PLACE}))), v -> v & {_RANK}L)"
        df = step(df, out, f"transform(__omh_g, g -> g * 4294967296L + (xxhash64({group}) & 4294967295L))", t, "__omh_g")
    return df


def text_of(sketch: Column) -> Column:
    """The fingerprint as a string: ten hex digits for each sampling that has k-mers, in order."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of samplings that agree, of those that either text has; 1 for two empty sketches."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _range_of(key: Column, cuts: list) -> Column:
    """Number of cuts at or below the key by binary search, whatever their number; -1 for a null key."""
    if not cuts:
        return F.when(key.isNull(), F.lit(-1)).otherwise(F.lit(0))
    sorted_cuts = F.expr("array(" + ", ".join(f"{c}L" if isinstance(c, int) else f"{c!r}D" for c in cuts) + ")")
    state = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = key < F.get(sorted_cuts, mid)
        return F.when(acc["lo"] >= acc["hi"], acc).when(below, state(acc["lo"], mid)).otherwise(state(mid + 1, acc["hi"]))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), state(F.lit(0), F.lit(len(cuts))), halve, lambda acc: acc["lo"])
    return F.when(key.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: the next row by ascending id (ties by text), after the last the first.

    Rows are dealt to ranges of ids cut at quantiles, as many as the table's bytes ask for; each range also gets the
    first row of the next one, so no window spans the table. Only the ranges' first ids pass through the driver.
    Null ids come first, in one range; rows that repeat an id are in one range too.
    """
    need_whole_ids(docs, id_col)
    spark = docs.sparkSession
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(stored_bytes(docs.select(id_col, text_col)) or 0) // RANGE_BYTES))
    cuts = sorted({int(c) for c in picked.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))})
    bucket = _range_of(F.col("doc_id"), cuts)
    firsts = sorted((r.b, r.first) for r in picked.groupBy(bucket.alias("b")).agg(F.min("doc_id").alias("first")).collect())
    rows = picked.select("doc_id", "text", bucket.alias("__omh_range"), F.lit(0).alias("__omh_guest"))
    if firsts:
        # a row for each range: the first id of the next one (after the last, of the first) and the range it is a guest of
        homes = F.broadcast(spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "first long, home int"))
        guests = picked.join(homes, F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("home").agg(F.min(F.struct("doc_id", "text")).alias("x"))
        rows = rows.unionByName(guests.select("x.doc_id", "x.text", F.col("home").alias("__omh_range"), F.lit(1).alias("__omh_guest")))
    rows = with_sketch(rows, "text", "sketch", k)
    order = Window.partitionBy("__omh_range").orderBy("__omh_guest", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select("*", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
    return rows.where("__omh_guest = 0").drop("__omh_guest", "__omh_range")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how alike they are.

    The edited text is the text with its last floor(n / 2) code points replaced by as many of the next row's first
    (or all it has). A null text is empty; an empty text has an empty fingerprint, which is like another empty one
    only; a table of one row is followed by itself; repeated rows follow one another; other columns aren't used.
    """
    rows = with_next(docs, id_col, text_col, k)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"), "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch", k)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
