"""Order MinHash: the edited texts exactly, the sketch against a direct form, and likeness by edits."""

import bisect
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import order_minhash as om


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    rows = [(i * 3, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 120)))) for i in range(120)]
    return rows + [(400, None), (401, ""), (402, "  \n"), (403, "one"), (404, "be " * 500), (405, "é😀 ü"), (406, rows[0][1]), (406, rows[0][1]), (None, "no id"), (500, "long text here " * 9000)]


def test_edited_texts(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sketch string")
    got = om.fingerprints(docs).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        n, nxt = len(t), order[(k + 1) % len(order)][1]
        edited = t[: n - n // 2] + nxt[: n // 2]
        want.append((i, n, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[406].fingerprint and by[400].fingerprint == by[401].fingerprint == by[402].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by[400].near_edited == by[400].near_next == 1.0  # two empty texts
    long = [r for r in got if r.n_chars > 150 and r.doc_id is not None and r.doc_id < 360]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
    assert om.fingerprints(docs.where("false")).count() == 0
    one = om.fingerprints(docs.where("doc_id = 3")).first()
    assert one.near_next == 1.0


def test_occurrences_and_order_count(spark):
    a = [f"w{i}" for i in range(200)]
    texts = [a, a[100:] + a[:100], a[:190] + ["x"] * 10, list(reversed(a)), a * 2]
    df = om.with_sketch(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, t string"), "t", "s")
    one = df.where("i = 0").select(F.col("s").alias("o"))
    like = {r.i: r.l for r in df.crossJoin(one).select("i", om.likeness(F.col("s"), F.col("o")).alias("l")).collect()}
    assert like[0] == 1.0 and like[2] > 0.6 and like[3] < 0.1
    assert like[1] < 0.9  # the same pairs of words in another order
    assert like[4] < 0.6  # numbered repeats make it another text
    sizes = {r.i: r.n for r in df.select("i", F.size("s").alias("n")).collect()}
    assert max(sizes.values()) <= om.SAMPLINGS and re.fullmatch("([0-9A-F]{10})*", df.select(om.text_of(F.col("s"))).first()[0])


def direct(text, xx):
    """The sketch by its definition: numbered k-mers, the two smallest of each sampling in text order, hashed."""
    w = re.split(r"[ \t\n\x0b\x0c\r]+", text.strip(" \t\n\x0b\x0c\r"))
    w = [] if w == [""] else w
    kmers = [tuple(w[i : i + 2]) for i in range(max(len(w) - 1, 1))] if w else []
    seen, best = {}, {}
    for place, kmer in enumerate(kmers):
        base = xx[kmer] & om._RANK
        n = seen[base] = seen.get(base, -1) + 1
        h = xx[base, n] & om._RANK
        best.setdefault(h >> (om._SAMPLING - om._PLACE), []).append((h, place))
    out = []
    for sampling, found in sorted(best.items()):
        chosen = [h for h, _ in sorted(sorted(found)[:2], key=lambda x: x[1])]
        out.append((sampling, tuple(chosen)))
    return out


def test_sketch_against_a_direct_form(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(n)}" for _ in range(m)) for n, m in ((3, 40), (500, 200), (2, 3), (9, 1), (40, 1500))] + ["", "a a a a", " one\ttwo\nthree "]
    kmers = sorted({k for t in texts for w in [re.split(r"\s+", t.strip())] for i in range(max(len(w) - 1, 1)) if (k := tuple(w[i : i + 2])) != ("",)})
    xx = {tuple(r.k): r.h for r in spark.createDataFrame([(list(k),) for k in kmers], "k array<string>").select("k", F.xxhash64("k").alias("h")).collect()}
    longs = [(xx[k] & om._RANK, n) for k in kmers for n in range(800)]
    xx |= {(r.a, r.n): r.h for r in spark.createDataFrame(longs, "a long, n int").select("a", "n", F.xxhash64("a", "n").alias("h")).collect()}
    got = om.with_sketch(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "s").orderBy("i").collect()
    tuples = sorted({c for t in texts for _, c in direct(t, xx)})
    hashed = {tuple(r.c): r.h for r in spark.createDataFrame([(list(c),) for c in tuples], "c array<long>").select("c", F.when(F.size("c") == 1, F.xxhash64(F.col("c")[0])).otherwise(F.xxhash64(F.col("c")[0], F.get("c", F.lit(1)))).alias("h")).collect()}
    for r, t in zip(got, texts, strict=True):
        assert r.s == [(s << 32) + (hashed[c] & 0xFFFFFFFF) for s, c in direct(t, xx)]


def test_many_ranges_and_ids_of_another_kind(spark):
    cuts = sorted(random.Random(1).sample(range(-(10**15), 10**15), 3000))
    keys = [*cuts[::7], *[c + 1 for c in cuts[::11]], *[c - 1 for c in cuts[::13]], -(10**17), 10**17, None]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", om._range_of(F.col("k"), cuts).alias("b")).collect()
    assert all(r.b == (-1 if r.k is None else bisect.bisect_right(cuts, r.k)) for r in got)
    with pytest.raises(TypeError, match="whole numbers"):
        om.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_other_sizes_of_picks(spark):
    df = spark.createDataFrame([("a b c d e f g h",), ("",), ("x",)], "t string")
    assert [r[0] > 0 for r in om.with_sketch(df, "t", "s", picked=3).select(F.size("s")).collect()] == [True, False, True]
