"""Containment search against a direct count of shingles."""

import re

import pytest

from tessera.llm import decontam


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(docs, items):
    out = set()
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        k = min(5, len(w))
        s = shingles(w, k)
        for d in {d for d, _ in docs if d is not None}:
            held = set().union(*[shingles(words(x), k) for y, x in docs if y == d])
            if 10 * len(s & held) >= 8 * len(s):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    item = [f"q{i} " + " ".join(f"t{i}w{k}" for k in range(20 + i)) for i in range(12)]
    items = [*enumerate(item), (50, "two Words"), (51, None), (52, ""), (53, "!!"), (None, "null id item text here now"), (0, item[0]), (54, "a a a a a a a a")]
    cut = item[3].split()
    docs = [(i, f"start {item[i]} end " * (i % 3 + 1)) for i in range(6)]
    docs += [(20, " ".join(cut[:19])), (21, " ".join(cut[:10])), (22, " ".join(cut[:11] + ["changed"] + cut[12:])), (23, item[4].upper().replace(" ", ", ")), (24, "so TWO  words."), (25, "twowords two, or words"), (26, None), (27, "")]
    docs += [(28, "filler " * 50_000 + item[7]), (None, item[1]), (29, item[8]), (29, "other row of it"), (30, "a a a a a")]
    return docs, items, spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, w string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_counts(tables, broadcast, monkeypatch):
    docs, items, d, b = tables
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in decontam.search(d, b).collect()} == want and len(want) >= 10
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in docs if i not in {x for x, _ in want})
    flags = {r.doc_id: (r.contaminated, r.n_items) for r in decontam.flag(d, b).collect()}
    assert all(flags[i] == (any(x == i for x, _ in want), sum(x == i for x, _ in want)) for i, _ in docs if i is not None)


def test_empty(spark, tables):
    _, _, d, b = tables
    assert decontam.search(d, b.where("false")).count() == decontam.search(d.where("false"), b).count() == 0
