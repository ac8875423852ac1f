"""Near duplicates against all pairs, at sizes that reach every path: classes, buckets, blocks and pivots."""

import itertools
import random

import pytest

from tessera.llm import neardup
from tessera.operators import components as cc
from tessera.runtime import Scratch


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        if i is not None:
            sets.setdefault(i, []).append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = [(i, edited(rng, base, rng.randrange(0, 9))) for i in range(150)]  # a group with links and near misses
    rows += [(1000 + i, " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(1, 80)))) for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "One"), (2004, "one"), (2005, "ONE\ttwo"), (2006, "one two"), (2007, "É a"), (2008, "é a")]
    rows += [(3000 + i, rows[7][1]) for i in range(40)] + [(1, rows[1][1]), (None, rows[7][1]), (None, None)]
    return rows + [(4000, "very long " * 20_000), (4001, "very long " * 20_001)]


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, rows, width, small, monkeypatch):
    if small:
        monkeypatch.setattr(neardup, "GROUP", 16)
        monkeypatch.setattr(neardup, "BUCKET", 8)
        monkeypatch.setattr(neardup, "BROADCAST_BYTES", -1)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component string, n int")
    got = neardup.near_duplicates(docs, width=width).collect()
    want = brute(rows, width)
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (want[r.doc_id], want[r.doc_id] == r.doc_id)), r
    assert {r.n_shingles for r in got if r.doc_id in (2000, 2001, 2002)} == {0} and {r.n_shingles for r in got if r.doc_id == 2003} == {1}


def test_kept_rows_keep_their_columns(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows[:60]], "doc_id long, text string, kept string")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(brute(rows[:60], 5).values()))
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(501, 900)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: c for x, c in root.items() if x not in alone}


def test_components_of_a_large_star(spark):
    """A hub that outnumbers HUB, and a chain of hubs."""
    n = 100_000
    star = spark.range(1, n).selectExpr("id as a", "id % 3 * 0 + 0 as b").union(spark.range(n + 1, n + 5000).selectExpr("id as a", f"{n} as b")).union(spark.range(1).selectExpr(f"{n} as a", "7 as b")).union(spark.range(3000).selectExpr("id + 300000 as a", "400000L as b"))
    got = cc.components(star, Scratch(spark, "star"), one_task=0).groupBy("component").count().collect()
    assert {(r.component, r["count"]) for r in got} == {(0, n + 5000), (300_000, 3001)}
