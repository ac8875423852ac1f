"""Components against a plain union of sets, in one task and by rounds."""

import random

import pytest

from tessera.operators import components as cc
from tessera.runtime import Scratch


def plain(edges):
    group = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        one = group.get(a, {a}) | group.get(b, {b})
        group |= dict.fromkeys(one, one)
    return {x: min(g) for x, g in group.items()}


@pytest.mark.parametrize("one_task", [cc.ONE_TASK, 0])
def test_either_way(spark, one_task):
    dice = random.Random(7)
    edges = [(dice.randrange(300) - 50, dice.randrange(300) - 50) for _ in range(140)]
    edges += [(1000 + k, 1001 + k) for k in range(40)] + [(2**62, -(2**62)), (5, 5), (7, None), (None, None)] + edges[:20]
    got = cc.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "either"), one_task=one_task).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == plain(edges)


@pytest.mark.parametrize("one_task", [cc.ONE_TASK, 0])
def test_texts_and_no_edges(spark, one_task):
    texts = spark.createDataFrame([("b", "é"), ("é", "a"), ("z", "y")], "a string, b string")
    got = {r.node: r.component for r in cc.components(texts, Scratch(spark, "texts"), one_task=one_task).collect()}
    assert got == {"a": "a", "b": "a", "é": "a", "z": "y", "y": "y"}
    assert cc.components(texts.where("false"), Scratch(spark, "none"), one_task=one_task).count() == 0


def test_one_task_follows_a_long_chain():
    import numpy as np

    dice = np.random.default_rng(3)
    name = dice.permutation(100_000) * 3
    nodes, least = cc.least_reachable(name[:-1], name[1:])
    assert len(nodes) == 100_000 and (least == 0).all()
    star = np.arange(1, 300_000)
    assert (cc.least_reachable(star, np.zeros_like(star))[1] == 0).all()
