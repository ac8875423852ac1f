"""Steps that grew with the table: neighbours of vectors and of users, names in questions, leaves of a task."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph as gr, jsonkb as kb, vectors as vc
from tessera.plans import registry
from tessera.sources import fixtures as fx

registry.queries()  # loads every family; a family imported before would keep the others out of the twins' tests
from tessera.plans import lookup_queries as lk, retrieval_queries as rq, vector_queries as vq  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_memory_of_a_search_is_a_tile():
    dice = np.random.default_rng(2)
    rows = dice.normal(size=(20_000, 8))
    rows[:6_000] = rows[0]
    rows, ids = vc._unit(rows), dice.permutation(20_000)
    best = vc._Nearest(ids[:600], rows[:600], 5, True, 6)
    tracemalloc.start()
    best.feed(ids, rows)
    assert tracemalloc.get_traced_memory()[1] < 120e6  # all similarities of 600 rows are 96 MB, and were held four times over for 256
    tracemalloc.stop()
    for q in (0, 1, 599):
        sim = (rows @ rows[q]).round(6)
        sim[q] = -9
        assert best.dst[q].tolist() == ids[np.lexsort((ids, -sim))[:5]].tolist()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_grid_of_odd_ids(spark, monkeypatch, kind):
    v = fx.vectors(spark, SF).where("vec_id < 90").withColumn("vec_id", F.concat(F.repeat(F.lit("x"), (F.col("vec_id") % 5).cast("int")), F.col("vec_id").cast("string")) if kind == "string" else F.col("vec_id") * 2**40)
    one = sorted(map(tuple, vc.neighbours(v, v, 100).collect()))
    monkeypatch.setattr(vc, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(vc, "BLOCK_NUMBERS", 640)
    assert one == sorted(map(tuple, vc.neighbours(v, v, 100).collect())) and len(one) == 90 * 89
    assert vc.neighbours(v.where("false"), v, 3).count() == vc.neighbours(v, v.where("false"), 3).count() == 0


def test_neighbours_are_found_once(spark, monkeypatch):
    calls, found = [], vc.neighbours
    monkeypatch.setattr(vc, "neighbours", lambda *a, **b: calls.append(1) or found(*a, **b))
    near = vq._near(spark, SF)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "FlatMapGroups" not in plan  # a table
    for name in ("_baked", "_injected"):
        assert len(calls) == 1, name
        getattr(rq, name)(*([vq._all(spark, SF), near] if name == "_baked" else [near])).count()
    assert len(calls) == 1


def test_questions_are_never_broadcast(spark, monkeypatch):
    teams, qs = lk._teams(spark, SF), lk._team_questions(spark, SF)
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin [qid" not in plan(kb.subject(kb.mentions(qs, kb.aliases(teams)), qs))
    one = sorted(map(tuple, kb.mentions(qs, kb.aliases(teams)).collect()))
    monkeypatch.setattr(kb, "NAMES_BYTES", 0)
    found = kb.mentions(qs, kb.aliases(teams))
    assert "SortMergeJoin [word" in plan(found) and one == sorted(map(tuple, found.collect())) and one


@pytest.mark.parametrize("numbers", [gr.NUMBERS, 900])
def test_users_meet_in_a_grid(spark, monkeypatch, numbers):
    dice = np.random.default_rng(4)
    plays = [(u, i, int(a), 40.0) for u in range(70) for i, a in zip(dice.integers(0, 9, 4).tolist(), dice.integers(0, 6, 4))] + [(500 + u, 3, 2, 40.0) for u in range(30)]  # a group of equal rows
    p, users = spark.createDataFrame(plays, "user_id long, item_id long, age int, listened double"), spark.createDataFrame([(u,) for u in range(0, 520, 2)], "user_id long")
    seen = []
    for growth in (10**9, 0):
        monkeypatch.setattr(gr, "JOIN_GROWTH", growth)
        monkeypatch.setattr(gr, "BLOCK_USERS", 16)
        monkeypatch.setattr(gr, "NUMBERS", numbers)
        near = sorted((r.u, r.v, round(r.sim, 9)) for r in gr.user_neighbours(p, users, 5).collect())
        plan = gr.co_listeners(p, users, 3)
        assert ("MapInArrow" in plan._jdf.queryExecution().optimizedPlan().toString()) == (growth == 0)  # no table of pairs of users
        seen.append((near, sorted(map(tuple, plan.collect()))))
    assert seen[0] == seen[1] and all(seen[0])


def test_leaves_of_a_task_are_bounded(spark, monkeypatch):
    leaves, qs = lk._leaves(spark, SF), lk._questions(spark, SF)
    one = sorted(map(tuple, kb.top_leaves(kb.score(leaves, qs), 3).select("qid", "ord", "rank").collect()))
    monkeypatch.setattr(kb, "LEAVES_A_TASK", 100)
    top = kb.top_leaves(kb.score(leaves, qs), 3).select("qid", "ord", "rank")
    plan = top._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3 and "Broadcast" not in plan
    assert sorted(map(tuple, top.collect())) == one and len(one) == 3 * qs.count()
    assert kb.deepest_prefix(leaves, lk._nodes(spark, SF))._jdf.queryExecution().sparkPlan().toString().count("REPARTITION_BY_NUM") == 2


def _exchanges(plan, found):
    """The shuffles of a final physical plan, each with whether rows were multiplied below it before another shuffle."""
    name = plan.getClass().getSimpleName()
    if name in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec"):
        return _exchanges(plan.executedPlan() if name.startswith("Adaptive") else plan.plan(), found)
    below = [_exchanges(plan.children().apply(i), found) for i in range(plan.children().size())]
    if name == "ShuffleExchangeExec":
        found.append(any(below))
        return False
    return name == "GenerateExec" or any(below)


def test_parts_are_dealt_before_their_leaves_are_made(spark, monkeypatch):
    queries = registry.queries()
    rows = lambda q: sorted(map(str, queries[q](spark, SF).collect()))
    names = ["leaf_topk", "score_margin", "audit_diff", "additive_rules", "deepest_prefix"]
    one = [rows(q) for q in names]
    monkeypatch.setattr(kb, "LEAVES_A_TASK", 100)
    assert one == [rows(q) for q in names] and all(one)
    for df in (lk._scored(spark, SF), lk._deepest(spark, SF)):
        found = []
        _exchanges(df._jdf.queryExecution().executedPlan(), found)
        assert found == [False, False] + [True] * ("score" in df.columns)  # leaves aren't shuffled before they have met; then by question


def _widths(plan, widths):
    """Numbers of partitions of the shuffles of a final physical plan, each with that of the shuffle below it, None for a file."""
    name = plan.getClass().getSimpleName()
    if name in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec"):
        return _widths(plan.executedPlan() if name.startswith("Adaptive") else plan.plan(), widths)
    below = [_widths(plan.children().apply(i), widths) for i in range(plan.children().size())]
    if name == "ShuffleExchangeExec":
        widths.append((plan.outputPartitioning().numPartitions(), *below))
        return widths[-1][0]
    return below[0] if below else None


def test_files_are_dealt_into_few_partitions_first(spark, monkeypatch):
    queries = registry.queries()
    rows = lambda q: sorted(map(str, queries[q](spark, SF).collect()))
    names = ["leaf_topk", "deepest_prefix"]
    one = [rows(q) for q in names]
    monkeypatch.setattr(kb, "LEAVES_A_TASK", 7)
    n = -(-8 * lk._parts(spark, SF).count() // 7)
    assert n > 200 and one == [rows(q) for q in names] and all(one)
    leaves, qs = lk._leaves(spark, SF), lk._questions(spark, SF)
    for df in (lk._scored(spark, SF), lk._deepest(spark, SF), kb.score(leaves, qs), kb.deepest_prefix(leaves, lk._nodes(spark, SF))):
        widths = []
        _widths(df._jdf.queryExecution().executedPlan(), widths)
        assert widths == [(200, None), (n, 200)] * 2 + [(n, n)] * ("score" in df.columns)  # a task that holds its rows reads no file


def test_questions_are_dealt_into_few_partitions_first(spark, monkeypatch):
    queries = registry.queries()
    rows = lambda: sorted(map(str, queries["leaf_answers"](spark, SF).collect()))
    one = rows()
    monkeypatch.setattr(kb, "LEAVES_A_TASK", 7)
    assert one == rows() and one
    for df in (queries["leaf_answers"](spark, SF), lk._audited(spark, SF, [])):
        widths = []
        _widths(df._jdf.queryExecution().executedPlan(), widths)
        assert [w for w in widths if w[0] > 200 and w[1] is None] == [] and len(widths) == 7


def _norms(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")


def test_norms_are_computed_once_a_row(spark):
    v = spark.createDataFrame([(i, [float(i + j + 1) for j in range(3)]) for i in range(4)], "vec_id long, v array<double>")
    pairs = spark.createDataFrame([(0, 1, 0.9), (2, 3, 0.8)], "src long, dst long, sim double")
    assert _norms(vc.normalised(v)) == 1  # one in the lambda that binds it, none in the lambda over elements
    baked = vc.bake(v, pairs, v, 0.5, 0.0)
    assert _norms(baked) == 4  # of g, of q left as it is, of q and of the sum; within one another they took the cube of the width
    unit = lambda x: np.array(x) / (np.linalg.norm(x) + 1e-12)
    at = lambda i: unit([i + j + 1 for j in range(3)])
    for r in baked.collect():
        want = unit(at(r.vec_id) + 0.5 * at(r.vec_id + 1)) if r.vec_id in (0, 2) else at(r.vec_id)
        assert np.allclose(r.v, want, atol=1e-12)
    wide = vc.normalised(spark.createDataFrame([(0, None), (1, []), (2, [3.0, None]), (3, [0.0, 0.0])], "vec_id long, v array<double>"))
    assert [r.v for r in wide.orderBy("vec_id").collect()] == [None, [], [None, None], [0.0, 0.0]]


def test_expansion_keeps_vectors_whole(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 3.0]), (3, None), (4, [])], "vec_id long, v array<double>")
    near = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (1, 2, -0.3), (2, 4, 0.4), (1, 0, None)], "src long, dst long, sim double")
    out = vc.expand(v, near, v, 2.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # a row for each number of each neighbour went through two shuffles
    got, r = {x.vec_id: x.v for x in out.collect()}, 0.5**0.5
    want = {0: np.array([1 + 0.81 * r, 0.25 + 0.81 * r]), 1: np.array([0.0, 1.0]), 2: np.array([r, r])}
    assert got.keys() == want.keys() and all(np.allclose(got[k], x / np.linalg.norm(x), atol=1e-9) for k, x in want.items())
