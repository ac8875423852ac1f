"""Properties that SQL twins don't show: no look-ahead, determinism, bounds, exact literals, streams against batches."""

import datetime as dt
import json
import random
from io import StringIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import functions as fn
from tessera.operators import evaluation as ev, graph as gr, jsonkb as kb, models as md, ranking as rk, temporal as tm, vectors as vc
from tessera.sources import fixtures as fx, io
from tessera.streaming import sessions as st

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return fx.interactions(spark, SF).cache()


def test_nothing_after_the_cut_is_read(spark, log):
    items, users = fx.items(spark, SF), fx.cohort(spark, SF)
    full, cut = tm.prep(log, items, fx.CUT), tm.prep(log.where(F.col("d") < F.lit(fx.CUT)), items, fx.CUT)
    a, b = (sorted(map(tuple, rk.candidates(p, users, rk.trending_pool(p, 20)).collect()), key=repr) for p in (full, cut))
    assert a == b and a


def test_items_without_duration_are_left_out(spark):
    day = dt.date(2024, 1, 1)
    log = spark.createDataFrame([(1, i, day, 50.0) for i in range(4)], "user_id long, item_id long, d date, listened double")
    items = spark.createDataFrame([(0, 100.0), (1, 0.0), (2, None)], "item_id long, duration double")
    assert [r.item_id for r in tm.prep(log, items, dt.date(2024, 1, 3)).collect()] == [0]
    assert [r.frac for r in tm.target(log, items, day, dt.date(2024, 1, 2)).collect()] == [0.5]


def test_recommendations_keep_their_contract(spark, log):
    p = tm.prep(log, fx.items(spark, SF), fx.CUT)
    users = fx.cohort(spark, SF).union(spark.createDataFrame([(999_999,)], "user_id long"))  # one without history
    recs = rk.model_free(rk.candidates(p, users, rk.trending_pool(p, 40)), 10)
    assert not any(ev.contract(recs, users, 10).first())
    truth = tm.target(log, fx.items(spark, SF), fx.CUT, fx.HI)
    best, got = (ev.metrics(r, truth, users, 10).first() for r in (ev.oracle_top(truth, 10).drop("frac"), recs))
    assert all(b >= g - 1e-12 for b, g in zip(best, got, strict=True)) and abs(best.metric_d - 1) < 1e-9
    padded = rk.history_then_popular(p, users, 10)
    assert padded.where("user_id = 999999").count() == 0 and rk.blend(p, users, 10, 6).where("user_id = 999999").count() == 10


def test_results_do_not_depend_on_partitions(spark, log):
    users, seen = fx.cohort(spark, SF), []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        p = tm.prep(log.repartition(int(n)), fx.items(spark, SF), fx.CUT)
        seen.append(sorted((r.user_id, r.item_id, round(r.covis, 9)) for r in gr.covisitation(p, users, rk.trending_pool(p, 20)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_sessions_and_their_stream(spark, log, tmp_path):
    edge = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", 40.0), (1, 2, "2024-01-01 00:10:00", 40.0), (1, 3, "2024-01-01 00:20:01", 40.0), (1, 4, "2024-01-01 00:20:05", 5.0)], "user_id long, item_id long, ts string, listened double")
    edge = edge.withColumn("ts", F.to_timestamp("ts"))
    assert [r.sid for r in tm.sessions(edge, 600).orderBy("ts").collect()] == [1, 1, 2]  # a gap of exactly 600 s stays inside
    source = str(tmp_path / "plays")
    log.select("user_id", "item_id", F.col("ts").cast("timestamp").alias("ts"), "listened").write.parquet(source)
    stream = st.session_counts(spark.readStream.schema("user_id long, item_id long, ts timestamp, listened double").parquet(source), 21600)
    query = stream.writeStream.format("memory").queryName("sessions_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    batch = tm.sessions(log, 21600).groupBy("user_id", "sid").agg(F.count("*").alias("plays"), F.sum("listened").alias("secs"))
    a = sorted((r.user_id, r.plays, round(r.secs, 4)) for r in spark.table("sessions_out").collect())
    assert a == sorted((r.user_id, r.plays, round(r.secs, 4)) for r in batch.collect())


def test_neighbours_two_ways(spark, monkeypatch):
    v = fx.vectors(spark, SF)
    q = v.where("vec_id % 10 = 0")
    one = sorted(map(tuple, vc.neighbours(q, v, 5).collect()))
    monkeypatch.setattr(vc, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(vc, "BLOCK_NUMBERS", 3000)
    assert one == sorted(map(tuple, vc.neighbours(q, v, 5).collect()))
    rows = {r.vec_id: np.array(r.v) for r in v.collect()}
    src, dst = one[0][0], one[0][1]
    sims = sorted(((-round(float(rows[src] @ x / np.linalg.norm(rows[src]) / np.linalg.norm(x)), 6), i) for i, x in rows.items() if i != src))
    assert sims[0][1] == next(d for s, d, _, r in one if s == src and r == 1) and dst in rows


def test_perturbed_vectors_find_themselves(spark):
    v = fx.vectors(spark, SF)
    moved = v.where("vec_id % 25 = 0").withColumn("v", F.transform("v", lambda x, i: x + 0.05 * F.sin(F.col("vec_id") + i)))
    assert vc.neighbours(moved, v, 1, exclude_self=False).where("src != dst").count() == 0


def test_whitening_gives_unit_covariance(spark):
    v = fx.vectors(spark, SF)
    w = vc.Whitening(v, 8)
    x = (np.array([r.v for r in v.collect()]) - w.mean) @ w.matrix
    assert np.allclose(np.cov(x.T, bias=True), np.eye(8), atol=1e-2)
    assert vc.all_finite(w.apply(v)).first().bad == 0


def test_sinkhorn_spreads_a_crowded_target(spark):
    sims = spark.createDataFrame([(0, 0, 0.90), (0, 1, 0.10), (1, 0, 0.89), (1, 1, 0.88)], "src long, dst long, sim double")
    assert sorted(map(tuple, vc.sinkhorn(sims, 12).collect())) == [(0, 0), (1, 1)]


DOC = '{"a": {"x": 123.4500, "y": 0.250, "z": 1e3, "n": -0, "_comment": "no"}, "b": [true, null, {"c": "t"}], "2023": {"era": 4.50}, "2024": {"era": 3.10}}'


def test_literals_are_kept(spark):
    docs = spark.createDataFrame([("p", DOC), ("q", None), ("r", "")], "entity string, raw string")
    got = [(".".join(r.path), r.value) for r in kb.flatten(docs).orderBy("ord").collect()]
    assert got == [("a.x", "123.4500"), ("a.y", "0.250"), ("a.z", "1e3"), ("a.n", "-0"), ("b.0", "True"), ("b.2.c", "t"), ("2023.era", "4.50"), ("2024.era", "3.10")]


def test_questions(spark):
    leaves = kb.flatten(spark.createDataFrame([("p", DOC)], "entity string, raw string"))
    qs = spark.createDataFrame([(1, "p", "What was the era in 2024?"), (2, "p", "What was the era in 2030?"), (3, "p", "Nothing of the sort")], "qid int, entity string, question string")
    scored = kb.score(leaves, qs)
    assert {r.qid: r.answer for r in kb.answers(scored, qs).collect()} == {1: "3.10", 2: "no answer", 3: "no answer"}
    wrong = F.exists("path", lambda x: F.regexp_like(x, F.lit(kb.YEAR)) & ~F.array_contains("raw", x))
    assert kb.guarded(scored, wrong).where("qid = 1 and path[0] = '2023'").count() == 0
    assert kb.guarded(scored, wrong).where("qid = 2 and path[1] = 'era'").count() == 2  # nothing to take their place
    with_rule = kb.score(leaves, qs.where("qid = 3"), [(F.element_at("path", -1) == "z", 5.0)])
    assert kb.answers(with_rule, qs.where("qid = 3")).first().answer == "1e3"


def test_names(spark):
    teams = spark.createDataFrame([(0, "k1", "North", "Gulls", "NG"), (1, "k2", "North", "Owls", "NO")], "ord int, key string, market string, name string, abbr string")
    qs = spark.createDataFrame([(1, "Runs of the North Owls against the Gulls"), (2, "against Owls the gulls"), (3, "nothing")], "qid int, question string")
    found = kb.mentions(qs, kb.aliases(teams))
    assert {(r.qid, r.alias) for r in found.collect()} == {(1, "north owls"), (1, "gulls"), (2, "owls"), (2, "gulls")}
    assert {r.qid: r.key for r in kb.subject(found, qs).collect()} == {1: "k2", 2: "k2"}
    game = spark.createDataFrame([("g", i, ["x", "home" if i < 2 else "away", "market" if i % 2 == 0 else "name"], v) for i, v in enumerate(["North", "Owls", "North", "Gulls"])], "entity string, ord int, path array<string>, value string")
    assert tuple(kb.sides(game).select("home", "away").first()) == ("North Owls", "North Gulls")
    nodes = spark.createDataFrame([("g", ["x"]), ("g", ["x", "home"])], "entity string, node array<string>")
    assert [len(r.node) for r in kb.deepest_prefix(game, nodes).orderBy("ord").collect()] == [2, 2, 1, 1]


def test_choices(spark):
    v = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "z"), (2, "y")], "qid int, choice string")
    assert {(r.qid, r.choice, round(r.share, 3)) for r in kb.votes(v).collect()} == {(1, "a", 0.667), (2, "y", 0.5)}
    texts = spark.createDataFrame([(1, "it is 4.50 then"), (2, "E.R.A"), (3, "none")], "qid int, text string")
    values = spark.createDataFrame([(1, "4"), (1, "4.50"), (2, "era"), (3, "x9")], "qid int, value string")
    assert {r.qid: r.value for r in kb.snap(texts, values).collect()} == {1: "4.50", 2: "era", 3: None}
    c = spark.createDataFrame([(1, ""), (1, "ok"), (2, "")], "qid int, value string")
    assert {(r.qid, r.value) for r in kb.sanitise(c).collect()} == {(1, "ok"), (2, "")}


def test_sources(spark, tmp_path):
    recs = spark.createDataFrame([(u, i, i + 1) for u in (3, 5) for i in range(4)], "user_id long, item_id long, rank long")
    io.write_ranked_csv(recs, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()))[5] == (5, 5, 1, 2)
    v = fx.vectors(spark, SF).where("vec_id < 5").select("vec_id", "v")
    io.write_vectors_csv(v, str(tmp_path / "v"), 64)
    assert io.read_vectors_csv(spark, str(tmp_path / "v"), 64).count() == 5
    np.save(tmp_path / "x.npy", np.eye(3))
    assert io.read_npy(spark, str(tmp_path / "x.npy")).count() == 3
    calls = []
    build = lambda: calls.append(1) or recs
    assert io.cached(spark, str(tmp_path / "c"), build).count() == io.cached(spark, str(tmp_path / "c"), build).count() == 8 and len(calls) == 1
    with pytest.raises(FileNotFoundError):
        io.only_match(spark, str(tmp_path / "*"))
    assert io.only_match(spark, str(tmp_path / "*.npy")).endswith("x.npy")
    folder = tmp_path / "vectors"
    io.write_npy(fx.vectors(spark, SF).repartition(3), str(folder))
    stored = np.concatenate([np.load(f) for f in sorted(folder.iterdir())])
    want = np.array([r.v for r in fx.vectors(spark, SF).orderBy("vec_id").collect()])
    assert np.allclose(stored, want, atol=1e-6)
    np.save(tmp_path / "y.npy", want)
    again = io.read_npy(spark, str(tmp_path / "y.npy"), rows=64).orderBy("vec_id").collect()
    assert np.allclose(np.array([r.v for r in again]), want)


def test_one_huge_object(spark, tmp_path):
    text = '{ "a": {"x": [1, "}{", 2.50], "q\\"k": "\\\\"},\n "b\\u00e9": 123.4500, "c": "say \\"hi\\", ok", "d": [],"e": {\n"deep": {"er": [{"z": null}]}} }'
    got = dict(io.split_object(StringIO(text)))
    assert {k: json.loads(v) for k, v in got.items()} == json.loads(text) and got["b\u00e9"] == "123.4500"
    source = StringIO(text)
    assert list(dict(io.split_object(source, {"a"}))) == ["a"] and dict(io.split_object(StringIO("{}"))) == {}
    lines = tmp_path / "lines.txt"
    lines.write_text("".join(f"{k}\t{v}\n" for k, v in got.items()), encoding="utf-8")
    leaves = kb.flatten(io.read_keyed_json(spark, str(lines))).collect()
    assert {(r.entity, ".".join(r.path), r.value) for r in leaves} >= {("a", "x.2", "2.50"), ("b\u00e9", "", "123.4500"), ("a", "x.1", "}{")}


def test_functions(spark):
    df = spark.createDataFrame([("['rock', 'pop']", ["a", "stats", "era"]), ("[]", ["era"])], "g string, path array<string>")
    assert [tuple(r) for r in df.select(fn.first_of_list(F.col("g")), fn.suffix_match(F.col("path"), "stats.era")).collect()] == [("rock", True), (None, False)]
    x = spark.range(9).select((F.col("id") / 8).alias("f"))
    assert [r[0] for r in x.select(fn.quantised(F.col("f"))).collect()] == [0, 0.25, 0.25, 0.5, 0.5, 0.75, 0.75, 1, 1]


def test_learners_rank(spark):
    rng = random.Random(1)
    rows = [(u, i, float(i % 5), rng.random(), (i % 5) / 4) for u in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, a double, b double, frac double")
    top = md.boosted_ranks(df, df, ["a", "b"], 4, rounds=3).collect()
    assert len(top) == 24 and all(r.item_id % 5 == 4 for r in top)
    assert md.two_stage(df, df, ["a", "b"], rounds=2).count() == 120
