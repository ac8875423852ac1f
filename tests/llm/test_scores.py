"""Held-out accuracy of both scorers, exactness of nearest examples, and edge rows."""

import random
import zlib

import numpy as np
import pytest

from tessera.llm import quality, textbytes, toxicity


def test_word_hashes():
    import pyarrow as pa

    column = pa.array(["A b\tc", None, "", "É x", "a", " \n", "b c"])
    for w in textbytes.words(column, 4):
        assert len(w.starts) == w.rows.stop - w.rows.start + 1
    whole = list(textbytes.words(column))[0]
    per_row = [whole.hashes[a:b].tolist() for a, b in zip(whole.starts[:-1], whole.starts[1:], strict=True)]
    assert [len(x) for x in per_row] == [3, 0, 0, 2, 1, 0, 2]
    assert per_row[0][0] == per_row[4][0] and per_row[0][1:] == per_row[6] and per_row[3][0] != per_row[4][0]
    sliced = list(textbytes.words(column.slice(3, 2)))[0]
    assert sliced.hashes.tolist() == per_row[3] + per_row[4]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    plain = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "tu") for b in ("ra", "ne", "so", "pi", "du", "va")]
    bad = ["grumpf", "snarly", "vexo"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        toxic, junk = i % 7 == 0, i % 5 == 0 and i % 7 != 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "a", "ing", "."]))
        if junk:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words[:6] for _ in range(8)]
        docs.append((i, " ".join(words), "x", 1))
        if i % 10 != 9:
            labels.append((i, int(not junk), int(toxic)))
    docs += [(5000, None, "y", 1), (5001, "", "y", 1), (None, "grumpf vexo snarly", "z", 1), (0, docs[0][1], "again", 2), (5002, "baba " * 40_000, "long", 3)]
    labels += [(None, 1, 1), (3, None, None), (99_999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, terms string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out(spark, labelled, module, label):
    docs, labels = labelled
    rows = module.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.95
    assert len({r.score for r in rows if r.doc_id in (5000, 5001)}) == 1 and len({r.score for r in rows if r.doc_id == 0}) == 1
    assert module.score(docs, labels.where("false")).select("score").distinct().count() == 1
    assert module.score(docs.where("false"), labels).count() == 0


def test_rejecting(labelled):
    docs, labels = labelled
    kept = toxicity.reject(docs, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and None in ids and 5000 in ids and sum(i % 7 == 0 for i in ids if i is not None and i < 900) < 15


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    vectors = [(np.sort(rng.choice(40, rng.integers(1, 9), replace=False)), None) for _ in range(700)]
    vectors = [(t, rng.integers(1, 5, len(t))) for t, _ in vectors]
    idf = rng.random(40) + 0.2
    index = toxicity.BlockMaxIndex(list(range(700)), vectors, [0] * 700, idf)
    dense = np.zeros((700, 40))
    for i, (t, c) in enumerate(vectors):
        dense[i, t] = index.weigh(t, c, idf)
    dense = dense[index.ids]
    for t, c in vectors[:60]:
        q = np.zeros(40)
        q[t] = index.weigh(t, c, idf)
        sims = np.round(dense @ q, 12)
        want = [i for i in np.lexsort((np.arange(700), -sims)) if sims[i] > 0][:15]
        at, cosines = index.nearest(t, c)
        assert np.allclose(cosines, sims[want]) and set(at) == set(want)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(3)
    x = rng.random(500)
    knots, level = toxicity.isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(level) >= 0).all() and 0 <= level.min() <= level.max() <= 1


def test_calibration_takes_every_example(spark, monkeypatch):
    rng, sizes = random.Random(8), []
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(4000)]
    rows = [(i, " ".join(rng.sample(words, 12)) + (" snarfling" if i % 8 else ""), int(i % 8 > 0)) for i in range(7000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    plain = toxicity.isotonic
    monkeypatch.setattr(toxicity, "isotonic", lambda v, y: sizes.append(len(v)) or plain(v, y))
    model, _ = toxicity.fit(docs, labels)
    assert sizes == [len(model.index.ids)] and sizes[0] > 4000


def test_votes_against_a_dense_form(spark, labelled):
    """Frequencies, weights, neighbours and scores of whole texts, from dense vectors over all examples."""
    docs, labels = labelled
    model, vectors = toxicity.fit(docs, labels)
    rows = vectors.collect()
    size = len(model.index.idf)
    counts = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        counts[i, r.terms] = r.counts
    assert np.allclose(model.index.idf, np.log(1 + len(rows) / (counts > 0).sum(0)))
    weights = (counts > 0) * (1 + np.log(np.maximum(counts, 1))) * model.index.idf
    weights /= np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    place = {r.doc_id: i for i, r in reversed(list(enumerate(rows))) if r.terms}
    chosen = [i for i in model.index.ids.tolist()]
    assert set(chosen) == {i for i in place if i is not None and i in truth and zlib.crc32(str(i).encode()) % 4 != 2}
    examples, labels_of = weights[[place[i] for i in chosen]], np.array([truth[i] for i in chosen], float)
    got = {(r.doc_id, r.score): r.evidence for r in toxicity.score(docs, labels).collect()}
    for r, x in zip(rows, weights, strict=True):
        if not len(r.terms):
            assert (r.doc_id, model.bare) in got
            continue
        sims = np.round(examples @ x, 12)
        best = [i for i in np.lexsort((np.arange(len(sims)), -sims)) if sims[i] > 0][:15]
        w = 1 / (1.05 - np.minimum(sims[best], 1))
        vote = (w @ labels_of[best] + model.bare / 1.05) / (w.sum() + 1 / 1.05)
        scored = [(s, e) for (d, s), e in got.items() if d == r.doc_id and abs(s - np.interp(vote, *model.knots)) < 1e-9]
        assert scored and sorted(np.round(examples[[chosen.index(i) for i in scored[0][1]]] @ x, 9)) == sorted(np.round(sims[best], 9))


def test_context_vectors_against_a_direct_form(spark):
    import pyarrow as pa

    rng = random.Random(7)
    texts = [" ".join(rng.choice(["stone", "River,", "OLD", "mill", "x1", "the", "the"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [None, "", "one", "a  a a"]
    sums = np.zeros((quality.WORDS + quality.SHAPES, quality.SIZE))
    whole = [w for w in textbytes.words(pa.array(texts))][0]
    words, shapes = quality.entries(whole)
    for a, b in zip(whole.starts[:-1], whole.starts[1:], strict=True):
        for k in range(a, b):
            for other in (k - 1, k + 1):
                if a <= other < b:
                    for entry in (words[k], shapes[k]):
                        sums[entry] += quality._INDEX[words[other]] + quality._INDEX[shapes[other]]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    got = quality.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    assert np.allclose(got, want, atol=2e-5)
    pooled = quality.pooled(whole, got)
    for i, (a, b) in enumerate(zip(whole.starts[:-1], whole.starts[1:], strict=True)):
        v, s = got[words[a:b]].astype(float), got[shapes[a:b]].astype(float)
        direct = np.concatenate([v.mean(0), v.std(0), s.mean(0)]) if b > a else np.zeros(3 * quality.SIZE)
        assert np.allclose(pooled[i], direct, atol=1e-3)
    assert (np.count_nonzero(quality._INDEX, axis=1) == 4).all()
