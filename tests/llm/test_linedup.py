"""Line deduplication against all pairs of lines."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import linedup, textbytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent=80):
    """Texts after removal; rows are in order of ids, which are unique."""
    seen, out = [], {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        kept = []
        for line in t.split("\n"):
            s = set(line.translate(LOWER).split())
            if not s or not any(100 * len(s & x) >= percent * len(s | x) for x in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[i] = "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    base = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in (4, 12, 30, 60, 140)]

    def line():
        if rng.random() < 0.5:
            return " ".join(f"u{int(rng.paretovariate(0.7)) % 5000}" for _ in range(rng.randrange(0, 30)))
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, max(2, len(words) // 5))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 8)))) for i in range(160)]
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "The\nthe\nTHE end"), (904, "a b c d e\nA B C D E f"), (905, "long words " * 9000 + "\nlong words"), (None, rows[0][1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, rows, small, monkeypatch):
    if small:
        monkeypatch.setattr(linedup, "GROUP", 8)
        monkeypatch.setattr(linedup, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(linedup, "BROADCAST_BYTES", 0)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, lines string, same int")
    out = linedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got, want = out.collect(), brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (dict(rows)[r.doc_id] if r.doc_id not in want else want[r.doc_id]), r.doc_id


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same line here\nother words now"), (1, "same line here\nother words now"), (2, "same line here")], "doc_id long, text string")
    assert sorted(r.text for r in linedup.dedup_lines(docs).collect()) == ["", "same line here\nother words now", "same line here\nother words now"]
    assert linedup.dedup_lines(docs.where("false")).count() == 0


def test_long_lists_meet_in_full(monkeypatch):
    monkeypatch.setattr(linedup, "LIST", 5)
    size = np.array([1, 2, 5, 17, 3, 11])
    at = np.concatenate([[0], np.cumsum(size)])
    got = sorted((int(a), int(b)) for i, j in linedup._pairs(at, size) for a, b in zip(i, j, strict=True))
    assert got == sorted((a, b) for x, y in zip(at[:-1], at[1:], strict=True) for a in range(x, y) for b in range(a + 1, y))


def test_hot_words_meet_in_blocks(monkeypatch):
    monkeypatch.setattr(linedup, "HOT", 40)
    rng = random.Random(4)
    texts = ["\n".join(" ".join(f"w{int(rng.paretovariate(1.0))}" for _ in range(5)) for _ in range(6)) for _ in range(60)]

    class Counts:
        value = np.zeros(linedup.CELLS, np.int64)

    column = pa.array(texts)
    for w in textbytes.words(column):
        Counts.value += np.bincount((w.hashes % np.uint64(linedup.CELLS)).astype(np.int64), minlength=linedup.CELLS)
    Counts.value[Counts.value > 0] += 100  # all are hot, the common ones in several blocks
    lists = pa.array([list(range(6))] * 60, pa.list_(pa.int32()))
    rows = [r for b in linedup._postings(Counts, 80, 3)(iter([pa.record_batch([column, lists], ["text", "lines"])])) for r in b.to_pylist()]
    met, words = set(), {}
    for r in rows:
        x = np.frombuffer(r["packed"], linedup._POSTING)
        for word in np.unique(x["word"]):
            nodes = sorted(set(x["node"][x["word"] == word].tolist()))
            words.setdefault(int(word), set()).update(nodes)
            met |= {(int(word), a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :]}
    assert len({r["list"] for r in rows}) > 3 and min(r["list"] for r in rows) < 0
    assert all((w, a, b) in met for w, nodes in words.items() for k, a in enumerate(sorted(nodes)) for b in sorted(nodes)[k + 1 :])
