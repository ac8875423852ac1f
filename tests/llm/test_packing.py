"""Packing: exact round trip, gapless offsets, padding only nowhere, and the curve's own property."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.tokens import Encoder


def test_hilbert_neighbours_touch():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert_key(grid, 3)
    assert sorted(keys) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_encoder_equals_the_tokenizer():
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "The THTH, édé. it's 42!! a\tb c\r\nd", "é ÉÉ <|endoftext|> x<|endoftext|>y", "İstanbul ΣΑΣ. 漢字, ñ!.", " lead  two\n\nthree ", "don't.'s", "ß. œuf. 1.2.", "A, b... c.", "x. y,", ".a", "wait..", "A.B", "_. a_,", "Été, ça."]
    got = Encoder().encode(texts)
    for t, x in zip(texts, got, strict=True):
        assert np.frombuffer(x, "<u2").tolist() == whole.encode(t or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (i * 37 % 900) + f"end {i}.", "x", 7) for i in range(60)]
    rows += [(100, None, None, None), (101, "", "y", 1), (102, "long " * 30_000, "z", 2), (5, "word " * 12, "again", 0), (None, "no id", "n", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, ids int")


def test_round_trip(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = packing.pack(docs.where("doc_id != 5 or start = 'x'")).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.doc_tokens, ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in [(r.doc_id, r.text) for r in docs.where("doc_id != 5 or start = 'x'").collect()]:
        got = sorted(pieces[doc_id], key=lambda p: p[0])
        ids = np.concatenate([p[2] for p in got]).tolist()
        assert ids == whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert {p[1] for p in got} == {len(ids)}
        assert [p[0] for p in got] == np.cumsum([0, *[len(p[2]) for p in got]])[:-1].tolist()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0  # full or a power of two: nothing is padded


def test_documents_follow_the_curve(spark, docs):
    """Along the sequences of each partition, and from one partition to the next, documents go by (key, id)."""
    rows = docs.where("(doc_id != 5 or start = 'x') and doc_id is not null")
    key = {r.doc_id: r.curve_key for r in packing.tokenise(rows).select("doc_id", "curve_key").collect()}
    first = [r for r in packing.pack(rows).collect() if r.start == 0]
    first.sort(key=lambda r: (r.sequence_id, r.offset))
    by_part = defaultdict(list)
    for r in first:
        by_part[r.sequence_id >> 32].append((key[r.doc_id], r.doc_id))
    assert [x for p in sorted(by_part) for x in by_part[p]] == sorted((k, d) for d, k in key.items())


def test_repeated_rows_and_empty_table(spark, docs):
    twice = packing.pack(docs.where("doc_id = 5")).collect()
    assert sum(r.length for r in twice) == sum(n for _, n in {(r.doc_tokens, r.doc_tokens) for r in twice})
    assert packing.pack(docs.where("false")).count() == 0
