"""Training order: a bijection, and an exact round trip through the shards."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import training_order as order


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    a, b = (order.permute(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 16 or (a != b).any() and (a != np.arange(n)).any()


def test_round_trip(spark, tmp_path):
    rows = [(i, f"doc {i} " * (i % 40), "x") for i in range(90)] + [(None, "lost", "y"), (7, None, "z"), (8, "", None), (9, "long " * 9000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3, "text")
    folder = f"file://{tmp_path}/shards"
    got = order.order(docs, folder, length=64, per_shard=16).orderBy("slot").collect()
    n = len(got)
    assert [r.slot for r in got] == list(range(n)) and sorted(r.sequence_id for r in got) == list(range(n))
    stored = order.read_slots(folder, 0, n, 64, 16)
    assert (order.read_slots(folder, 5, 40, 64, 16) == stored[5:40]).all()  # resumed in the middle
    for r, x in zip(got, stored, strict=True):
        assert (r.shard, r.byte_offset) == (r.slot // 16, r.slot % 16 * 128) and zlib.crc32(x.tobytes()) == r.crc32
        assert order.permute(np.array([r.sequence_id]), n, 20_240_501)[0] == r.slot
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(tuple(whole.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in rows)
    by_number = sorted(zip((r.sequence_id for r in got), got, stored, strict=True), key=lambda z: z[0])
    stream = np.concatenate([x[: r.n_tokens] for _, r, x in by_number])
    pieces = sorted(map(tuple, (p.tolist() for p in np.split(stream, np.flatnonzero(stream == 2) + 1) if len(p))))
    assert pieces == want


def test_another_cluster_writes_the_same(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(120)] + [(5, "another text of five"), (None, "lost"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for parts in (3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        manifest = sorted(map(tuple, order.order(docs.repartition(parts, "text"), f"file://{tmp_path}/{parts}", length=32, per_shard=8).collect()))
        seen.append((manifest, order.read_slots(f"file://{tmp_path}/{parts}", 0, len(manifest), 32, 8).tolist()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1] and len(seen[0][0]) > 50
    assert sum(r[4] < 32 for r in seen[0][0]) <= 1  # only the stream's end is padded


def test_ids_of_another_kind_are_refused(spark, tmp_path):
    with pytest.raises(TypeError, match="whole numbers"):
        order.order(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty(spark, tmp_path):
    assert order.order(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none").count() == 0
