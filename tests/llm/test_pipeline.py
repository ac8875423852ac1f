"""Each stage of the pipeline on what the one before kept, against brute force; and the whole run."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_linedup import brute as lines_kept
from tests.llm.test_neardup import brute as groups


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    passage, items = sentence(60), [sentence(25) for _ in range(4)]
    rows = [(i, "\n".join(sentence(rng.randrange(15, 40)) for _ in range(3))) for i in range(120)]
    rows += [(200 + i, f"{sentence(30)}\n{passage}\n{sentence(30)}") for i in range(5)]
    rows += [(300 + i, rows[i][1].replace(" ", "  ", 2) + f" extra{i}") for i in range(6)]
    rows += [(400 + i, f"{sentence(20)} {items[i]} {sentence(20)}") for i in range(4)]
    rows += [(500 + i, f"{sentence(20)} grumpf{'ae'[i % 2]} vexo {sentence(10)} snarly") for i in range(40)] + [(600, None), (601, ""), (None, "no id here")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 500)) for i, _ in rows if i is not None and i < 600], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    held = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) if name != "packing" else docs
    assert {i for i, _ in held["toxicity"]} == {i for i, _ in rows if i is None or i < 500 or i >= 600}
    want = lines_kept(held["toxicity"])
    emptied = {i for i, t in held["toxicity"] if t and t.strip() and i in want and not want[i].strip()}
    assert {300, 301} <= emptied | {i for i, t in held["line_dedup"] if t and "extra" in t} and 601 not in emptied
    assert held["line_dedup"] == sorted(((i, want.get(i, t)) for i, t in held["toxicity"] if i not in emptied), key=repr)
    assert sum(passage in (t or "") for _, t in held["line_dedup"]) == 1
    root = groups(held["line_dedup"], 5)
    assert held["near_dedup"] == [(i, t) for i, t in held["line_dedup"] if i is None or root[i] == i]
    leaks = {d for d, _ in contaminated(held["near_dedup"], list(enumerate(items)))}
    assert leaks == {400, 401, 402, 403} and held["decontamination"] == [(i, t) for i, t in held["near_dedup"] if i not in leaks]
    packed = held["packing"]
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {i for i, _ in held["decontamination"]}
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = cp.run(spark, str(tmp_path))
    rebuilt = lambda df: {d: sorted((r.start, r.length, r.doc_tokens) for r in df.where(F.col("doc_id").eqNullSafe(d)).select(columns).collect()) for d in (0, 7, 200, None)}
    assert rebuilt(whole).keys() == rebuilt(packed).keys() and all(sum(n for _, n, _ in v) == v[0][2] for v in rebuilt(whole).values())
    totals = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()), key=repr)
    assert totals(whole) == totals(packed) and len(totals(whole)) == len(held["decontamination"])
