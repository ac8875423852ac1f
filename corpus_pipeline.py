"""The corpus pipeline: five filters and writers over documents, each on what the one before kept.

``run(spark, sf_dir)`` applies all stages to the table of documents. A stage takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of documents. ``benchmark`` and ``labels`` come from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, linedup, neardup, packing, toxicity
from tessera.runtime import Scratch, releasing, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; what loses all its text by that is gone."""
    return linedup.dedup_lines(docs, drop_emptied=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates on shingles of five words."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids; workers remember fewer words, as other stages ran before."""
    return packing.pack(docs, cache=200_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learnt scores and a tokenizer can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with releasing():  # the stage's own tables go when its result is written
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
