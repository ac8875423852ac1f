"""The interaction log, items, users and vectors as the test tables hold them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.runtime import table

CUT, HI = dt.date(2024, 1, 21), dt.date(2024, 1, 31)
WINDOWS = [(dt.date(2024, 1, 7), dt.date(2024, 1, 14)), (dt.date(2024, 1, 14), dt.date(2024, 1, 21)), (CUT, HI)]


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, ts, d, listened: one row for each play."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "ts", F.to_date("ts").alias("d"), F.col("value").alias("listened"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, duration (seconds), artist, genre, track."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), (F.col("p_size") * 10).cast("double").alias("duration"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"), F.col("p_name").alias("track"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users that answers are asked for: all of the log."""
    return table(spark, sf_dir, "events").where("user_id is not null").select("user_id").distinct()


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse log of the same shape: order lines as plays."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.to_date("o_orderdate").alias("d"), F.col("l_quantity").alias("listened"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v (doubles), label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
