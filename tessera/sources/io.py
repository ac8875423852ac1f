"""Readers and writers: CSV, Parquet, exact-literal JSON and vectors."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

INTERACTIONS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("listened_duration", T.DoubleType()), T.StructField("listened_datetime", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and a stated schema; only the columns asked for are parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """The log; the day is the first ten characters, malformed times are null."""
    df = read_csv(spark, path, INTERACTIONS)
    return df.select("user_id", "item_id", F.try_to_timestamp("listened_datetime").alias("ts"), F.expr("try_cast(substring(listened_datetime, 1, 10) as date)").alias("d"), F.col("listened_duration").alias("listened"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """Read-through table: built and written once, read afterwards."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_ranked_csv(recs: DataFrame, path: str) -> None:
    """id, user_id, item_id, rank: ids follow (user_id, rank), counted by user first so that no window spans the table."""
    per_user = recs.groupBy("user_id").agg(F.count("*").alias("n"))
    # one row for each user of the cohort
    starts = per_user.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("user_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = recs.join(starts, "user_id").select((F.col("start") + F.col("rank") - 1).alias("id"), "user_id", "item_id", "rank")
    out.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").option("header", True).csv(path)


def write_vectors_csv(vectors: DataFrame, path: str, dims: int, decimals: int = 6) -> None:
    """One column for each dimension, fixed decimals."""
    cols = [F.format_string(f"%.{decimals}f", F.col("v")[i]).alias(f"feature_{i}") for i in range(dims)]
    vectors.select("vec_id", *cols).write.mode("overwrite").option("header", True).csv(path)


def read_vectors_csv(spark: SparkSession, path: str, dims: int) -> DataFrame:
    schema = ", ".join(["vec_id long", *[f"feature_{i} double" for i in range(dims)]])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select("vec_id", F.array(*[F.col(f"feature_{i}") for i in range(dims)]).alias("v"))


def read_npy(spark: SparkSession, path: str, names: list[str] | None = None, rows: int = 4096) -> DataFrame:
    """An N x D array file as rows keyed by name or position. Executors map ``rows`` rows each of a file they all can open."""
    import numpy as np

    n = len(np.load(path, mmap_mode="r"))

    def read(batches):
        import pandas as pd

        for b in batches:
            for at in b.id:
                x = np.asarray(np.load(path, mmap_mode="r")[at * rows : (at + 1) * rows], float)
                yield pd.DataFrame({"vec_id": np.arange(at * rows, at * rows + len(x)), "v": list(x)})

    out = spark.range(max(1, -(-n // rows))).mapInPandas(read, "vec_id long, v array<double>")
    if names is None:
        return out
    table = spark.createDataFrame(list(enumerate(names)), "vec_id long, name string")
    return out.join(table, "vec_id").select(F.col("name").alias("vec_id"), "v")


def write_npy(vectors: DataFrame, folder: str) -> None:
    """A file part-<first id>.npy for each partition, in order of ids, in a folder that all executors can open."""
    import os

    import numpy as np

    def write(batches):
        import pandas as pd

        parts = [b for b in batches if len(b)]
        if parts:
            b = pd.concat(parts)
            os.makedirs(folder, exist_ok=True)
            np.save(os.path.join(folder, f"part-{int(b.vec_id.iloc[0]):012d}.npy"), np.stack(b.v.to_numpy()).astype("float32"))
        yield pd.DataFrame({"n": [sum(map(len, parts))]})

    vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("vec_id", "v").mapInPandas(write, "n long").agg(F.sum("n")).collect()


def split_object(source, wanted: set[str] | None = None):
    """(key, raw text) of each member of one huge JSON object, from a text stream, without parsing the members.

    Only the current member is in memory; with ``wanted`` the scan ends once all of them were found. Written as lines of
    key, tab and raw text (line feeds only stand between tokens there, and become blanks) it is what read_keyed_json reads.
    """
    left, depth, quoted, escaped, key, held, word = set(wanted or ()), 0, False, False, None, [], None
    for piece in iter(lambda: source.read(1 << 16), ""):
        for c in piece:
            if quoted:
                word.append(c) if depth == 1 and key is None else held.append(c)
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
                continue
            if c == '"':
                quoted = True
                if depth == 1 and key is None:
                    word = [c]
                else:
                    held.append(c)
            elif depth == 1 and key is None:
                if c == ":":
                    key, held = json.loads("".join(word)), []
                depth -= c == "}"
            elif depth == 0:
                depth += c == "{"
            elif depth == 1 and c in ",}":
                if wanted is None or key in wanted:
                    yield key, "".join(held).strip().replace("\n", " ")
                    left.discard(key)
                    if wanted is not None and not left:
                        return
                key = None
                depth -= c == "}"
            else:
                depth += c in "{["
                depth -= c in "}]"
                held.append(c)


def read_keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of key, tab, raw document: the raw text keeps every literal."""
    return spark.read.text(path).select(F.split("value", "\t", 2)[0].alias("entity"), F.split("value", "\t", 2)[1].alias("raw"))


def only_match(spark: SparkSession, pattern: str) -> str:
    """The one path that a pattern matches, in any store that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    if len(found) != 1:
        raise FileNotFoundError(f"{pattern} matches {len(found)} paths")
    return found[0].getPath().toString()
