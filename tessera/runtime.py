"""Session settings and the shared folder that long plans are cut at."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessera", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", memory)
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode alone a folder of our own where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_ROOTS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """A subfolder of the shared folder for this application; removed when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_dir(spark)}/tessera-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, app)
    return _ROOTS[app]


def _forget(spark: SparkSession, app: str) -> None:
    try:
        delete(spark, _ROOTS.pop(app))
    except Exception:  # the JVM may be gone already
        pass


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_OPEN: list[Scratch] = []
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


class Scratch:
    """Intermediate results of one operator, as tables in the shared folder.

    A written table ends the lineage: the loss of an executor loses none of it, and plans stay as short as one step.
    ``drop`` removes tables that no later step reads; the rest goes with ``close``, or when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.held = spark, f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}", {}
        _OPEN.append(self)
        if spark.conf.get(_BATCH_BYTES) == "67108864b":  # the default; a batch stands in memory four times over, in both processes
            spark.conf.set(_BATCH_BYTES, "8m")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{uuid.uuid4().hex[:6]}"
        # this codec works on the heap; the default one's buffers lie beside it and are freed late
        df.write.option("compression", "zstd").parquet(path)
        self.held.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.held.pop(name, []):
                delete(self.spark, path)

    def close(self) -> None:
        self.drop(*list(self.held))
        if self in _OPEN:
            _OPEN.remove(self)


@contextmanager
def releasing(keep: Scratch | None = None) -> Iterator[None]:
    """Closes what operators opened inside; for callers that write their results out before the block ends."""
    before = set(map(id, _OPEN))
    yield
    for scratch in [s for s in _OPEN if id(s) not in before and s is not keep]:
        scratch.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local_path(path: str) -> bool:
    return path.startswith(("file:", "/")) and os.path.sep == "/"


def byte_size(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory."""
    parts = [F.lit(8)]
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)) + 8)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            each = kind.elementType if isinstance(kind, T.ArrayType) else T.StringType()
            width = 8 * len(each) if isinstance(each, T.StructType) else 8
            size = F.coalesce(F.octet_length(F.to_json(column)), F.lit(0)) if isinstance(each, T.StringType) else width * F.greatest(F.size(column), F.lit(0))
            parts.append(size + 24)
        else:
            parts.append(F.lit(8))
    return sum(parts[1:], parts[0])


def broadcast_if_small(df: DataFrame, max_bytes: int) -> DataFrame:
    """df marked for broadcasting if a sum shows at most ``max_bytes`` bytes of rows; else as it is, for a shuffle join."""
    total = df.agg(F.sum(byte_size(df))).first()[0] or 0
    return F.broadcast(df) if total <= max_bytes else df


def stored_bytes(df: DataFrame) -> int | None:
    """The optimiser's estimate of df's bytes, from file sizes; None where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None
