"""Column names and types of tables that aren't ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def fresh(df: DataFrame, stem: str = "__own") -> str:
    """A name that no column of df begins with, whatever the case of its letters."""
    taken = [c.lower() for c in df.columns]
    name, k = stem, 0
    while any(c.startswith(name) for c in taken):
        name, k = f"{stem}{k}_", k + 1
    return name


def need_whole_ids(df: DataFrame, id_col: str) -> None:
    """Ids that are ordered or made components of are whole numbers of 64 bits at most; others are refused before any work."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"column {id_col} holds {kind.simpleString()}: give ids that are whole numbers, such as xxhash64 of it")
