"""All rows of one table against all rows of another, in cells of a grid: a cell holds a block of the left and streams its share of the right."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A cell is worth a task of its own from so many pairs.
PAIRS = 20_000_000
#: Right rows of a cell, in blocks of the left: they are streamed, but sorted by the task first.
STREAMED = 4


def sides(left: int, right: int, block: int, cores: int) -> tuple[int, int]:
    """Into how many parts the rows of either side go: blocks of at most some ``block`` rows on the left, and work for all cores."""
    block = max(1, block)
    cells = max(1, min(3 * cores, -(-left * right // PAIRS)))
    a = max(1, -(-left // block), min(left, round(cells**0.5)))
    return a, max(1, -(-cells // a), -(-right // (STREAMED * block)))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(cell, side, rows) of batches that are sorted by cell and side."""
    for b in batches:
        if b.num_rows:
            cell, side = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_cell", "_side"))
            cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                yield int(cell[lo]), int(side[lo]), b.slice(lo, hi - lo)


def _by_cell(work: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groupby(_runs(batches), key=lambda r: r[0]):
            head, more = [], None
            for _, side, rows in cell:
                if side:
                    more = rows
                    break
                head.append(rows)
            if head and more is not None:
                yield from work(head, chain([more], (rows for _, _, rows in cell)))

    return run


def meet(left: DataFrame, right: DataFrame, key: str, parts: tuple[int, int], work: Callable[[list[pa.RecordBatch], Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work(left rows of the cell, batches of its right rows)`` for each cell; both tables have the same columns.

    Every left row meets every right row in exactly one cell. Rows are shuffled once for each part of the other side,
    and a task holds one block, however large the tables are.
    """
    a, b = parts
    own = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = left.select("*", own(a).alias("_a"), every(b).alias("_b"), F.lit(0).alias("_side"))
    other = right.select("*", every(a).alias("_a"), own(b).alias("_b"), F.lit(1).alias("_side"))
    both = one.unionByName(other).withColumn("_cell", F.col("_a") * b + F.col("_b")).drop("_a", "_b")
    return both.repartitionById(a * b, F.col("_cell")).sortWithinPartitions("_cell", "_side").mapInArrow(_by_cell(work), schema)
