"""Connected components of an edge table, by alternating large and small stars, or in one task where it is small."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.runtime import Scratch

#: The tables that cut the loop's lineage have a file for so many edges.
EDGES_PER_FILE = 250_000
#: A node with more edges than HUB, and than a HUBS-th of all, takes its least neighbour from a broadcast of such nodes.
HUB, HUBS = 1_000, 100_000
#: So many edges, of some 100 bytes each while they are joined up, are left to one task; rounds over them are mostly planning.
ONE_TASK = 500_000


def _with_least(rows: DataFrame, edges: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) with m, the least v of its u; and (u, m) alone.

    Minima are partly aggregated before they are shuffled. The rows of a hub aren't shuffled by it: hubs, of which
    there are HUBS or ``2 * edges / HUB`` at most, are joined by broadcast where the rows stand.
    """
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if edges <= HUB:
        return rows.join(least.drop("n"), "u"), least.drop("n")
    hubs = F.broadcast(least.where(F.col("n") > max(HUB, 2 * edges // HUBS)).select("u", F.col("m").alias("h")))
    marked = rows.join(hubs, "u", "left")
    rest = marked.where("h is null").drop("h").join(least.drop("n"), "u")
    return marked.where("h is not null").withColumnRenamed("h", "m").union(rest.select("u", "v", "m")), least.drop("n")


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges u, v, ascending, and the smallest node that each of them reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while (apart := label[i] != label[j]).any():
        i, j = label[i[apart]], label[j[apart]]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        found = least_reachable(*[np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in (0, 1)])
        yield pa.record_batch([pa.array(x, held[0].schema.field(0).type) for x in found], ["node", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str = "components", one_task: int = ONE_TASK) -> DataFrame:
    """node and component (the smallest node reachable) for every node of edges ``a``, ``b``.

    Each round points the neighbours of a node at the smallest of them, so components shrink to stars around their
    smallest nodes in a logarithmic number of rounds. At most ``one_task`` edges are joined up by one task on an
    executor instead, with the same result. Loops, nulls and repeated edges do no harm.
    """
    after = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a != b").distinct(), f"{name}_0")
    state, before, turn = _state(after), None, 0
    if state[0] <= one_task:
        kind = after.schema["u"].dataType.simpleString()
        found = scratch.write(after.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, component {kind}"), f"{name}_found")
        scratch.drop(f"{name}_0")
        return found
    while state != before:
        edges, before, turn = after, state, turn + 1
        files = -(-state[0] // EDGES_PER_FILE) or 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _with_least(both, state[0])
        large = large.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
        small, least = _with_least(large, state[0])
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = scratch.write(small.where("u != v").distinct().coalesce(files), f"{name}_{turn}")
        state = _state(after)
        scratch.drop(f"{name}_{turn - 1}")
    nodes = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
