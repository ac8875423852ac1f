"""Groups of consecutive rows from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole runs of equal keys (an int64 column), each as large as the runs it came from."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0  # where the last run begins
        if cut or held and held[0].column(key)[0].as_py() != keys[0]:
            done = [*held, batch.slice(0, cut)] if cut else held
            held = []
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the length."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, int)
