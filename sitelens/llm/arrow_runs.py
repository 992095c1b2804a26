"""Runs of equal keys in a stream of Arrow batches that is sorted by these keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """One table per run of equal (integer) keys; only the run at hand is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        mark = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1), len(mark)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and tuple(mark[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(mark[a])
    if held:
        yield pa.Table.from_batches(held)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """A list column of equal lengths as a two-dimensional array."""
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
