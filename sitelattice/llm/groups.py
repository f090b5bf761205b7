"""Whole groups from a stream of Arrow batches that is sorted by its group columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches, keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups only, with the first row of each group and the end.

    The last group of a batch is held back until the next one shows where it
    ends, so memory is bounded by a batch and the largest group.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        rows = part if held is None else pa.concat_tables([held, part])
        edges = _edges(rows, keys)
        cut = int(edges[-2])
        if cut:
            yield rows.slice(0, cut).combine_chunks().to_batches()[0], edges[:-1]
        held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0], np.array([0, held.num_rows])


def _edges(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        value = rows.column(key).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)
