"""What the training-data operators share: batches of bounded size, whole groups
of sorted batches, and the library's shared tables and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from skeinflow.operators.graph import components, delete, gathered, shared_path, written

__all__ = ["components", "delete", "gathered", "joined_sorted", "shared_path", "slices", "written"]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text or binary column holds about `limit` bytes (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    start, total = 0, 0
    for i, n in enumerate(lengths.to_pylist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def joined_sorted(groups: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys: a group cut by a batch end is carried on."""
    kept: list[pa.RecordBatch] = []
    for batch in groups:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            col = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            same &= col == col[-1]
        last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if not same.all():
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
            continue
        head = kept[0].slice(0, 1).select(keys).to_pylist() if kept else None
        if head and head != batch.slice(0, 1).select(keys).to_pylist():
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)
