"""Groups of rows streamed from sorted partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of rows that agree in the first `keys` columns, which hold no nulls."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change) + 1, [batch.num_rows]))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            key = tuple(c[a] for c in columns)
            if key != now:
                if parts:
                    yield now, pa.Table.from_batches(parts)
                now, parts = key, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield now, pa.Table.from_batches(parts)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of complete runs, where each starts and the end), some `rows` at a time or one longer run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table, keys)
            if len(starts) > 1:  # the last run may go on
                yield table.slice(0, starts[-1]), starts
                table = table.slice(starts[-1])
            held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_starts(table, keys), table.num_rows)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows - 1, bool)
    for i in range(keys):
        column = table.column(i).to_numpy()
        change |= column[1:] != column[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def dense(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """A list column without nulls as a matrix of `width` columns, shorter lists padded with zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out
