"""Arrow plumbing for streaming Python operators over sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts(column: pa.ChunkedArray | pa.Array, before: object) -> np.ndarray:
    """For each row, whether its value differs from the row above; ``before`` is the value
    above the first row (``None`` if there is none). The column holds no nulls."""
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, bool)
    first = True if before is None else column[0].as_py() != before
    rest = pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[first], rest.astype(bool)])


def numbers(column: pa.Array | pa.ChunkedArray, missing: float = np.nan) -> np.ndarray:
    """A float array; nulls become ``missing``."""
    x = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    x = np.asarray(x, dtype=float)
    return np.where(np.isnan(x), missing, x) if not np.isnan(missing) else x


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal ``keys`` from batches sorted by them. Only for groups of bounded size:
    the open group is kept in memory."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        flags = np.zeros(batch.num_rows, bool)
        for i, k in enumerate(keys):
            flags |= starts(batch.column(k), None if last is None else last[i])
        at = np.flatnonzero(flags)
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
        cuts = [0, *at.tolist(), batch.num_rows]
        for i in range(len(cuts) - 1):
            if i and held:
                yield pa.Table.from_batches(held)
                held = []
            if cuts[i + 1] > cuts[i]:
                held.append(batch.slice(cuts[i], cuts[i + 1] - cuts[i]))
    if held:
        yield pa.Table.from_batches(held)
