"""Lines of cells side by side as numpy arrays, for steps that take Arrow batches of gathered lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of a batch's lines that are spread out at a time; a longer line is taken for itself.
MOST = 1 << 20


def chunks(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of a batch with the sizes of their lines, of MOST cells together or one line."""
    first = 0
    ends = np.cumsum(sizes)
    while first < len(sizes):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MOST, "right")), first + 1)
        yield batch.slice(first, last - first), sizes[first:last]
        first = last


def spread(column: pa.ListArray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(scalar fields, places, values) of a column of lists of (scalars.., p: places, v: values), one element each for each of its values;
    places count from the line's start."""
    fields = column.flatten().flatten()
    size = np.diff(fields[-1].offsets.to_numpy(zero_copy_only=False))
    line = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy(zero_copy_only=False)))
    scalars = [np.repeat(f.to_numpy(zero_copy_only=False), size) for f in fields[:-2]]
    return scalars, np.repeat(starts[line], size) + fields[-2].flatten().to_numpy(zero_copy_only=False), fields[-1].flatten().to_numpy(zero_copy_only=False)
