"""Vectors in Arrow columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array, dim: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(usable, values): which vectors of a list column are not null and hold no null and no non-finite entry, and these as rows of doubles, of the longest vector's length or dim. A shorter vector counts as ending in zeros."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
    held = np.maximum(size, 0)
    dim = max(dim, int(held.max(initial=0)))
    x = np.zeros((len(size), dim))
    at = np.repeat(np.arange(len(size)), held)
    x[at, np.arange(len(flat)) - np.repeat(np.cumsum(held) - held, held)] = flat
    usable = (size >= 0) & np.isfinite(x).all(axis=1)
    return usable, x[usable]
