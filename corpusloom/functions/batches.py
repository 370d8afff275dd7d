"""Arrow batches inside tasks: lists as flat values, and slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of rows whose sizes add up to less than ``most`` before their last row."""
    slot = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.nonzero(np.diff(slot))[0] + 1).tolist(), len(sizes)] if len(sizes) else [0]
    yield from zip(edges, edges[1:])


def lengths(lists: pa.Array) -> np.ndarray:
    """Values of each list; a null one has none."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(sizes: np.ndarray) -> np.ndarray:
    """Where each list begins among the flat values, and their number behind."""
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
