"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vicinage.sources.staging import Staged, fresh_path

__all__ = ["PIECE_BYTES", "Staged", "fresh_path", "pieces"]

#: Bytes of text that a Python worker turns into objects at once.
PIECE_BYTES = 2 << 20


def pieces(rows: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``most`` bytes of the text column
    each, or a single row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < rows.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield rows.slice(at, stop - at)
        at = stop
