"""Arrow batches as numpy arrays, for the operators which run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix_of(column: pa.Array) -> np.ndarray:
    """Equal-length Arrow lists as a 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def list_rows(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of every element of a list column, and the elements, without Python objects."""
    lengths = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def layer_slices(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Parts of a batch which belong to one (tag, layer)."""
    tags = batch["tag"].dictionary_encode()
    layers = batch["layer"].to_numpy()
    code = tags.indices.to_numpy().astype(np.int64) << 32 | layers
    for c in np.unique(code):
        key = (tags.dictionary[int(c >> 32)].as_py(), int(c & 0xFFFFFFFF))
        here = code == c
        yield key, batch if here.all() else batch.filter(pa.array(here))
