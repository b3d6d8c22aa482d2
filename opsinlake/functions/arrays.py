"""Arrow batches to numpy and back, for the vectorised column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(a: pa.Array, width: int):
    """List column to a dense (rows, width) matrix plus a validity mask; a row of another length is an error."""
    ok = np.asarray(a.is_valid())
    size = a.value_lengths().to_numpy(zero_copy_only=False)[ok]
    if len(size) and (size != width).any():
        raise ValueError(f"a spectrum of {int(size[size != width][0])} values meets a kernel for {width}")
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width), ok


def lists(values: np.ndarray, ok: np.ndarray, dtype) -> pa.Array:
    """Dense rows back to a list column; rows that were null stay null."""
    width = values.shape[1]
    offsets = np.zeros(len(ok) + 1, dtype=np.int32)
    np.cumsum(np.where(ok, width, 0), out=offsets[1:])
    body = pa.array(values.astype(dtype).ravel())
    return pa.ListArray.from_arrays(pa.array(offsets), body, mask=pa.array(~ok))


def ragged(values: np.ndarray, lengths: np.ndarray, ok: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    missing = np.isnan(values)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(values, mask=missing, type=pa.float64()), mask=pa.array(~ok)
    )
