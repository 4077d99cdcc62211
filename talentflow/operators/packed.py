"""Rows of numbers as binary columns: they cross between Spark and Python without a value at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(x: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    x = np.ascontiguousarray(x)
    ends = (np.arange(len(x) + 1, dtype=np.int64) * (x.shape[1] * x.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])


def unpack(col: pa.Array, dtype) -> np.ndarray:
    """The matrix of a column of ``pack``, of one row or more and without nulls."""
    _, ends, data = col.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[ends[0]:ends[-1]].view(dtype).reshape(len(col), -1)
