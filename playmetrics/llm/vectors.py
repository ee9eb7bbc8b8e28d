"""Embedding columns as integer matrices: which rows count, how they reach numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Entries of a matrix worked on at a time.
SLICE = 1 << 20


def whole(vector_col: str) -> Column:
    """True where the vector and all its components are there and finite."""
    ok = F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(ok, F.lit(False))


def longest(rows: DataFrame, vector_col: str) -> int:
    return rows.agg(F.max(F.size(vector_col))).first()[0] or 0


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column as float64 (rows, ``dims``); shorter vectors end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * dims:
        lens = None
    else:
        lens = column.value_lengths().to_numpy(zero_copy_only=False)
    if lens is None or (lens == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims))
    out[np.arange(dims) < lens[:, None]] = flat
    return out


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; a component too large for that is an error."""
    y = np.floor(scale * x)
    if y.size and np.abs(y).max() >= 2.0 ** 62:
        raise OverflowError("a component does not fit a long")
    return y.astype(np.int64)


def pieces(batch, dims: int):
    """``batch`` in slices of at most ``SLICE`` vector entries."""
    step = max(1, SLICE // max(dims, 1))
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the narrowest integers that hold it: equal rows, equal bytes."""
    out = [b""] * len(x)
    size = np.abs(x).max(1, initial=0)
    lower = -1
    for width in (1, 2, 4, 8):
        upper = 2 ** (8 * width - 1) - 1
        at = np.flatnonzero((size > lower) & (size <= upper))
        raw, step = x[at].astype(f"<i{width}").tobytes(), width * x.shape[1]
        for k, i in enumerate(at):
            out[i] = bytes([width]) + raw[k * step:(k + 1) * step]
        lower = upper
    return out


def unpacked(values: list[bytes], dims: int) -> np.ndarray:
    """The rows of `packed`, int64."""
    out = np.empty((len(values), dims), np.int64)
    widths = np.fromiter((v[0] for v in values), np.int64, len(values))
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        raw = b"".join(values[i][1:] for i in at)
        out[at] = np.frombuffer(raw, f"<i{width}").reshape(len(at), dims)
    return out
