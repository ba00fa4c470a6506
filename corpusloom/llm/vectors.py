"""Vectors of a table as integer matrices: which rows are whole, and a compact binary form of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTHS = (1, 2, 4, 8)


def is_whole(vector: str) -> Column:
    """Neither null nor holding null or non-finite entries."""
    bad = lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda x: bad(x.cast("double"))), F.lit(False))


def commonest_size(df: DataFrame, vector: str) -> int:
    """Length of most whole vectors, the greater one of two as common; 0 without any. The driver gets one row."""
    top = df.where(is_whole(vector)).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return top[0]["size"] if top else 0


def scaled(col: pa.Array, size: int, factor: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are whole, have `size` entries and stay within `most`, and floor(factor * entry) of them as a matrix of longs."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    rows = np.flatnonzero(lengths == size)
    if not size or not len(rows):
        return rows[:0], np.zeros((0, size), np.int64)
    at = (ends[rows] - size)[:, None] + np.arange(size)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(values[at] * factor)
    good = (np.abs(x) <= most).all(axis=1)  # false for what isn't finite
    return rows[good], x[good].astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as its width in bytes and its entries, little-endian; equal rows have equal bytes."""
    out: list[bytes] = [b""] * len(x)
    top = np.maximum(x, ~x).max(axis=1, initial=0)
    for w, low, high in zip(WIDTHS, (-1, *[(1 << (8 * w - 1)) - 1 for w in WIDTHS[:-1]]), [(1 << (8 * w - 1)) - 1 for w in WIDTHS], strict=True):
        rows = np.flatnonzero((top > low) & (top <= high))
        raw = np.ascontiguousarray(x[rows].astype(f"<i{w}")).tobytes()
        step, head = w * x.shape[1], bytes([w])
        for k, i in enumerate(rows.tolist()):
            out[i] = head + raw[k * step : (k + 1) * step]
    return out


def unpacked(col: pa.Array, size: int) -> np.ndarray:
    """The matrix of packed rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    starts = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col)]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(col), size), np.int64)
    if len(col) and size:
        kinds = raw[starts]
        for w in np.unique(kinds).tolist():
            rows = np.flatnonzero(kinds == w)
            out[rows] = raw[(starts[rows] + 1)[:, None] + np.arange(w * size)].view(f"<i{w}")
    return out
