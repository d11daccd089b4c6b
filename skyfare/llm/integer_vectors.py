"""Vectors as rows of integers, floor(256 x), for operators that count exactly."""

from __future__ import annotations

from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256


class Shape(NamedTuple):
    """What all vectors of a table have in common: rows, components of the longest, largest integer either way."""

    rows: int
    width: int
    largest: int


def whole(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers; an empty one is."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def most(width: int) -> int:
    """The integer that components are held at, so that four times their squared distances fit in 64 bits."""
    return isqrt((1 << 58) // max(width, 1))


def shape_of(rows: DataFrame, vector: str, multiple: int) -> Shape:
    """One pass over the vectors; the width is rounded up to a multiple, as vectors are filled up with zeros."""
    farthest = F.array_max(F.transform(F.col(vector), F.abs))
    found = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("width"), F.max(farthest).alias("largest")
    ).first()
    width = -(-(found["width"] or 1) // multiple) * multiple
    # a product beyond all doubles is held at the bound as well
    return Shape(found["rows"], width, min(int(min((found["largest"] or 0.0) * SCALE, 2.0**62)) + 1, most(width)))


def integers(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as int64 rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.asarray(column.value_lengths(), np.int64)
    found = np.zeros((len(sizes), width), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        found[np.repeat(np.arange(len(sizes)), sizes), place] = np.clip(np.floor(flat * SCALE), -most(width), most(width))
    return found


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's numbers as the bytes of one binary value."""
    raw = np.ascontiguousarray(rows)
    size = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int64) * size
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), len(raw), buffers).cast(pa.binary())


def unpacked(column: pa.ChunkedArray | pa.Array, kind: str, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    values = column.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind).reshape(len(values), width)
