"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows that arrive sorted by ``keys``, joined so that no group is cut."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        columns = [rows.column(k).to_numpy(zero_copy_only=False) for k in keys]
        last = np.logical_and.reduce([c == c[-1] for c in columns])
        begin = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        same = held and all(held[-1].column(k)[-1].as_py() == rows.column(k)[0].as_py() for k in keys)
        if begin == 0 and same:
            held.append(rows)
            continue
        if held and not same:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if begin:
            yield pa.concat_tables([*held, rows.slice(0, begin)]).combine_chunks()
            held = []
        held.append(rows.slice(begin))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the stretches of equal rows in sorted key columns."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, dtype=np.int64)
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n]))


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node each one can reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if (label == before).all() and not len(a):
            break
    return label


def binary_rows(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed numbers, and the bounds per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    width = np.dtype(dtype).itemsize
    values = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].view(dtype) if data else np.empty(0, dtype)
    return values, (offsets - offsets[0]) // width


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The reverse of :func:`binary_rows`."""
    width = values.dtype.itemsize
    offsets = pa.py_buffer(np.ascontiguousarray(bounds * width, dtype=np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])
