"""Vectors as bytes, for the two searches: what takes part, repeats, exact sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors that one block holds at most (a longer vector is a block of its own).
BLOCK_BYTES = 32 << 20


def finite_vectors(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """``key`` and ``x`` (doubles) of rows whose key, vector and components are not null and finite."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return rows.where(F.col(key).isNotNull() & x.isNotNull() & finite).select(F.col(key).cast("long").alias("key"), x.alias("x"))


def as_bytes(rows: DataFrame, scale: float | None = None) -> DataFrame:
    """``key dim v``: the doubles of ``x`` as little-endian bytes; ``scale``: floor(scale * x) instead."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            x = lists.values.to_numpy(zero_copy_only=False).astype("<f8")[at[0] : at[-1]]
            x = (x if scale is None else np.floor(scale * x)) + 0.0  # a negative zero is a zero
            if not np.isfinite(x).all():
                raise OverflowError("a component times the scale is beyond a double")
            ends = ((at - at[0]) * 8).astype(np.int32)
            v = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int32)), v], ["key", "dim", "v"])

    return rows.mapInArrow(pack, "key bigint, dim int, v binary")


def entries(packed: DataFrame, spare: int) -> DataFrame:
    """One row for each key and vector; of equal vectors, those of the ``spare`` smallest keys.

    Ties go to smaller keys, so with ``spare`` of them ahead no other row of an
    equal vector can be among a query's ``spare - 1`` best: what is left out
    can't be in a result. A vector that a third of all rows hold is so few rows.
    """
    equal = Window.partitionBy("dim", "v").orderBy("key")
    return packed.distinct().withColumn("place", F.row_number().over(equal)).where(F.col("place") <= spare).drop("place")


def matrix(raw, rows: int, dim: int) -> np.ndarray:
    """``rows`` vectors from their joined bytes."""
    return np.frombuffer(raw, "<f8").reshape(rows, dim)


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a binary column, all of one length."""
    return matrix(b"".join(column.to_pylist()), len(column), dim)


def own_rows(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``asked``, place in ``keys``) of all equal pairs."""
    order = np.argsort(keys, kind="stable")
    first, last = (np.searchsorted(keys, asked, side, sorter=order) for side in ("left", "right"))
    many = last - first
    at = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.arange(len(asked)), many), order[at]
