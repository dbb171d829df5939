"""Helpers that the operators share: worker caches, Arrow buffers, hashes."""

from __future__ import annotations

import sys

import numpy as np

from pyspark.sql.types import IntegralType

from knotweave.storage import forget, saved

__all__ = ["forget", "mix64", "require_whole_ids", "saved", "small_batches", "string_buffers", "unused", "worker_cache"]


def small_batches(df):
    """``df``, with the session's Arrow batches bounded by bytes and rows.

    Texts of any length pass between the JVM and Python in pieces of a few
    megabytes then, on both sides, however many rows a partition has.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
    return df


def require_whole_ids(df, column: str = "doc_id") -> None:
    """An error for ids that are no whole numbers: their order and results would be undefined."""
    kind = df.schema[column].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{column} must be a whole number, not {kind.simpleString()}")


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as no column of a caller has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def worker_cache(name: str, make):
    """A value that its Python worker keeps, made on first use, until it makes another one."""
    store = sys.__dict__.setdefault("_knotweave_cache", {})
    if name not in store:
        store.clear()
        store[name] = make()
    return store[name]


def string_buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, bytes, is_null) of an Arrow string column, without a copy.

    A null has no bytes.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[at[0] : at[-1]]
    null = np.asarray(column.is_null())
    return at - at[0], raw, null


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
