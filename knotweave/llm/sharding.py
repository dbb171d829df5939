"""Sharding by jump consistent hashing.

Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm" (2014):
a key walks through ever later shards at which it would jump; the last one
below the shard count is its shard. No ring table exists, and with one more
shard a key either stays or moves into the new one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, unused

#: Rows that one (shard, chunk) group holds on average; slots are numbered there.
CHUNK_ROWS = 20_000
MIN_CHUNKS = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard (0 to ``shards`` - 1) of each 64-bit key, for all keys at once."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = np.asarray(keys).astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    live, at = np.arange(len(key)), np.zeros(len(key), np.int64)
    while len(live):
        shard[live] = at
        key = key * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0)
        at = ((at + 1).astype(np.float64) * step).astype(np.int64)
        on = at < shards
        live, at, key = live[on], at[on], key[on]
    return shard


def stable_key(rows: DataFrame, key: str) -> Column:
    """A 64-bit number for each key: whole numbers as they are, any other type by its hash."""
    whole = isinstance(rows.schema[key].dataType, T.IntegralType)
    return F.coalesce(F.col(key).cast("long") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key)), F.lit(0).cast("long"))


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of :func:`jump_hash`; ``key`` is a long, null counts as key 0."""

    @F.pandas_udf(T.IntegerType())
    def shard(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(k.to_numpy(np.int64), shards).astype(np.int32))

    return shard(F.coalesce(key, F.lit(0).cast("long")))


def shard_rows(rows: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """Give every row a ``shard``, a ``slot`` in it, and its ``grown_shard``.

    ``shard`` depends on the key and the shard count alone; ``grown_shard`` is
    the shard with one shard more. Keys may be of any type: what isn't a whole
    number counts by its 64-bit hash. ``slot`` numbers each shard's rows from 0
    without a gap. A null key counts as key 0; repeated keys share a shard and
    get different slots; an empty table stays empty; columns of ``rows`` named
    like a result column are replaced, all others are kept.

    No shard is ever sorted in one task: rows fall into chunks of about
    ``CHUNK_ROWS``, are numbered within their chunk, and start where the
    chunks before theirs end.
    """
    rows = rows.drop("shard", "slot", "grown_shard")
    number = stable_key(rows, key)
    base = saved(rows.withColumn("shard", jump_shard(number, shards)).withColumn("grown_shard", jump_shard(number, shards + 1)))
    chunks = max(MIN_CHUNKS, -(-base.count() // (CHUNK_ROWS * shards)))
    # The row number makes repeated keys spread over the chunks too; the saved
    # table's files hold it still.
    row, chunk, first = (unused(n, base.columns) for n in ("row", "chunk", "first"))
    dealt = base.withColumn(row, F.monotonically_increasing_id()).withColumn(chunk, F.pmod(F.xxhash64(row), F.lit(chunks)).cast("int"))
    starts = dealt.groupBy("shard", chunk).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", chunk, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("shard", chunk).orderBy(row)
    slotted = dealt.withColumn("slot", F.row_number().over(within).cast("long") - 1)
    return slotted.join(starts, ["shard", chunk]).withColumn("slot", F.col("slot") + F.col(first)).drop(row, chunk, first)


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Shard whole documents by ``doc_id``: sizes and checksums, without the texts.

    ``size`` is the text's UTF-8 bytes plus 8 (a null text has none);
    ``text_crc32`` is of the UTF-8 bytes, null counting as empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard_rows(sized, shards)
