"""Hash embeddings of whole tables, as sparse rows: one aggregation, no per-row loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotweave.functions.text import py_words
from knotweave.functions.vectors import DIM


def sparse(rows: DataFrame, key: Sequence[str], text: str, dim: int = DIM) -> DataFrame:
    """``key... i w``: the non-zero components of each text's unit vector.

    The same vector as ``hash_embedding``: words by MD5 into ``dim`` signed
    buckets. Texts whose vector is zero have no row.
    """
    word = rows.select(*key, F.explode(py_words(F.lower(F.coalesce(F.col(text), F.lit(""))))).alias("w")).groupBy(*key, "w").agg(F.count("*").alias("n"))
    hashed = word.withColumn("d", F.md5(F.col("w").cast("binary")))
    place = F.pmod(F.conv(F.substring("d", 31, 2), 16, 10).cast("int"), F.lit(dim))
    sign = F.when(F.conv(F.substring("d", 30, 1), 16, 10).cast("int") % 2 == 1, 1.0).otherwise(-1.0)
    summed = hashed.groupBy(*key, place.alias("i")).agg(F.sum(sign * F.col("n")).alias("x")).where("x <> 0")
    length = summed.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("__n"))
    return summed.join(length, [*key]).select(*key, "i", (F.col("x") / F.col("__n")).alias("w"))


def dense(vectors: DataFrame, key: Sequence[str], dim: int = DIM) -> DataFrame:
    """``key... v``: sparse rows as arrays."""
    entries = F.map_from_entries(F.collect_list(F.struct("i", "w")))
    return vectors.groupBy(*key).agg(entries.alias("m")).select(*key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


def cosines(queries: DataFrame, corpus: DataFrame, query_key: Sequence[str], key: Sequence[str]) -> DataFrame:
    """``query_key... key... cosine`` of all pairs that share a component, by an equi-join on it."""
    asked = queries.select(*query_key, "i", F.col("w").alias("__q"))
    return asked.join(corpus.select(*key, "i", "w"), "i").groupBy(*query_key, *key).agg(F.sum(F.col("__q") * F.col("w")).alias("cosine"))
