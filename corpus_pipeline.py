"""A corpus pipeline of the operators: language, near copies, passages, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir).
All but the last return the columns of ``documents``. :func:`run` applies them
to ``documents``, each on the written result of the one before.

All stages take null doc_ids, repeated rows and ids, and empty tables, which
stay empty; ids must be whole numbers. No stage looks at the order of rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.llm import common, langid, neardup, packing, substrings


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents of no language (null or letterless text); ``lang`` is what was identified.

    Where nothing could be learned, it stays as it is. Rows are judged each for
    itself, repeated ones alike; where two languages tie, the first by name wins.
    """
    samples = langid.learn(docs, F.lit(True))
    if not samples:
        return docs.where(langid.has_letter(F.col("text")))
    named = langid.identify(docs, samples)
    kept = named.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred"))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document in each class of near duplicates, that of least doc_id.

    A null doc_id stays only where its class has no other; of rows that share
    doc_id and text any one stays. Null texts all stay, empty ones are copies.
    """
    return neardup.keep_one(docs, neardup.near_duplicates(docs, by_class=True))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 20 words or more that occur earlier; ``n_chars`` follows the text.

    A null doc_id comes before all others; rows of one doc_id are one place, and
    none of them is earlier than another. Null texts stay null, texts of fewer
    words and those that lose none stay as they are.
    """
    cut = substrings.remove_repeats(docs, window=20)
    changed = F.col("n_removed") > 0
    return cut.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens.

    A null or empty text is the end id alone; repeated rows are packed each.
    """
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: No stage but the first part of one is SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.saved(docs)
    return docs
