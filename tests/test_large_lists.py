"""Registered queries whose one list is longer than a million rows keep all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotweave.operators import lexical
from knotweave.plans import retrieval

N = 1_000_100


def test_dedupe_keeps_all_sections_and_files(spark, tmp_path):
    turns = spark.range(N).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    for query in (retrieval.dedupe_section, retrieval.dedupe_file):
        found = query(spark, str(tmp_path)).agg(F.count("*"), F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.sum((F.col("rank") != F.col("conv_id") + 1).cast("int"))).first()
        assert tuple(found) == (N, 1, N, N, 0)


def test_rerank_keeps_all_of_a_nation(spark, tmp_path):
    spark.range(N).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), (-F.col("id")).cast("double").alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(19, 5.0)], "o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    out = retrieval.range_matched_rerank(spark, str(tmp_path))
    assert tuple(out.agg(F.count("*"), F.max("rank"), F.countDistinct("rank")).first()) == (N, N, N)
    assert out.where("rank > 20 and rank <> id + 1").count() == 0
    assert {r.id for r in out.where("rank <= 20").collect()} == set(range(20))


def test_numbered_groups(spark):
    rows = [(g, i) for g in (None, 1, 2) for i in range(500)]
    out = lexical.numbered(spark.createDataFrame(rows, "g int, i int"), ["g"], [F.desc("i")]).collect()
    assert sorted((r.g or 0, r.i, r.rank) for r in out) == [(g or 0, i, 500 - i) for g, i in rows]
