"""Session transcripts, gold cases and model output as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp string, sessionId string, message struct<content: string>, _corrupt_record string"
BLOCKS = "array<struct<type: string, name: string, input: map<string,string>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """``ts sid pos tool input`` of every tool call; lines that are no JSON are skipped."""
    raw = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path).select("*", F.col("_metadata.file_name").alias("__file"))
    return tool_calls(raw.where("_corrupt_record is null").withColumn("sessionId", F.coalesce("sessionId", F.regexp_replace("__file", r"\.jsonl$", ""))))


def tool_calls(rows: DataFrame) -> DataFrame:
    """Tool calls of parsed lines, whose ``message.content`` is JSON text; other content is skipped."""
    blocks = F.from_json("message.content", BLOCKS)
    each = rows.select(F.to_timestamp("timestamp").alias("ts"), F.col("sessionId").alias("sid"), F.posexplode(blocks).alias("pos", "b"))
    return each.where("b.type = 'tool_use'").select("ts", "sid", "pos", F.col("b.name").alias("tool"), F.col("b.input").alias("input"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Gold needs: ``need_id query_id query project expect expect_heading``, one row for each phrasing.

    ``expect`` may be one path or a list; files with ``needs`` or flat ``cases`` are read.
    """
    raw = spark.read.text(path, wholetext=True).select("value")
    need = "struct<id: string, expect: string, expect_heading: string, project: string, queries: array<string>, q: string>"
    rows = raw.select(F.explode(F.coalesce(F.from_json("value", f"struct<needs: array<{need}>>").needs, F.from_json("value", f"struct<cases: array<{need}>>").cases)).alias("n"))
    listed = F.from_json("n.expect", "array<string>")
    expect = F.when(F.col("n.expect").startswith("["), listed).otherwise(F.array("n.expect"))
    phrased = rows.select(F.coalesce("n.id", "n.q").alias("need_id"), expect.alias("expect"), "n.expect_heading", "n.project", F.posexplode(F.coalesce("n.queries", F.array("n.q"))).alias("query_no", "query"))
    return phrased.withColumn("query_id", F.concat_ws("#", "need_id", "query_no")).drop("query_no")


def parse_terms(output: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key position term`` from free model output, one term for each line.

    Bullets, numbers, quotes, fences and empty lines go; the first of terms that
    are equal in any case stays.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n"), F.trim), lambda x: (x != "") & ~x.startswith("```"))
    clean = lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"^(?:[-*•]\s+|\d+[.)]\s+)", "")), "^[\"']+|[\"']+$", ""))
    each = output.select(key, F.posexplode(F.transform(lines, clean)).alias("position", "term")).where("term <> ''")
    first = each.groupBy(key, F.lower("term").alias("__k")).agg(F.min(F.struct("position", "term")).alias("s"))
    return first.select(key, "s.position", "s.term")
