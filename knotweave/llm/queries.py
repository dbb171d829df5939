"""The operators' queries over the driver's tables, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave.storage import spread

from . import align, ann, bpe, codes, langid, licenses, neardup, packing, sharding, substrings, toxicity, urls, vafile

SHARDS = 24
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_weighted_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), by_class=True).select("doc_id", "class_id", "class_size")


def op7_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable_vectors(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    return ann.nearest(vectors, vectors.where("key % 50 = 0"), k=5)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vafile.integer_vectors(_table(spark, sf_dir, "embeddings"), "embedding", 64, "vec_id")
    return vafile.top_inner_products(vectors, vectors.where("key % 20 = 0"), k=20)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    samples = langid.learn(docs, remainder != 1)
    named = langid.identify(docs.select("doc_id", "text", F.coalesce(remainder == 1, F.lit(False)).alias("held_out")), samples)
    return named.select("doc_id", "held_out", "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=20, rejoin=True)
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return cut.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id", F.col("label")).select(F.col("key").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels, remainder != 0)
    held_out = F.coalesce(remainder == 0, F.lit(False))
    return toxicity.score(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted", F.col("evidence.doc_id").alias("evidence"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_jump_sharding": op2_jump_sharding,
    "op3_url_filter": op3_url_filter,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_license_scan": op5_license_scan,
    "op6_weighted_near_dedup": op6_weighted_near_dedup,
    "op7_multiprobe_neighbours": op7_multiprobe_neighbours,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_toxicity": op12_toxicity,
    "op13_token_alignment": op13_token_alignment,
}


def _rounds_sql(rounds: int) -> str:
    """Assignments ``a0`` to ``a<rounds>`` and entries ``c1`` to ``c<rounds>`` of op11, one after the other."""
    nearest = """a{n} AS MATERIALIZED (SELECT p.id, p.part, arg_min(c.entry, d.d * 64 + c.entry) AS entry, min(d.d) AS d FROM p JOIN c{n} c USING (part),
      LATERAL (SELECT CAST(coalesce(list_sum(list_transform(p.x, lambda y, i: (y - c.x[i]) * (y - c.x[i]))), 0) AS BIGINT) AS d) d GROUP BY p.id, p.part)"""
    means = """m{n} AS (SELECT part, entry, spot, CAST(floor(sum(y) / count(*)) AS BIGINT) AS y FROM (SELECT p.part, a.entry, unnest(p.x) AS y, unnest(range(len(p.x))) AS spot FROM p JOIN a{n} a USING (id, part)) GROUP BY ALL),
c{next} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT part, entry, list(y ORDER BY spot) AS x FROM m{n} GROUP BY ALL) m USING (part, entry))"""
    steps = [nearest.format(n=0)]
    for n in range(rounds):
        steps += [means.format(n=n, next=n + 1), nearest.format(n=n + 1)]
    return ",\n".join(steps)


def _terms(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


_BOUNDED = "regexp_matches(u, '(^|[^\\p{L}\\p{N}])' || t || '([^\\p{L}\\p{N}]|$)')"

ORACLE_SQL = {
    "op11_vector_codes": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
p AS MATERIALIZED (SELECT id, vec_id, CAST(k AS INTEGER) AS part, v[k * (len(v) // 16) + 1 : (k + 1) * (len(v) // 16)] AS x FROM v, range(16) t(k)),
c0 AS (SELECT part, entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 64),
{_rounds_sql(codes.ROUNDS)},
told AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY id),
book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN told USING (id), book
""",
    "op8_exact_top_k": """
WITH x AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
v AS (SELECT vec_id, list_transform(e, lambda c: CAST(floor(64 * c) AS BIGINT)) AS v FROM x WHERE len(list_filter(e, lambda c: c IS NOT NULL AND isfinite(c))) = len(e)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) END AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op3_url_filter": f"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, lower(coalesce(url, '')) AS u FROM pages),
h AS (SELECT *, CAST(coalesce(list_sum(list_transform({_terms(urls.STRICT_TERMS)}, lambda t: len(regexp_extract_all(u, '(^|[^\\p{{L}}\\p{{N}}])' || t || '(?:[^\\p{{L}}\\p{{N}}]|$)')))), 0) AS INTEGER) AS strict_hits,
             CAST(len(list_filter({_terms(urls.SOFT_TERMS)}, lambda t: {_BOUNDED})) AS INTEGER) AS soft_hits FROM p),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                     WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                     WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN strict_hits > 0 OR soft_hits >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits FROM r
""",
}
