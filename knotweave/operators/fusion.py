"""Fusing rankings: min-max, score fusion, reciprocal ranks, re-ranking, blends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.functions import vectors as V
from knotweave.storage import broadcast_if_small, is_small

RRF_K, RERANK_HEAD = 60, 20
NOTES_BETA, CODE_BETA, CODE_POOL = 0.5, 1.0, 50


def minmax(value: Column, over: Window) -> Column:
    """Scaled to 0 to 1 over a window; 0 if all are equal."""
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))


def pool_size(k: int, hybrid: bool = True, dedupe: str = "section") -> int:
    """How many candidates the dense side hands to fusion."""
    if hybrid:
        return max(3 * k, 30)
    return k if dedupe == "none" else 3 * k


def fuse(dense: DataFrame, sparse: DataFrame, key: Sequence[str], topn: int, beta: float, backfill: DataFrame | None = None, by: Sequence[str] = ("query_id",), alias: DataFrame | None = None) -> DataFrame:
    """``by... key... cosine sparse score rank``: cosine plus ``beta`` times the pool's min-maxed sparse score.

    The pool is the ``topn`` of ``dense`` (column ``cosine``) by cosine, the
    ``topn`` of ``sparse`` (column ``sparse``, above 0), and all of ``alias``
    (column ``cosine``; the greater of two cosines counts). Pool members without
    a cosine take it from ``backfill``, else 0; without a sparse score they have
    0. Order is by the exact score, ties by key; then it is cut to ``topn`` and
    rounded to 4 digits.
    """
    on = [*by, *key]
    cut = lambda rows, score: rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), *key))).where(F.col("__r") <= topn).drop("__r")
    near, lexical = cut(dense.select(*on, "cosine"), "cosine"), sparse.where(F.col("sparse") > 0).select(*on, "sparse")
    members = near.select(*on).union(cut(lexical, "sparse").select(*on))
    cosines = near
    if alias is not None:
        members = members.union(alias.select(*on))
        cosines = near.unionByName(alias.select(*on, "cosine")).groupBy(*on).agg(F.max("cosine").alias("cosine"))
    pool = members.distinct().join(cosines, on, "left").join(lexical, on, "left")
    if backfill is not None:
        pool = pool.join(backfill.select(*on, F.col("cosine").alias("__back")), on, "left").withColumn("cosine", F.coalesce("cosine", "__back")).drop("__back")
    pool = pool.withColumns({"cosine": F.coalesce("cosine", F.lit(0.0)), "sparse": F.coalesce("sparse", F.lit(0.0))})
    scored = pool.withColumn("__exact", F.col("cosine") + beta * minmax(F.col("sparse"), Window.partitionBy(*by)))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("__exact", 9).desc(), *key)))
    return ranked.where(F.col("rank") <= topn).withColumn("score", F.round("__exact", 4)).drop("__exact")


def fuse_code(dense: DataFrame, sparse: DataFrame, coverage: DataFrame, described: DataFrame, key: Sequence[str], by: Sequence[str] = ("query_id",), pool: int = CODE_POOL) -> DataFrame:
    """Code fusion: coverage gates the sparse side, and beta is 1.

    ``described`` lists the keys of symbols that have a description. One without
    has cosine -1, or 0 if no symbol has any.
    """
    on = [*by, *key]
    gated = sparse.join(coverage, on).select(*on, (F.col("sparse") * F.col("coverage")).alias("sparse")).where("sparse > 0")
    any_described = described.select(F.lit(True).alias("__any")).limit(1)
    missing = F.when(F.col("__any"), -1.0).otherwise(0.0)
    members = dense.select(*on).union(gated.select(*on)).distinct()
    fallback = members.join(described.select(*key, F.lit(True).alias("__has")), [*key], "left").join(F.broadcast(any_described), how="left")  # one row
    fallback = fallback.where("__has is null").select(*on, missing.alias("cosine"))
    return fuse(dense, gated, key, pool, CODE_BETA, backfill=dense.select(*on, "cosine").unionByName(fallback), by=by)


def alias_merge(aliases: DataFrame, first_chunks: DataFrame, weight: float = 1.0, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """A section's best alias cosine, times ``weight``, on the section's first chunk.

    ``aliases`` has ``by... section cosine``; ``first_chunks`` has ``section chunk_id window_idx``.
    """
    best = aliases.groupBy(*by, "section").agg((F.max("cosine") * weight).alias("cosine"))
    first = first_chunks.groupBy("section").agg(F.min_by("chunk_id", F.struct("window_idx", "chunk_id")).alias("chunk_id"))
    return best.join(first, "section").select(*by, "chunk_id", "cosine")


def rrf(lists: DataFrame, by: Sequence[str] = ("query_id",), key: str = "id", k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: ``by... key score rank``.

    ``lists`` has ``list_no rank key`` with ranks from 1, and ``weight`` if lists
    count differently. Ties keep the order in which keys are first seen: by
    list, then rank.
    """
    weight = F.col("weight") if "weight" in lists.columns else F.lit(1.0)
    fused = lists.groupBy(*by, key).agg(F.sum(weight / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("__first"))
    order = Window.partitionBy(*by).orderBy(F.round("score", 12).desc(), "__first", key)
    return fused.withColumn("rank", F.row_number().over(order)).drop("__first")


def rerank(ranked: DataFrame, scorer: Column, by: Sequence[str] = ("query_id",), head: int = RERANK_HEAD, ties: Sequence[str] = ()) -> DataFrame:
    """Re-order the first ``head`` rows by min-maxed score plus min-maxed ``scorer``.

    Scores are not rewritten, and rows behind the head keep their ranks. Equal
    sums keep the earlier rank. A null from the scorer leaves that query as it was.
    """
    own = Window.partitionBy(*by, "__head")
    marked = ranked.withColumn("__head", F.col("rank") <= head).withColumn("__ce", F.when(F.col("__head"), scorer.cast("double")))
    broken = F.max(F.col("__ce").isNull()).over(own)
    value = F.when(F.col("__head") & ~broken, minmax(F.col("score"), own) + minmax(F.col("__ce"), own)).otherwise(F.lit(0.0))
    scored = marked.withColumn("__value", value)
    order = Window.partitionBy(*by).orderBy(F.desc("__head"), F.round("__value", 9).desc(), "rank", *ties)
    return scored.withColumn("__new", F.row_number().over(order)).drop("rank", "__head", "__ce", "__value").withColumnRenamed("__new", "rank")


def convex(rows: DataFrame, alpha: float, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """``alpha`` min-maxed cosine and 1 - ``alpha`` min-maxed sparse score."""
    own = Window.partitionBy(*by)
    return rows.withColumn("score", alpha * minmax(F.col("cosine"), own) + (1 - alpha) * by_top(F.col("sparse"), own))


def by_top(value: Column, over: Window) -> Column:
    """Divided by the largest of the window; 0 if that is 0."""
    return F.coalesce(F.try_divide(value, F.max(value).over(over)), F.lit(0.0))


def covered(rows: DataFrame, a: float, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Min-maxed cosine plus ``a`` times coverage times the sparse score."""
    own = Window.partitionBy(*by)
    return rows.withColumn("score", minmax(F.col("cosine"), own) + a * F.col("coverage") * by_top(F.col("sparse"), own))


def with_authority(rows: DataFrame, degree: DataFrame, key: Sequence[str], g: float, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Add ``g`` times the min-maxed ln(1 + in-degree) to the score."""
    joined = rows.join(degree, [*key], "left").withColumn("__a", F.log1p(F.coalesce("degree", F.lit(0)).cast("double")))
    return joined.withColumn("score", F.col("score") + g * minmax(F.col("__a"), Window.partitionBy(*by))).drop("__a", "degree")


def maxsim(candidates: DataFrame, query_vectors: DataFrame, name_vectors: DataFrame, key: str, by: str = "query_id") -> DataFrame:
    """Mean over a query's token vectors of the best cosine to a candidate's name vectors.

    ``candidates`` (query, key) bound the pairs; ``query_vectors`` have ``by
    token v``, ``name_vectors`` have ``key v``. Each task keeps one maximum for
    a token and key, however many names a key has; only those are shuffled.
    """
    asked = candidates.select(by, key).distinct().join(query_vectors.select(by, "token", F.col("v").alias("__q")), by)
    met = name_vectors.select(key, "v").join(broadcast_if_small(asked), key)
    best = met.groupBy(by, key, "token").agg(F.max(V.cosine(F.col("__q"), F.col("v"))).alias("__best"))
    return best.groupBy(by, key).agg(F.avg("__best").alias("score"))


def best_phrase(query_vectors: DataFrame, phrases: DataFrame, key: str, by: str = "query_id") -> DataFrame:
    """Largest cosine of a query to any of a key's phrase vectors.

    The queries are a stated set that meets all phrases: they must be small
    enough to travel (an error if not). Each task keeps one maximum for a query
    and key.
    """
    asked = query_vectors.select(by, F.col("v").alias("__q"))
    if not is_small(asked):
        raise ValueError("too many queries for one batch: ask in several")
    return phrases.select(key, "v").crossJoin(F.broadcast(asked)).groupBy(by, key).agg(F.max(V.cosine(F.col("__q"), F.col("v"))).alias("score"))


def weighted(rows: DataFrame, weights: dict[str, float], by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Sum of weighted, min-maxed score columns: facets blended on one scale."""
    own = Window.partitionBy(*by)
    total = F.lit(0.0)
    for column, weight in weights.items():
        total = total + weight * minmax(F.coalesce(F.col(column), F.lit(0.0)), own)
    return rows.withColumn("score", total)


def fan_out(pools: DataFrame, own_project: str, key: str = "id") -> DataFrame:
    """Fuse ranked pools of several projects by reciprocal ranks, the asked project first."""
    others = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("project") != own_project, "project"))
    return rrf(pools.withColumn("list_no", others), key=key)


def route(queries: DataFrame, top_coverage: str = "coverage", at: float = 0.999) -> DataFrame:
    """Which ranker a query goes to: names if its best coverage is full, else concepts."""
    return queries.withColumn("route", F.when(F.col(top_coverage) >= at, "name").otherwise("concept"))


def oracle_rank(ranks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The best rank that any of several rankers gave; null if none found it."""
    return ranks.withColumn("oracle", F.least(*columns) if len(columns) > 1 else F.col(columns[0]))
