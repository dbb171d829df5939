"""Retrieval quality, inventories, digests and diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotweave.functions import symbols as S

SMALL_FLOORS, LARGE_FLOORS = (0.60, 0.60), (0.69, 0.75)


def ranks(queries: DataFrame, hits: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """``need_id query_id extra... rank``: the first hit that is expected, else null.

    ``queries`` have ``expect`` (path fragments) and ``expect_heading`` (null:
    any); a hit fits if its path contains a fragment and its heading contains
    the heading, in any case.
    """
    met = queries.join(hits.select("query_id", "relpath", "heading_path", F.col("rank").alias("__rank")), "query_id", "left")
    path = F.exists("expect", lambda e: F.instr(F.col("relpath"), e) > 0)
    heading = F.col("expect_heading").isNull() | F.contains(F.lower(F.coalesce("heading_path", F.lit(""))), F.lower("expect_heading"))
    return met.groupBy("need_id", "query_id", *extra).agg(F.min(F.when(path & heading, F.col("__rank"))).alias("rank"))


def reciprocal(rank: Column) -> Column:
    return F.coalesce(F.lit(1.0) / rank, F.lit(0.0))


def within(rank: Column, k: int) -> Column:
    return F.coalesce((rank <= k).cast("double"), F.lit(0.0))


def quality(ranked: DataFrame, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """``by... n mrr recall precision_at_1`` of ranked queries."""
    r = F.col("rank")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(reciprocal(r)).alias("mrr"), F.avg(within(r, k)).alias("recall"), F.avg(within(r, 1)).alias("precision_at_1"))


def robustness(ranked: DataFrame, k: int = 3) -> DataFrame:
    """For each need: hits of its phrasings, the worst rank if all hit, whether all do."""
    hit = within(F.col("rank"), k)
    out = ranked.groupBy("need_id").agg(F.count("*").alias("phrasings"), F.sum(hit).cast("long").alias("hits"), F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("worst"))
    return out.withColumn("robust", F.col("hits") == F.col("phrasings"))


def lift(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """Queries whose rank moved: ``need_id query_id before after gain`` (of reciprocal ranks)."""
    both = baseline.select("need_id", "query_id", F.col("rank").alias("before")).join(treatment.select("need_id", "query_id", F.col("rank").alias("after")), ["need_id", "query_id"], "full")
    moved = both.where(~F.col("before").eqNullSafe(F.col("after")))
    return moved.withColumn("gain", reciprocal(F.col("after")) - reciprocal(F.col("before")))


def by_segment(ranked: DataFrame, segments: Sequence[str] = ("concept", "terse", "name"), k: int = 3) -> DataFrame:
    """Recall at k with a column for each segment."""
    cells = [F.avg(F.when(F.col("segment") == s, within(F.col("rank"), k))).alias(s) for s in segments]
    return ranked.agg(*cells)


def per_repo(ranked: DataFrame, k: int = 3) -> DataFrame:
    """Quality by repository and strategy, and of all repositories as ``ALL``."""
    r = F.col("rank")
    sets = ranked.groupingSets([["repo", "strategy"], ["strategy"]], "repo", "strategy")
    out = sets.agg(F.grouping("repo").alias("__all"), F.count("*").alias("n"), F.avg(reciprocal(r)).alias("mrr"), F.avg(within(r, k)).alias("recall"))
    return out.withColumn("repo", F.when(F.col("__all") == 1, "ALL").otherwise(F.col("repo"))).drop("__all")


def target_hit(symbol: Column, target: Column, how: str = "suffix") -> Column:
    """Whether a hit is the gold target: equal leaves, a suffix, or a substring."""
    if how == "leaf":
        return S.tail(symbol) == S.tail(target)
    if how == "suffix":
        return (symbol == target) | S.is_suffix_of(symbol, target) | S.is_suffix_of(target, symbol)
    return F.instr(symbol, target) > 0


def under_bar(measured: DataFrame, floors: tuple[float, float]) -> DataFrame:
    """Rows of quality that miss a floor of (mrr, recall)."""
    return measured.where((F.col("mrr") < floors[0]) | (F.col("recall") < floors[1]))


def require_seeded(counts: DataFrame) -> None:
    """Stop if any inventory count is not above 0."""
    empty = [r[0] for r in counts.where("n = 0").select(counts.columns[0]).limit(20).collect()]
    if empty:
        raise ValueError(f"nothing indexed: {', '.join(map(str, empty))}")


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """``project`` and a count for each table that has a project column."""
    out = None
    for name, table in tables.items():
        rows = table.select("project", F.lit(name).alias("what"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("project").agg(*(F.sum(F.when(F.col("what") == name, 1).otherwise(0)).alias(name) for name in tables))


def project_status(symbols: DataFrame) -> DataFrame:
    """Symbols, files, described and keyworded symbols of each project."""
    described = F.coalesce("description", F.lit("")) != ""
    return symbols.groupBy("project").agg(F.count("*").alias("symbols"), F.count_distinct("file").alias("files"), F.count_if(described).alias("described"), F.count_if(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0).alias("with_keywords"))


def kinds(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("project", "kind").agg(F.count("*").alias("n"))


def digest(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """An order-free digest of (k, v) pairs: SHA-256 over their own hashes' sorted text, 16 digits.

    Pairs meet in ``256`` buckets by their hash first, each digested by itself,
    so that no task holds all pairs of a store.
    """
    each = pairs.withColumn("__h", F.sha2(F.concat_ws("\x00", F.col("k").cast("string"), F.col("v").cast("string")).cast("binary"), 256))
    buckets = each.groupBy(*by, F.substring("__h", 1, 2).alias("__b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), "\n").cast("binary"), 256).alias("__d"), F.count("*").alias("__n"))
    return buckets.groupBy(*by).agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__d"))), lambda x: x["__d"]), "\n").cast("binary"), 256), 1, 16).alias("digest"), F.sum("__n").alias("n"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key change field old new``: added, removed, and each field that changed."""
    old = before.select(key, *(F.col(f).cast("string").alias(f"o_{f}") for f in fields), F.lit(True).alias("__o"))
    new = after.select(key, *(F.col(f).cast("string").alias(f"n_{f}") for f in fields), F.lit(True).alias("__n"))
    both = old.join(new, key, "full")
    one = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed")
    cells = F.filter(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new")) for f in fields)), lambda c: ~c.old.eqNullSafe(c.new))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    out = both.select(key, F.coalesce(one, F.lit("changed")).alias("change"), F.explode(F.when(one.isNotNull(), whole).otherwise(cells)).alias("c"))
    return out.select(key, "change", "c.field", "c.old", "c.new")


def churn(diff: DataFrame, edge_fields: Sequence[str] = ("calls", "called_by", "references")) -> DataFrame:
    """How often each field changed, and whether it is only an edge field."""
    return diff.where("change = 'changed'").groupBy("field").agg(F.count("*").alias("n"), F.max(F.col("field").isin(*edge_fields)).alias("edge_only"))


def gold_queries(terms: DataFrame, shortest: int = 8) -> DataFrame:
    """``query relpath heading`` harvested from enrichment terms.

    White space collapses; phrases under ``shortest`` characters go, and so do
    phrases that more than one section owns.
    """
    each = terms.select("relpath", "heading", F.explode("terms").alias("t")).withColumn("query", F.trim(F.regexp_replace("t", r"\s+", " ")))
    long_enough = each.where(F.length("query") >= shortest).withColumn("__key", F.lower("query"))
    owners = long_enough.groupBy("__key").agg(F.min(F.struct("relpath", "heading")).alias("a"), F.max(F.struct("relpath", "heading")).alias("b"), F.min("query").alias("query")).where("a = b")
    return owners.select("query", "a.relpath", "a.heading")
