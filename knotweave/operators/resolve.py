"""Resolving what callers type to symbols, and edges to symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.functions import symbols as S
from knotweave.storage import is_small

DOSSIER_CAP = 20
STRONG_TIERS = ("ref", "was", "exact")


def matches(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every symbol that a query names, with its ``tier``.

    ``queries``: query_id project query. ``symbols``: project symbol_ref file
    container name lang symbol_was. A trailing run ends with the name, so the
    pairing is an equi-join on the last segment; names that hold a separator and
    recorded spellings join by what they are. Few queries travel to the symbols;
    symbols never do, since their keys and paths are many times the files' bytes
    by which a broadcast would be planned.
    """
    canon = S.canonical(F.col("file"), F.col("container"), F.col("name"), F.col("lang"))
    was = F.coalesce("symbol_was", F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(F.col("name"), S.tail(F.col("name"))), was))
    keyed = symbols.withColumn("__canon", canon).withColumn("__key", F.explode(keys))
    typed = F.array_distinct(F.array(F.col("query"), S.query_leaf(F.col("query")), F.regexp_replace("query", "^[^#]*#", "")))
    asked = queries.withColumn("__key", F.explode(typed))
    met = keyed.join(F.broadcast(asked) if is_small(asked) else asked.hint("merge"), ["project", "__key"])
    tiered = met.withColumn("tier", S.match_tier(F.col("__canon"), F.col("name"), F.col("symbol_was"), F.col("query"))).where("tier is not null")
    return tiered.select("query_id", "project", "query", "symbol_ref", "tier").distinct()


def unique_or_refuse(found: DataFrame, callers: DataFrame) -> DataFrame:
    """One row for each query: ``status`` unique or ambiguous, the reference, the candidates.

    Tiers that pin a symbol down (ref, was, exact) win over the others. Several
    left are an error that lists them by callers, most first, then by reference.
    """
    strong = found.withColumn("__s", F.col("tier").isin(*STRONG_TIERS))
    best = strong.withColumn("__any", F.max("__s").over(Window.partitionBy("query_id"))).where(F.col("__s") == F.col("__any"))
    counted = best.join(callers.select("symbol_ref", "callers"), "symbol_ref", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("callers")).alias("n"), F.col("symbol_ref").alias("r"), F.col("tier").alias("t")))), lambda x: F.struct(x.r.alias("symbol_ref"), x.t.alias("tier")))
    out = counted.groupBy("query_id", "project", "query").agg(listed.alias("candidates"))
    one = F.size("candidates") == 1
    return out.select("query_id", "project", "query", F.when(one, "unique").otherwise("ambiguous").alias("status"), F.when(one, F.col("candidates")[0].symbol_ref).alias("symbol_ref"), F.when(one, F.col("candidates")[0].tier).alias("via"), "candidates")


def local_then_refs(queries: DataFrame, symbols: DataFrame, refs: DataFrame, callers: DataFrame) -> DataFrame:
    """Resolve in the own project; only a miss there looks into its refs.

    ``refs``: project ref position. A query without any match gets status
    ``unknown``. ``found_in`` names the project of the symbol.
    """
    own = unique_or_refuse(matches(queries, symbols), callers).withColumn("found_in", F.when(F.col("status") == "unique", F.col("project")))
    missed = queries.join(own.select("query_id"), "query_id", "left_anti")
    abroad = missed.join(refs.select("project", "ref"), "project").select("query_id", F.col("project").alias("__home"), F.col("ref").alias("project"), "query")
    found = matches(abroad.drop("__home"), symbols).join(abroad.select("query_id", "project", "__home"), ["query_id", "project"])
    hits = unique_or_refuse(found.withColumn("__p", F.col("project")).drop("project").withColumnRenamed("__home", "project"), callers)
    where = found.select("query_id", "symbol_ref", F.col("project").alias("found_in")).distinct()
    hits = hits.join(where, ["query_id", "symbol_ref"], "left").select(*own.columns)
    both = own.unionByName(hits)
    lost = queries.join(both.select("query_id"), "query_id", "left_anti").select("query_id", "project", "query", F.lit("unknown").alias("status"))
    return both.unionByName(lost, allowMissingColumns=True)


def entry_maps(symbols: DataFrame, last_wins: bool = False) -> DataFrame:
    """One symbol for each (project, name, file): the first by reference, or the last."""
    order = F.desc("symbol_ref") if last_wins else F.asc("symbol_ref")
    numbered = symbols.withColumn("__n", F.row_number().over(Window.partitionBy("project", "name", "file").orderBy(order)))
    return numbered.where("__n = 1").select("project", "name", F.col("file").alias("relpath"), "symbol_ref")


def resolve_edges(symbols: DataFrame, kind: str = "calls", last_wins: bool = False) -> DataFrame:
    """``source project target_project name relpath target resolved`` for every edge of a kind.

    Edges are ``name [location]`` strings; what no symbol answers stays, unresolved.
    """
    each = symbols.select("project", F.col("symbol_ref").alias("source"), F.explode(F.coalesce(F.col(kind), F.array().cast("array<string>"))).alias("edge"))
    decoded = each.withColumn("__e", S.decode_edge(F.col("edge"), F.col("project"))).select("source", F.col("project").alias("own"), F.col("__e.project").alias("project"), F.col("__e.name").alias("name"), F.col("__e.relpath").alias("relpath"), "edge")
    joined = decoded.join(entry_maps(symbols, last_wins), ["project", "name", "relpath"], "left")
    return joined.select("source", F.col("own").alias("project"), F.col("project").alias("target_project"), "name", "relpath", F.col("symbol_ref").alias("target"), F.col("symbol_ref").isNotNull().alias("resolved"), "edge")


def attribute_location(uri: Column, workspace: str, ref_roots: dict[str, str]) -> Column:
    """Where a reported location lies: ``rel``, ``project:rel``, the package path, or null."""
    path = F.regexp_replace(uri, "^file://", "")
    inside = lambda root: path.startswith(root.rstrip("/") + "/")
    rest = lambda root: F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    out = F.when(path.rlike("/site-packages/"), F.regexp_replace(path, "^.*/site-packages/", ""))
    for name, root in sorted([*ref_roots.items(), ("", workspace)], key=lambda r: len(r[1])):
        out = F.when(inside(root), F.concat(F.lit(f"{name}:" if name else ""), rest(root))).otherwise(out)
    return out


def xref(queries: DataFrame, symbols: DataFrame) -> DataFrame:
    """All matches of each query with their edges expanded, by kind and direction."""
    found = matches(queries, symbols)
    edges = resolve_edges(symbols, "calls").withColumn("kind", F.lit("calls"))
    for kind in ("called_by", "references"):
        if kind in symbols.columns:
            edges = edges.unionByName(resolve_edges(symbols, kind).withColumn("kind", F.lit(kind)))
    return found.join(edges.withColumnRenamed("source", "symbol_ref").drop("project"), "symbol_ref", "left")


def dossier(resolved: DataFrame, symbols: DataFrame, cap: int = DOSSIER_CAP) -> DataFrame:
    """One symbol's neighbours with descriptions, ``cap`` for each kind, and how many more."""
    edges = resolve_edges(symbols, "calls").withColumn("kind", F.lit("calls"))
    for kind in ("called_by", "references"):
        if kind in symbols.columns:
            edges = edges.unionByName(resolve_edges(symbols, kind).withColumn("kind", F.lit(kind)))
    about = symbols.select(F.col("symbol_ref").alias("target"), F.col("description").alias("target_description"))
    mine = resolved.where("status = 'unique'").select("query_id", F.col("symbol_ref").alias("source")).join(edges, "source").join(about, "target", "left")
    own = Window.partitionBy("query_id", "source", "kind")
    ranked = mine.withColumn("n", F.row_number().over(own.orderBy("edge"))).withColumn("total", F.count("*").over(own))
    return ranked.where(F.col("n") <= cap).withColumn("more", F.greatest(F.col("total") - cap, F.lit(0))).select("query_id", "source", "kind", "n", "edge", "target", "target_description", "more")


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Each path with the longest root that holds it: ``root`` and the rest, ``relpath``.

    Joins every ancestor folder of a path to the roots, so that the pairing is
    an equi-join; a path under no root has a null root.
    """
    parts = F.split(path, "/")
    numbered = paths.withColumn("__id", F.monotonically_increasing_id())
    folders = numbered.select("__id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"))
    best = folders.join(roots, "root").groupBy("__id").agg(F.max_by(F.struct("root", *(c for c in roots.columns if c != "root")), F.length("root")).alias("__r"))
    out = numbered.join(best, "__id", "left")
    rest = F.when(F.col("__r").isNotNull(), F.substring(F.col(path), F.length(F.col("__r.root")) + 2, F.length(F.col(path))))
    return out.select(*paths.columns, F.col("__r.root").alias("root"), *(F.col(f"__r.{c}").alias(c) for c in roots.columns if c != "root"), rest.alias("relpath"))
