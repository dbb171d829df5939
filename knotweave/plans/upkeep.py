"""Queries over the index's upkeep, lookups' filters, decisions' listings and notes' identities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotweave.functions import symbols as S
from knotweave.functions import text as T
from knotweave.operators import chunking, decisions, evaluate, fusion, graph, index, learnings, resolve, retrieve, usage

from . import retrieval, structure
from .retrieval import table

PATH = ["project", "store", "relpath"]


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: languages are projects, every ninth comes from a source."""
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("project"), F.when(k % 4 == 0, "design").otherwise("notes").alias("store"), F.concat(F.when(k % 9 == 0, "sources/").otherwise(""), F.lit("d"), k.cast("string"), F.lit(".md")).alias("relpath"), "text")


def _records(spark, sf_dir):
    """Parts as symbol records: sizes are files, brands are projects."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    edge = lambda name, size: F.concat(F.lit(name), F.lit(" [f"), size.cast("string"), F.lit(".py]"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("project"),
        F.concat(F.lit("f"), s, F.lit(".py")).alias("file"),
        F.concat(F.lit("n"), k.cast("string")).alias("symbol_ref"),
        (k % 97).alias("mtime"),
        F.when(k % 11 == 0, "").otherwise("h").alias("content_hash"),
        F.when(k % 4 == 0, None).when(k % 4 == 1, "").otherwise("text").alias("description"),
        F.array(edge("a", F.col("p_size")), edge("b", F.col("p_size") % 7)).alias("called_by"),
        F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit(".toml")).alias("filename"),
        F.array(F.lit("pkg"), F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string"))).alias("scope"),
        F.when(k % 2 == 0, "python").otherwise("lua").alias("lang"),
    )


def commit_snapshot(spark, sf_dir):
    fresh, stored = structure._stored(spark, sf_dir)
    stored = stored.withColumn("v", F.concat(F.lit("v"), F.col("doc_id").cast("string")))
    return index.apply(stored, fresh, index.plan(fresh, stored, "doc_id", ["source"]), "doc_id").select("doc_id", "source", "content_hash", "v", "action")


def reconcile_targets(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return index.targets(notes.where("doc_id % 3 <> 0"), notes.where("doc_id % 5 <> 0"))


def missing_files(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return index.missing_files(notes, notes.where("doc_id % 3 <> 0")).select("doc_id")


def forget_paths(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return index.forget(notes, notes.where("doc_id % 7 = 0")).select("doc_id")


def rebuild_projects(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").alias("project"), F.when(F.col("label") == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("v"))
    return index.rebuilds(vectors, 64)


def schema_sweep(spark, sf_dir):
    markers = table(spark, sf_dir, "nation").select(F.col("n_name").alias("project"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("schema"))
    return index.schema_sweep(markers, 3)


def unreadable_rows(spark, sf_dir):
    good, bad = index.split_readable(_notes(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("line "), (F.col("doc_id") % 10).cast("string"))).alias("_error")))
    return good.groupBy().agg(F.lit("read").alias("error"), F.count("*").alias("n")).union(bad.groupBy(F.col("_error").alias("error")).agg(F.count("*").alias("n")))


def code_index(spark, sf_dir):
    k = F.col("p_partkey")
    sym = structure._symbols(spark, sf_dir)
    prior = sym.select("file", "container", "name", (k % 10).cast("string").alias("content_hash"), F.concat(F.lit("d"), k.cast("string")).alias("description"), F.concat(F.lit("h"), (F.length("file") % 2).cast("string")).alias("file_hash"))
    fresh = sym.where("p_partkey % 3 <> 0").select("file", "container", "name", F.when(k % 5 == 0, "new").otherwise((k % 10).cast("string")).alias("content_hash"))
    files = sym.select("file").distinct().select("file", F.lit("h0").alias("file_hash"), (F.length("file") % 7).alias("code_lines"))
    return index.code_index(prior, fresh, files).select("file", F.array_join("container", ".").alias("container"), "name", "content_hash", "description", "state")


def dropped_file(spark, sf_dir):
    return index.drop_file(_records(spark, sf_dir), "f5.py").select("symbol_ref", F.array_join("called_by", ",").alias("called_by"))


def stale_files(spark, sf_dir):
    s = F.col("p_size") + 5
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), s.cast("string"), F.lit(".py")).alias("file"), (s / 2).cast("int").alias("mtime")).distinct()
    return index.stale_files(_records(spark, sf_dir), files)


def freshness_token(spark, sf_dir):
    return index.freshness(_records(spark, sf_dir))


def undescribed_files(spark, sf_dir):
    return index.undescribed(_records(spark, sf_dir))


def dirty_files(spark, sf_dir):
    return index.dirty_files(_records(spark, sf_dir))


def budgeted_sweep(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), "p_partkey", F.col("p_size").cast("double").alias("cost"))
    return index.budgeted(files, "cost", 100.0, ["p_partkey"]).select("p_partkey", "deferred")


def convert_records(spark, sf_dir):
    rows = _records(spark, sf_dir).select("filename", F.when(F.col("p_partkey") % 2 == 0, F.upper("symbol_ref")).otherwise(F.col("symbol_ref")).alias("name"), "file", "p_partkey")
    target = F.when(F.col("p_partkey") % 3 == 0, F.col("filename")).otherwise(F.col("file"))
    return index.convert_records(rows, {"name": F.lower("name")}, target, []).select("filename", "target", "status")


def migrate_layout(spark, sf_dir):
    return index.migrate_layout(_notes(spark, sf_dir).select("doc_id", "relpath"), "sources/", "src/")


def forget_project(spark, sf_dir):
    return index.forget_project(_notes(spark, sf_dir), "en", ["design"]).select("doc_id")


def probe_queries(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", F.md5(index.probe_query(F.col("text")).cast("binary")).alias("probe"))


def append_note(spark, sf_dir):
    heading = F.when(F.col("doc_id") % 2 == 0, "Head")
    return _notes(spark, sf_dir).select("doc_id", F.md5(index.append_note(F.col("text"), F.lit("more"), heading).cast("binary")).alias("body"))


def move_notes(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    to = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("d"), (F.col("doc_id") + 1).cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("new"), F.col("doc_id").cast("string"), F.lit(".md")))
    moves = notes.where("doc_id % 5 = 0").select("project", "relpath", F.col("project").alias("to_project"), to.alias("to_relpath"))
    return index.move_notes(notes.select("doc_id", "project", "relpath"), moves).select("doc_id", "relpath", "refused")


def stash_ids(spark, sf_dir):
    k = F.col("doc_id")
    one = lambda n, name: F.when(k % n == 0, F.lit(name)).when(k % n == 1, F.lit("")).otherwise(F.lit(None))
    return _notes(spark, sf_dir).select("doc_id", index.stash_id(one(3, "front"), one(4, "salvaged"), one(5, "incoming"), F.lit("derived")).alias("id"))


def writable_paths(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", index.writable(F.col("relpath")).alias("writable"))


def latest_records(spark, sf_dir):
    return index.latest_records(_records(spark, sf_dir).withColumn("symbol_ref", F.col("file"))).select("symbol_ref", "filename")


def portable_mtimes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "clean").otherwise("dirty")
    return o.select("o_orderkey", index.portable_mtime(status, F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")), F.col("o_orderkey") * 10).alias("mtime"))


def not_indexed(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    known = nations.where("n_regionkey = 1").select(F.col("n_name").alias("project"))
    return index.not_indexed(nations.select(F.col("n_name").alias("project")), known).select("project", F.array_join("indexed", ",").alias("indexed"))


def reindex_totals(spark, sf_dir):
    fresh, stored = structure._stored(spark, sf_dir)
    n = index.plan(fresh, stored, "doc_id", ["source"]).withColumn("project", F.col("doc_id") % 3).groupBy("project", "action").agg(F.count("*").alias("n"))
    return index.reindex_totals([n, n])


def narrowed_symbols(spark, sf_dir):
    return retrieve.narrow(_records(spark, sf_dir), "f7.py", "m2", "python").select("symbol_ref")


def floor_and_equality(spark, sf_dir):
    hits = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("kind"), F.col("p_size").alias("score"))
    return retrieve.where_equal(retrieve.above(hits, 20), score=30).select("p_partkey")


def span_attach(spark, sf_dir):
    talks = retrieval._talks(spark, sf_dir).select(F.lit("p").alias("project"), F.lit("notes").alias("store"), F.col("conv_id").cast("string").alias("relpath"), "body")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    hits = table(spark, sf_dir, "conversations").select(F.lit("p").alias("project"), F.lit("notes").alias("store"), F.col("conv_id").cast("string").alias("relpath"), F.col("role").alias("heading_path"), nth.alias("occurrence"), "turn")
    return retrieve.with_spans(hits, chunking.line_map(talks)).select(F.col("relpath").cast("long").alias("conv_id"), F.col("turn"), "start_line", "end_line")


def taint_marks(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return retrieve.with_taint(notes, notes.where("doc_id % 6 = 0")).select("doc_id", "tainted")


def corpus_inventory(spark, sf_dir):
    return retrieve.inventory(_notes(spark, sf_dir), "d1")


def missing_deps(spark, sf_dir):
    nodes, deps, _, _ = structure._facets(spark, sf_dir)
    notes = nodes.select("project", F.lit("none").alias("id")).distinct().where("project % 2 = 0")
    return decisions.missing_deps(nodes, deps, notes)


def _marked(spark, sf_dir):
    nodes, deps, cited, sections = structure._facets(spark, sf_dir)
    causes = structure._causes(nodes, deps, cited, sections)
    return nodes, deps, causes, decisions.tainted(nodes, deps, causes)


def decision_check(spark, sf_dir):
    nodes, _, causes, marked = _marked(spark, sf_dir)
    return decisions.check(nodes, causes, marked).select("project", "id", "status", "tainted", F.array_join("causes", ",").alias("causes"), "next")


def decision_list(spark, sf_dir):
    nodes, deps, _, marked = _marked(spark, sf_dir)
    return decisions.listing(nodes, deps, marked).select("project", "id", "title", "status", "tainted", "n_deps", "n_dependents")


def decision_dossier(spark, sf_dir):
    nodes, deps, _, marked = _marked(spark, sf_dir)
    refs = nodes.where("id rlike '[05]0$'").select("project", "id")
    return decisions.dossier(nodes, deps, marked, refs)


def learning_marks(spark, sf_dir):
    symbols, notes = structure._bound(spark, sf_dir)
    return learnings.marks(symbols, notes)


def learning_convert(spark, sf_dir):
    symbols, notes = structure._bound(spark, sf_dir)
    return learnings.convert(notes, symbols).select("relpath", "binding", "status", "symbol_ref")


def graph_marks(spark, sf_dir):
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("node"))
    return graph.marked(nodes, nodes.where("node % 4 = 0"))


def resolve_abroad(spark, sf_dir):
    symbols = structure._symbols(spark, sf_dir)
    k = F.col("p_partkey")
    queries = symbols.select(k.alias("query_id"), F.when(k % 3 == 0, "main").when(k % 3 == 1, "side").otherwise("alone").alias("project"), F.when(k % 7 == 0, "no_such_name").otherwise(F.col("name")).alias("query"))
    refs = spark.createDataFrame([("side", "empty", 0), ("side", "main", 1)], "project string, ref string, position int")
    callers = symbols.select("symbol_ref", F.lit(1).alias("callers"))
    return resolve.local_then_refs(queries, symbols, refs, callers).select("query_id", "status", "symbol_ref", "found_in")


def _called(spark, sf_dir):
    symbols = structure._symbols(spark, sf_dir)
    nxt = symbols.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("name", F.lit(" ["), "file", F.lit("]")).alias("e"))
    calls = F.filter(F.array(F.col("e"), F.lit("gone [lost.py]")), lambda x: x.isNotNull())
    return symbols.join(nxt, "p_partkey", "left").withColumn("calls", calls).withColumn("description", F.concat(F.lit("about "), "name")).drop("e")


def symbol_xref(spark, sf_dir):
    symbols = _called(spark, sf_dir)
    queries = symbols.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("query_id"), "project", F.col("name").alias("query"))
    return resolve.xref(queries, symbols).select("query_id", "symbol_ref", "tier", "kind", "edge", "target", "resolved")


def symbol_dossier(spark, sf_dir):
    symbols = _called(spark, sf_dir)
    asked = symbols.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("query_id"), F.lit("unique").alias("status"), "symbol_ref")
    return resolve.dossier(asked, symbols, 1).select("query_id", "kind", "edge", "target_description", "more")


def eval_segments(spark, sf_dir):
    ranked = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, "concept").when(F.col("p_partkey") % 3 == 1, "terse").otherwise("name").alias("segment"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 6 + 1).alias("rank"))
    out = evaluate.by_segment(ranked)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def eval_targets(spark, sf_dir):
    s = structure._symbols(spark, sf_dir)
    hit = F.concat(F.col("container")[0], F.lit("."), "name")
    target = F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("x."), "name"))
    return s.select("p_partkey", *(evaluate.target_hit(hit, target, how).alias(how) for how in ("leaf", "suffix", "substring")))


def eval_under_bar(spark, sf_dir):
    measured = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg(F.col("p_size") / 50).alias("mrr"), F.avg(F.when(F.col("p_size") > 10, 1.0).otherwise(0.0)).alias("recall"))
    return evaluate.under_bar(measured, (0.5, 0.8)).select("p_brand")


def snapshot_churn(spark, sf_dir):
    fresh, stored = structure._stored(spark, sf_dir)
    return evaluate.churn(evaluate.snapshot_diff(stored, fresh, "doc_id", ["source", "content_hash"]), ("source",))


def gold_harvest(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("relpath"), F.lit("h").alias("heading"), F.array("p_name", F.concat(F.lit("  "), F.element_at(F.split("p_name", " "), 1), F.lit("  part ")), F.lit("short"), F.concat(F.lit("part number "), F.col("p_partkey").cast("string"))).alias("terms"))
    return evaluate.gold_queries(rows).select("query", "relpath")


def usage_kinds(spark, sf_dir):
    return usage.kind_counts(structure._moves(spark, sf_dir), "sid", ("read", "search", "consult", "save"))


def path_functions(spark, sf_dir):
    name = F.col("p_name")
    path = F.concat(F.lit("/home/u/"), F.element_at(F.split(name, " "), 1), F.lit("/"), F.col("p_size").cast("string"), F.lit(".py"))
    roots = [("HOME", "/home/u")]
    out = T.portable_path(path, roots)
    return table(spark, sf_dir, "part").select("p_partkey", T.slug(F.concat(F.lit(" The "), name, F.lit("! (v2)"))).alias("slug"), T.munge_path(path).alias("folder"), out.alias("portable"), T.expand_path(out, roots).alias("whole"), T.safe_relpath(path).alias("safe"), S.ref_slug(F.concat("p_type", F.lit("#"), name)).alias("ref_slug"), T.code_hash(name).alias("code_hash"))


def _scores(spark, sf_dir):
    """Customers of a nation as hits with three scores, one of them missing at times."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 17).cast("double")).alias("b"))


def facet_blend(spark, sf_dir):
    return fusion.weighted(_scores(spark, sf_dir), {"a": 0.7, "b": 0.3}).select("query_id", "id", F.round("score", 6).alias("score"))


def project_fan_out(spark, sf_dir):
    rows = _scores(spark, sf_dir).withColumn("project", F.concat(F.lit("p"), (F.col("id") % 3).cast("string")))
    place = F.row_number().over(Window.partitionBy("query_id", "project").orderBy(F.desc("a"), "id"))
    return fusion.fan_out(rows.withColumn("rank", place).select("query_id", "project", "id", "rank"), "p1").select("query_id", "id", F.round("score", 8).alias("score"), "rank")


def ranker_route(spark, sf_dir):
    share = retrieval._terms(spark, sf_dir).coverage(1)
    best = share.groupBy("query_id").agg(F.max("coverage").alias("coverage"))
    return fusion.route(best).select("query_id", "route")


def phrase_similarity(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    asked = retrieval._centroids(spark, sf_dir)
    phrases = corpus.select("label", F.col("embedding").cast("array<double>").alias("v"))
    return fusion.best_phrase(asked, phrases, "label").select("query_id", "label", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (commit_snapshot, reconcile_targets, missing_files, forget_paths, rebuild_projects, schema_sweep, unreadable_rows, code_index, dropped_file, stale_files, freshness_token, undescribed_files, dirty_files, budgeted_sweep, convert_records, migrate_layout, forget_project, probe_queries, append_note, move_notes, stash_ids, writable_paths, latest_records, portable_mtimes, not_indexed, reindex_totals, narrowed_symbols, floor_and_equality, span_attach, taint_marks, corpus_inventory, missing_deps, decision_check, decision_list, decision_dossier, learning_marks, learning_convert, graph_marks, resolve_abroad, symbol_xref, symbol_dossier, eval_segments, eval_targets, eval_under_bar, snapshot_churn, gold_harvest, usage_kinds, path_functions, facet_blend, project_fan_out, ranker_route, phrase_similarity)
}

_N = "n AS (SELECT doc_id, lang AS project, CASE WHEN doc_id % 4 = 0 THEN 'design' ELSE 'notes' END AS store, CASE WHEN doc_id % 9 = 0 THEN 'sources/' ELSE '' END || 'd' || doc_id || '.md' AS relpath, text FROM documents)"
_R = "r AS (SELECT *, p_brand AS project, 'f' || p_size || '.py' AS file, 'n' || p_partkey AS symbol_ref, p_partkey % 97 AS mtime, p_partkey % 11 = 0 AS dirty, lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.toml' AS filename FROM part)"
_TAINTED = f"{structure._FACETS}, {structure._taint('causes', 'taint')}, tt AS (SELECT DISTINCT project, id FROM taint)"
_CALLED = f"{structure._SYM}, c AS (SELECT a.p_partkey, a.symbol_ref, a.name, b.symbol_ref AS target, b.name || ' [' || b.file || ']' AS edge, b.name AS target_name FROM sym a JOIN sym b ON b.p_partkey = a.p_partkey + 1 UNION ALL SELECT p_partkey, symbol_ref, name, NULL, 'gone [lost.py]', NULL FROM sym)"

ORACLE_SQL = {
    "commit_snapshot": f"WITH {structure._STORED} SELECT f.doc_id, f.source, f.content_hash, CASE WHEN s.content_hash = f.content_hash THEN 'v' || f.doc_id END AS v, CASE WHEN s.doc_id IS NULL OR s.content_hash <> f.content_hash THEN 'embed' WHEN s.source IS DISTINCT FROM f.source THEN 'meta' ELSE 'noop' END AS action FROM f LEFT JOIN s ON s.doc_id = f.doc_id",
    "reconcile_targets": f"WITH {_N} SELECT DISTINCT project, store, relpath FROM n WHERE (doc_id % 3 <> 0 OR doc_id % 5 <> 0) AND doc_id % 9 <> 0",
    "missing_files": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0",
    "forget_paths": "SELECT doc_id FROM documents WHERE doc_id % 7 <> 0",
    "rebuild_projects": "SELECT label AS project, bool_or(label = 3) AS index_rebuilding FROM embeddings GROUP BY 1",
    "schema_sweep": "SELECT n_name AS project FROM nation WHERE n_regionkey <> 3",
    "unreadable_rows": "SELECT CASE WHEN doc_id % 6 = 0 THEN 'line ' || (doc_id % 10) ELSE 'read' END AS error, count(*) AS n FROM documents GROUP BY 1",
    "code_index": f"""WITH {structure._SYM}, k AS (SELECT *, p_partkey % 3 = 0 AS gone, count(*) FILTER (p_partkey % 3 <> 0) OVER (PARTITION BY file) AS fresh, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE CAST(p_partkey % 10 AS VARCHAR) END AS now, CAST(p_partkey % 10 AS VARCHAR) AS was_hash FROM sym),
s AS (SELECT *, CASE WHEN gone AND fresh = 0 AND length(file) % 7 > 3 THEN 'kept' WHEN gone AND length(file) % 2 = 0 THEN 'dirty' WHEN gone THEN 'deleted' WHEN now = was_hash THEN 'same' ELSE 'changed' END AS state FROM k)
SELECT file, container, name, CASE state WHEN 'dirty' THEN '' WHEN 'kept' THEN was_hash ELSE now END AS content_hash, CASE WHEN state <> 'changed' THEN 'd' || p_partkey END AS description, state FROM s WHERE state <> 'deleted'""",
    "dropped_file": "SELECT 'n' || p_partkey AS symbol_ref, 'a [f' || p_size || '.py]' || CASE WHEN p_size % 7 <> 5 THEN ',b [f' || (p_size % 7) || '.py]' ELSE '' END AS called_by FROM part WHERE p_size <> 5",
    "stale_files": f"""WITH {_R}, a AS (SELECT file, min(mtime) AS m, bool_or(dirty) AS d FROM r GROUP BY 1), b AS (SELECT DISTINCT 'f' || (p_size + 5) || '.py' AS file, (p_size + 5) // 2 AS m FROM part)
SELECT * FROM (SELECT coalesce(a.file, b.file) AS file, CASE WHEN b.file IS NULL THEN 'gone' WHEN a.file IS NULL THEN 'new' WHEN b.m > a.m THEN 'newer' WHEN d THEN 'dirty' END AS why FROM a FULL JOIN b ON a.file = b.file) WHERE why IS NOT NULL""",
    "freshness_token": "SELECT count(*) AS n, max(p_partkey % 97) AS latest FROM part",
    "undescribed_files": f"WITH {_R} SELECT DISTINCT project, file FROM r WHERE NOT dirty AND p_partkey % 4 < 2",
    "dirty_files": f"WITH {_R} SELECT DISTINCT project, file FROM r WHERE dirty",
    "budgeted_sweep": "SELECT p_partkey, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 100 AS deferred FROM part",
    "convert_records": f"WITH {_R}, t AS (SELECT filename, CASE WHEN p_partkey % 3 = 0 THEN filename ELSE file END AS target, p_partkey FROM r) SELECT filename, target, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY filename) > 1 THEN 'collision' WHEN p_partkey % 2 = 1 AND target = filename THEN 'noop' ELSE 'convert' END AS status FROM t",
    "migrate_layout": "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'src/' ELSE '' END || 'd' || doc_id || '.md' AS relpath FROM documents",
    "forget_project": f"WITH {_N} SELECT doc_id FROM n WHERE project <> 'en' OR store = 'design'",
    "probe_queries": "SELECT doc_id, md5(substr(coalesce(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')[1], ''), 1, 200)) AS probe FROM documents",
    "append_note": "SELECT doc_id, md5(rtrim(coalesce(text, '')) || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## Head' || chr(10) || chr(10) ELSE '' END || 'more' || chr(10)) AS body FROM documents",
    "move_notes": f"""WITH {_N}, m AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'd' || (doc_id + 1) || '.md' WHEN doc_id % 5 = 0 THEN 'new' || doc_id || '.md' END AS to_relpath FROM n), w AS (SELECT m.*, m.to_relpath IS NOT NULL AND EXISTS (SELECT 1 FROM n WHERE n.project = m.project AND n.relpath = m.to_relpath) AS refused FROM m)
SELECT doc_id, CASE WHEN to_relpath IS NOT NULL AND NOT refused THEN to_relpath ELSE relpath END AS relpath, refused FROM w""",
    "stash_ids": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'front' WHEN doc_id % 4 = 0 THEN 'salvaged' WHEN doc_id % 5 = 0 THEN 'incoming' ELSE 'derived' END AS id FROM documents",
    "writable_paths": "SELECT doc_id, doc_id % 9 <> 0 AS writable FROM documents",
    "latest_records": f"WITH {_R} SELECT file AS symbol_ref, filename FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY mtime DESC, filename) AS k FROM r) WHERE k = 1",
    "portable_mtimes": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN o_custkey ELSE o_orderkey * 10 END AS mtime FROM orders",
    "not_indexed": "SELECT n_name AS project, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_regionkey = 1) AS indexed FROM nation WHERE n_regionkey <> 1",
    "reindex_totals": f"""WITH {structure._STORED}, a AS (SELECT coalesce(f.doc_id, s.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'delete' WHEN s.doc_id IS NULL OR s.content_hash <> f.content_hash THEN 'embed' WHEN s.source IS DISTINCT FROM f.source THEN 'meta' ELSE 'noop' END AS action FROM f FULL JOIN s ON s.doc_id = f.doc_id)
SELECT doc_id % 3 AS project, 2 * count(*) FILTER (action = 'embed') AS embed, 2 * count(*) FILTER (action = 'delete') AS "delete", 2 * count(*) FILTER (action = 'meta') AS meta, 2 * count(*) FILTER (action = 'noop') AS noop FROM a GROUP BY 1""",
    "narrowed_symbols": "SELECT 'n' || p_partkey AS symbol_ref FROM part WHERE p_size = 7 AND p_partkey % 2 = 0",
    "floor_and_equality": "SELECT p_partkey FROM part WHERE p_size = 30",
    "span_attach": f"""WITH lm AS ({retrieval.ORACLE_SQL['section_lines']}), h AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations)
SELECT h.conv_id, h.turn, lm.start_line, lm.end_line FROM h LEFT JOIN lm ON lm.conv_id = h.conv_id AND lm.section_key = h.role || CASE WHEN nth > 1 THEN '#' || nth ELSE '' END""",
    "taint_marks": "SELECT doc_id, doc_id % 12 = 0 AS tainted FROM documents",
    "corpus_inventory": f"WITH {_N} SELECT DISTINCT project, store, relpath FROM n WHERE relpath LIKE 'd1%'",
    "missing_deps": f"WITH {structure._FACETS} SELECT d.project, d.id, d.dep, d.dep = 'none' AND d.project % 2 = 0 AS note FROM deps d LEFT JOIN nodes n ON n.project = d.project AND n.id = d.dep WHERE n.id IS NULL",
    "decision_check": f"""WITH RECURSIVE {_TAINTED}, o AS (SELECT project, id, string_agg(DISTINCT cause, ',' ORDER BY cause) AS causes, bool_and(cause LIKE 'source%') AS src FROM causes GROUP BY 1, 2)
SELECT n.project, n.id, n.status, tt.id IS NOT NULL AS tainted, coalesce(o.causes, '') AS causes, CASE WHEN n.status = 'proposed' THEN 'promote' WHEN o.src THEN 're-read the source, then reaffirm' ELSE 'reconsider, then reaffirm or supersede' END AS next
FROM nodes n LEFT JOIN tt ON tt.project = n.project AND tt.id = n.id LEFT JOIN o ON o.project = n.project AND o.id = n.id WHERE n.kind = 'design' AND (tt.id IS NOT NULL OR n.status = 'proposed')""",
    "decision_list": f"""WITH RECURSIVE {_TAINTED}, a AS (SELECT id, count(DISTINCT dep) AS c FROM deps GROUP BY 1), b AS (SELECT dep, count(DISTINCT id) AS c FROM deps GROUP BY 1)
SELECT n.project, n.id, n.title, n.status, tt.id IS NOT NULL AS tainted, coalesce(a.c, 0) AS n_deps, coalesce(b.c, 0) AS n_dependents FROM nodes n LEFT JOIN tt ON tt.project = n.project AND tt.id = n.id LEFT JOIN a ON a.id = n.id LEFT JOIN b ON b.dep = n.id WHERE n.kind = 'design'""",
    "decision_dossier": f"""WITH RECURSIVE {_TAINTED}, e AS (SELECT project, id, dep AS other, 'dep' AS edge FROM deps UNION ALL SELECT project, dep, id, 'dependent' FROM deps)
SELECT e.project, e.id, e.edge, e.other, coalesce(n.title, e.other || ' (missing)') AS title, CASE WHEN n.id IS NOT NULL THEN 'o' || n.id || '.md' END AS relpath, n.status, n.id IS NULL OR tt.id IS NOT NULL AS tainted
FROM e JOIN nodes q ON q.project = e.project AND q.id = e.id LEFT JOIN nodes n ON n.project = e.project AND n.id = e.other LEFT JOIN tt ON tt.project = e.project AND tt.id = e.other WHERE regexp_matches(q.id, '[05]0$')""",
    "learning_marks": f"WITH {structure._SYM} SELECT DISTINCT CASE WHEN p_partkey % 4 = 3 THEN 'gone.py#' || name ELSE symbol_ref END AS node FROM sym WHERE p_partkey % 4 <> 0",
    "learning_convert": f"WITH {structure._NOTES} SELECT n.relpath, n.bound AS binding, CASE WHEN n.p_partkey % 4 = 3 THEN 'orphan' ELSE 'convert' END AS status, CASE WHEN n.p_partkey % 4 <> 3 THEN s.symbol_ref END AS symbol_ref FROM notes n JOIN sym s USING (p_partkey)",
    "graph_marks": "SELECT o_custkey AS project, o_orderkey AS node, o_orderkey % 4 = 0 AS has_learning FROM orders",
    "resolve_abroad": f"WITH {structure._SYM} SELECT p_partkey AS query_id, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 3 = 2 THEN 'unknown' ELSE 'unique' END AS status, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 2 THEN symbol_ref END AS symbol_ref, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 2 THEN 'main' END AS found_in FROM sym",
    "symbol_xref": f"WITH {_CALLED} SELECT p_partkey AS query_id, symbol_ref, 'name' AS tier, 'calls' AS kind, edge, target, target IS NOT NULL AS resolved FROM c WHERE p_partkey % 10 = 0",
    "symbol_dossier": f"WITH {_CALLED}, k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY edge) AS n, count(*) OVER (PARTITION BY p_partkey) AS total FROM c WHERE p_partkey % 10 = 0) SELECT p_partkey AS query_id, 'calls' AS kind, edge, 'about ' || target_name AS target_description, total - 1 AS more FROM k WHERE n = 1",
    "eval_segments": "SELECT " + ", ".join(f"round(avg(CASE WHEN p_size % 4 <> 0 AND p_size % 6 < 3 THEN 1.0 ELSE 0.0 END) FILTER (p_partkey % 3 = {n}), 6) AS {s}" for n, s in enumerate(("concept", "terse", "name"))) + " FROM part",
    "eval_targets": "SELECT p_partkey, true AS leaf, p_partkey % 2 = 0 AS suffix, p_partkey % 2 = 0 AS substring FROM part",
    "eval_under_bar": "SELECT p_brand FROM part GROUP BY 1 HAVING avg(p_size / 50) < 0.5 OR avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0.0 END) < 0.8",
    "snapshot_churn": f"WITH {structure._STORED}, j AS (SELECT f.source AS ns, s.source AS os, f.content_hash AS nh, s.content_hash AS oh FROM f JOIN s ON s.doc_id = f.doc_id) SELECT 'source' AS field, count(*) AS n, true AS edge_only FROM j WHERE ns IS DISTINCT FROM os HAVING count(*) > 0 UNION ALL SELECT 'content_hash', count(*), false FROM j WHERE nh IS DISTINCT FROM oh HAVING count(*) > 0",
    "gold_harvest": """WITH t AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS relpath, unnest([p_name, string_split(p_name, ' ')[1] || ' part', 'short', 'part number ' || p_partkey]) AS query FROM part)
SELECT min(query) AS query, min(relpath) AS relpath FROM t WHERE length(query) >= 8 GROUP BY lower(query) HAVING count(DISTINCT relpath) = 1""",
    "usage_kinds": f"WITH {structure._MOVES} SELECT sid, count(*) FILTER (kind = 'read') AS read, count(*) FILTER (kind = 'search') AS search, count(*) FILTER (kind = 'consult') AS consult, count(*) FILTER (kind = 'save') AS save FROM m GROUP BY 1",
    "facet_blend": """WITH s AS (SELECT c_nationkey AS query_id, c_custkey AS id, c_acctbal AS a, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 17 AS DOUBLE) ELSE 0 END AS b FROM customer),
m AS (SELECT *, min(a) OVER w AS la, max(a) OVER w AS ha, min(b) OVER w AS lb, max(b) OVER w AS hb FROM s WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, round(CASE WHEN ha > la THEN 0.7 * (a - la) / (ha - la) ELSE 0 END + CASE WHEN hb > lb THEN 0.3 * (b - lb) / (hb - lb) ELSE 0 END, 6) AS score FROM m""",
    "project_fan_out": """WITH l AS (SELECT c_nationkey AS query_id, c_custkey AS id, c_custkey % 3 AS p, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 3 ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer),
s AS (SELECT query_id, id, 1.0::DOUBLE / (60 + r) AS score, r, dense_rank() OVER (PARTITION BY query_id ORDER BY p <> 1, p) AS n FROM l)
SELECT query_id, id, round(score, 8) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, n, r, id) AS INTEGER) AS rank FROM s""",
    "ranker_route": f"SELECT query_id, CASE WHEN max(coverage) >= 0.999 THEN 'name' ELSE 'concept' END AS route FROM ({retrieval.ORACLE_SQL['coverage_gate']}) GROUP BY 1",
    "phrase_similarity": f"""WITH {retrieval._CENT} SELECT c.query_id, e.label, round(max(list_cosine_similarity(c.v, e.v)), 6) AS score FROM cent c, emb e GROUP BY 1, 2""",
    "path_functions": """WITH p AS (SELECT *, '/home/u/' || string_split(p_name, ' ')[1] || '/' || p_size || '.py' AS path, p_type || '#' || p_name AS ref FROM part), m AS (SELECT *, regexp_replace(regexp_replace(ref, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe_ref FROM p)
SELECT p_partkey, lower(regexp_replace('The ' || regexp_replace(p_name, '[^A-Za-z0-9 _-]', '', 'g') || ' v2', '\\s+', '-', 'g')) AS slug, regexp_replace(path, '[^A-Za-z0-9]', '-', 'g') AS folder, '$HOME' || substr(path, 8) AS portable, path AS whole, false AS safe, safe_ref || '-' || substr(sha1(ref), 1, 8) AS ref_slug, substr(sha1(p_name), 1, 16) AS code_hash FROM m""",
}
