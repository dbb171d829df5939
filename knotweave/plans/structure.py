"""Queries over records and graphs: index diffs, symbols, walks, staleness, plans, merges, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotweave.operators import chunking, decisions, evaluate, graph, index, learnings, merge, planning, resolve, usage
from knotweave.storage import saved
from knotweave.streaming import events as streams

from .retrieval import table


def _stored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha1(F.col("text").cast("binary")).alias("content_hash"))
    changed = docs.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "moved").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    gone = docs.where("doc_id % 13 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "source", "content_hash")
    return docs, changed.union(gone)


def hash_gate_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, stored = _stored(spark, sf_dir)
    return index.plan(fresh, stored, "doc_id", ["source"])


def snapshot_diff(spark, sf_dir):
    fresh, stored = _stored(spark, sf_dir)
    return evaluate.snapshot_diff(stored, fresh, "doc_id", ["source", "content_hash"])


def store_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("k"), F.sha1(F.col("text").cast("binary")).alias("v"))
    return evaluate.digest(docs, ["lang"])


def orphan_prune(spark, sf_dir):
    assets = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("section_hash"), F.col("quality").alias("mtime"))
    live = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("section_hash"))
    return index.orphan_terms(assets, live, F.lit(1)).select(F.col("section_hash").alias("doc_id"))


def enrichment_targets(spark, sf_dir):
    sections = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("section_hash"))
    assets = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("section_hash")), "doc_id").select("section_hash", F.when(F.col("quality") == 1, "summary").otherwise("asks").alias("label"))
    return index.enrichment_targets(sections, ["summary", "asks"], assets).select("section_hash", "label")


def duplicate_ids(spark, sf_dir):
    notes = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("relpath"))
    return index.duplicate_ids(notes).select("id", F.array_join("paths", ",").alias("paths"))


def bulk_batches(spark, sf_dir):
    return index.batches(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 3).select("conv_id", "turn", "batch")


def version_ring(spark, sf_dir):
    numbered = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("seq"))
    return merge.prune(numbered)


def three_way_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    side = lambda change: c.select(F.col("c_custkey").alias("record"), F.explode(F.map_from_arrays(F.array(F.lit("id"), F.lit("name"), F.lit("segment"), F.lit("nation")), F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")))).alias("key", "value")).withColumn("value", change).where("value is not null")
    k = F.col("record")
    base = side(F.col("value"))
    ours = side(F.when((k % 3 == 0) & (F.col("key") == "segment"), "OURS").when((k % 5 == 0) & (F.col("key") == "name"), F.lit(None)).otherwise(F.col("value")))
    theirs = side(F.when((k % 2 == 0) & (F.col("key") == "segment"), "THEIRS").when((k % 10 == 0) & (F.col("key") == "name"), "renamed").otherwise(F.col("value")))
    return merge.merge_fields(base, ours, theirs).select("record", "key", "value")


def reverse_edges(spark, sf_dir):
    calls = table(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 8, "0").alias("caller"), F.col("l_partkey").alias("callee"))
    return index.reverse_edges(calls).select("symbol_ref", F.array_join("called_by", ",").alias("called_by"))


def _symbols(spark, sf_dir):
    """Parts as symbols: brand and type are folders, words of the name are container and leaf."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.lit("main").alias("project"),
        F.concat(F.lit("src/"), F.regexp_replace(F.lower("p_brand"), "#", "_"), F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("file"),
        F.array(words[0]).alias("container"),
        F.concat(words[1], F.lit("_"), F.col("p_partkey").cast("string")).alias("name"),
        F.lit("python").alias("lang"),
        F.array(F.concat(F.lit("part."), F.col("p_partkey").cast("string"))).alias("symbol_was"),
        F.col("p_partkey"),
    ).withColumn("symbol_ref", F.concat("file", F.lit("#"), F.col("container")[0], F.lit("."), "name"))


def symbol_match_tiers(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    forms = F.array(F.col("name"), F.concat(F.col("container")[0], F.lit("."), "name"), F.col("symbol_ref"), F.col("symbol_was")[0], F.concat_ws(".", F.regexp_replace(F.regexp_replace("file", "[.]py$", ""), "/", "."), F.col("container")[0], "name"))
    queries = symbols.select((F.col("p_partkey") * 10).alias("base"), F.lit("main").alias("project"), F.posexplode(forms).alias("form", "query")).select((F.col("base") + F.col("form")).alias("query_id"), "project", "query")
    return resolve.matches(queries, symbols).select("query_id", "query", "symbol_ref", "tier")


def unique_or_refuse(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    queries = table(spark, sf_dir, "part").select(F.element_at(F.split("p_name", " "), 1).alias("q")).distinct().join(symbols.select(F.col("container")[0].alias("q"), "name", "p_partkey"), "q").select(F.col("p_partkey").alias("query_id"), F.lit("main").alias("project"), F.concat("q", F.lit("."), "name").alias("query"))
    callers = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("callers")).join(symbols.select(F.col("p_partkey").alias("l_partkey"), "symbol_ref"), "l_partkey")
    out = resolve.unique_or_refuse(resolve.matches(queries, symbols), callers)
    return out.select("query_id", "status", "symbol_ref", "via")


def edge_resolution(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    target = symbols.select(F.col("p_partkey").alias("t"), F.col("name").alias("tn"), F.col("file").alias("tf"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_linenumber") * 3).alias("t")).distinct()
    edges = links.join(target, "t", "left").select("s", F.concat(F.coalesce("tn", F.concat(F.lit("gone_"), F.col("t").cast("string"))), F.lit(" ["), F.coalesce("tf", F.lit("lost.py")), F.lit("]")).alias("e"))
    calls = edges.groupBy(F.col("s").alias("p_partkey")).agg(F.array_sort(F.collect_set("e")).alias("calls"))
    rows = resolve.resolve_edges(symbols.join(calls, "p_partkey", "left"))
    return rows.groupBy("source").agg(F.count("*").alias("edges"), F.count_if("resolved").alias("resolved"), F.min("target").alias("first_target"))


def longest_prefix(spark, sf_dir):
    symbols = _symbols(spark, sf_dir)
    paths = symbols.select(F.col("p_partkey"), F.col("file").alias("path"))
    roots = paths.select(F.regexp_extract("path", "^(src/brand_1[0-9]*)/", 1).alias("root")).where("root <> ''").distinct().union(spark.createDataFrame([("src",)], "root string"))
    return resolve.longest_prefix(paths, roots).select("p_partkey", "root", "relpath")


def enclosing_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spans = e.groupBy(F.col("user_id").alias("file"), F.col("event_type").alias("name")).agg(F.min("event_id").alias("start_line"), F.max("event_id").alias("end_line"))
    points = e.select(F.col("user_id").alias("file"), F.col("event_id").alias("line"))
    return chunking.enclosing(points, spans, "file", "line").select("file", "line", "enclosing")


def _order_edges(spark, sf_dir):
    """Each order depends on the customer's one before, and on the one before that."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey", 1).over(w).alias("p1"), F.lag("o_orderkey", 2).over(w).alias("p2"))
    return o.select("o_custkey", F.col("o_orderkey").alias("src"), F.explode(F.array("p1", "p2")).alias("dst")).where("dst is not null")


def graph_bfs(spark, sf_dir):
    edges = _order_edges(spark, sf_dir).select("src", "dst")
    seeds = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("node")).select(F.col("node").alias("root"), "node")
    nodes, _ = graph.bfs(seeds, edges, 3)
    return nodes


def graph_closure(spark, sf_dir):
    pairs = graph.closure(_order_edges(spark, sf_dir))
    return pairs.groupBy("src").agg(F.count("*").alias("reaches"), F.min("dst").alias("furthest"))


def graph_cycles(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    loops = graph.cycles(e.where("next is not null").select(F.col("event_type").alias("src"), F.col("next").alias("dst")))
    return loops.select(F.array_join("members", ",").alias("members"))


def graph_rollup(spark, sf_dir):
    edges = _order_edges(spark, sf_dir)
    nodes = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("file"), F.array().cast("array<string>").alias("scope"), F.lit(False).alias("external"), F.lit(False).alias("truncated"))
    groups, links = graph.roll_up(nodes, edges, "dir")
    return groups.join(links.select(F.col("src").alias("group"), "dst", "weight"), "group", "left").select("group", "symbols", "dst", "weight")


def node_degrees(spark, sf_dir):
    edges = _order_edges(spark, sf_dir)
    return graph.degrees(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")), edges)


def design_tree(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))).where("next is not null")
    edges = e.select(F.col("event_type").alias("src"), F.col("next").alias("dst")).distinct()
    roots = table(spark, sf_dir, "events").select(F.col("event_type").alias("node")).distinct()
    return graph.tree(edges, 3, roots).select("root", F.array_join("path", ">").alias("path"), "depth", "repeat")


def plan_order(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("rank"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("title"))
    edges = _order_edges(spark, sf_dir).select(F.col("o_custkey").alias("project"), "src", "dst")
    return graph.topological(items, edges).select("project", "node", "position")


def _facets(spark, sf_dir):
    """Orders as decisions and plans of their customer's project, with deps and citations: deps are written once."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    key = F.col("o_orderkey")
    nodes = o.select(
        F.col("o_custkey").alias("project"),
        key.cast("string").alias("id"),
        F.when(F.col("o_orderpriority") < "3", "plan").otherwise("design").alias("kind"),
        F.concat(F.lit("o"), key.cast("string"), F.lit(".md")).alias("relpath"),
        F.concat(F.lit("Order "), key.cast("string")).alias("title"),
        F.when(F.col("o_orderpriority") < "3", F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "in-progress").otherwise("todo")).otherwise(F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "P", "proposed").otherwise("superseded")).alias("status"),
        (key % 17).cast("string").alias("body_hash"),
    )
    d = _order_edges(spark, sf_dir)
    checked = F.when(F.col("src") % 7 < 4, (F.col("dst") % 17).cast("string")).when(F.col("src") % 7 == 4, "stale")
    dangling = o.where(key % 101 == 0).select(F.col("o_custkey").alias("project"), key.cast("string").alias("id"), F.lit("none").alias("dep"), F.lit(None).cast("string").alias("checked"))
    deps = d.select(F.col("o_custkey").alias("project"), F.col("src").cast("string").alias("id"), F.col("dst").cast("string").alias("dep"), checked.alias("checked")).union(dangling)
    cited = o.where(key % 31 == 0).select(F.col("o_custkey").alias("project"), key.cast("string").alias("id"), F.lit("spec.md").alias("ref"), (key % 3).cast("string").alias("heading"), F.lit("h").alias("hash"))
    sections = o.select(F.col("o_custkey").alias("project")).distinct().select("project", F.lit("spec.md").alias("ref"), F.explode(F.array(F.struct(F.lit("0").alias("heading"), F.lit("h").alias("hash")), F.struct(F.lit("1").alias("heading"), F.lit("new").alias("hash")))).alias("s")).select("project", "ref", "s.heading", "s.hash")
    return nodes, saved(deps), cited, sections


def _causes(nodes, deps, *cited):
    """Direct causes, written once."""
    return saved(decisions.direct_causes(nodes, deps, *cited))


def taint_direct(spark, sf_dir):
    nodes, deps, cited, sections = _facets(spark, sf_dir)
    return decisions.direct_causes(nodes, deps, cited, sections)


def taint_transitive(spark, sf_dir):
    nodes, deps, cited, sections = _facets(spark, sf_dir)
    return decisions.tainted(nodes, deps, decisions.direct_causes(nodes, deps, cited, sections))


def taint_chains(spark, sf_dir):
    nodes, deps, cited, sections = _facets(spark, sf_dir)
    causes = _causes(nodes, deps, cited, sections)
    paths = decisions.chains(nodes, deps, causes, decisions.tainted(nodes, deps, causes), depth=4)
    return paths.groupBy("project", "cause").agg(F.count("*").alias("chains"), F.max(F.size("chain")).alias("longest"), F.min(F.array_join("chain", " > ")).alias("first_chain"))


def _blocked(spark, sf_dir):
    nodes, deps, _, _ = _facets(spark, sf_dir)
    gating = decisions.tainted(nodes, deps, decisions.direct_causes(nodes, deps))
    notes = nodes.select("project", F.lit("none").alias("id")).distinct().where("project % 2 = 0")
    return nodes, deps, planning.blocking(nodes, deps, gating, notes)


def plan_blocked(spark, sf_dir):
    _, _, rows = _blocked(spark, sf_dir)
    return rows.select("project", "id", "group", F.array_join("blocked_by", ",").alias("blocked_by"), F.size("note_deps").alias("note_deps"), F.size("missing_deps").alias("missing_deps"))


def plan_next(spark, sf_dir):
    _, deps, rows = _blocked(spark, sf_dir)
    return planning.next_items(rows.withColumn("rank", F.lpad("id", 12, "0")), deps, 2).select("project", "id", "place")


def plan_unblocked(spark, sf_dir):
    nodes, deps, before = _blocked(spark, sf_dir)
    done = nodes.withColumn("status", F.when((F.col("kind") == "plan") & (F.col("status") == "in-progress"), "done").otherwise(F.col("status")))
    gating = decisions.tainted(done, deps, decisions.direct_causes(done, deps))
    after = planning.blocking(done, deps, gating, done.select("project", "id").where("false"))
    return planning.freed(before, after).select("project", "id")


def _bound(spark, sf_dir):
    symbols = _symbols(spark, sf_dir).select("p_partkey", "symbol_ref", "symbol_was", "name", "file", F.concat_ws(".", F.col("container")[0], "name").alias("fqn"), (F.col("p_partkey") % 10).cast("string").alias("content_hash"), F.concat(F.lit("def "), "name", F.lit("("), F.col("container")[0], F.lit(", depth)")).alias("signature"))
    k = F.col("p_partkey")
    notes = symbols.where("p_partkey % 4 <> 0").select(F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit(".md")).alias("relpath"), F.when(k % 4 == 1, F.col("symbol_ref")).when(k % 4 == 2, F.col("symbol_was")[0]).otherwise(F.concat(F.lit("gone.py#"), "name")).alias("symbol_ref"), F.array().cast("array<string>").alias("symbol_was"), F.when(k % 3 == 0, "elsewhere.py").otherwise(F.col("file")).alias("file"), F.when(k % 5 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), "signature", F.concat(F.lit(" about "), "name", F.lit("\n")).alias("body"))
    return symbols, notes


def learning_attach(spark, sf_dir):
    symbols, notes = _bound(spark, sf_dir)
    return learnings.attach(symbols, notes).select("symbol_ref", "learning.relpath", "learning.stale", "learning.body")


def learning_report(spark, sf_dir):
    symbols, notes = _bound(spark, sf_dir)
    return learnings.report(notes, symbols)


def rehome_rank(spark, sf_dir):
    symbols, notes = _bound(spark, sf_dir)
    orphans = learnings.report(notes, symbols, True).where("status = 'orphan'").select("relpath")
    return learnings.candidates(notes.join(orphans, "relpath"), symbols, 1).select("relpath", "symbol_ref", "score")


def status_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("project"), "doc_id")
    return evaluate.inventory({"notes": docs, "labelled": docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")})


def kind_histogram(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.col("p_type").alias("kind"))
    return evaluate.kinds(parts)


def _moves(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "signup", "consult").when(F.col("event_type") == "purchase", "save").otherwise("other")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), F.col("event_id").alias("pos"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"))


def first_move(spark, sf_dir):
    rows = _moves(spark, sf_dir).where(usage.in_window(F.col("ts"), "2024-01-05", "2024-01-20"))
    return usage.first_moves(rows).select("sid", "kind")


def usage_funnel(spark, sf_dir):
    rows = _moves(spark, sf_dir).withColumn("regime", usage.regime(F.col("ts"), "2024-01-05", "2024-01-15"))
    out = usage.funnel(rows, "regime")
    return out.select("regime", "events", "sessions", "consult_sessions", "save_sessions", F.round("consult_rate", 6).alias("consult_rate"), F.round("save_rate", 6).alias("save_rate"))


def _file_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("relpath"), F.col("event_id").alias("event"), F.col("ts").cast("timestamp").alias("ts"))


def debounce_sessions(spark, sf_dir):
    out = streams.debounce(_file_events(spark, sf_dir), ["project"], "1 hour")
    return out.select("project", "event", "n")


def batch_coalesce(spark, sf_dir):
    out = streams.coalesce_batches(_file_events(spark, sf_dir), "6 hours", overflow=3)
    return out.select("project", F.array_join(F.transform("changes", lambda c: F.concat_ws(":", c.relpath, c.event.cast("string"))), ",").alias("changes"), "n", "revalidate")


QUERIES = {f.__name__: f for f in (hash_gate_diff, snapshot_diff, store_digest, orphan_prune, enrichment_targets, duplicate_ids, bulk_batches, version_ring, three_way_merge, reverse_edges, symbol_match_tiers, unique_or_refuse, edge_resolution, longest_prefix, enclosing_interval, graph_bfs, graph_closure, graph_cycles, graph_rollup, node_degrees, design_tree, plan_order, taint_direct, taint_transitive, taint_chains, plan_blocked, plan_next, plan_unblocked, learning_attach, learning_report, rehome_rank, status_inventory, kind_histogram, first_move, usage_funnel, debounce_sessions, batch_coalesce)}

_STORED = """f AS (SELECT doc_id, source, sha1(text) AS content_hash FROM documents),
s AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'moved' ELSE source END AS source, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM f WHERE doc_id % 11 <> 0
      UNION ALL SELECT doc_id + 1000000000, source, content_hash FROM f WHERE doc_id % 13 = 0)"""
_SIDE = "(SELECT c_custkey AS record, unnest(['id', 'name', 'segment', 'nation']) AS key, unnest([CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer)"
_SYM = """sym AS (SELECT *, file || '#' || container || '.' || name AS symbol_ref FROM (SELECT p_partkey, 'src/' || replace(lower(p_brand), '#', '_') || '/' || lower(p_type) || '.py' AS file, string_split(p_name, ' ')[1] AS container, string_split(p_name, ' ')[2] || '_' || p_partkey AS name, 'part.' || p_partkey AS was FROM part))"""
_EDGES = """e0 AS (SELECT o_custkey, o_orderkey AS src, lag(o_orderkey, 1) OVER w AS p1, lag(o_orderkey, 2) OVER w AS p2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
edges AS (SELECT o_custkey, src, p1 AS dst FROM e0 WHERE p1 IS NOT NULL UNION ALL SELECT o_custkey, src, p2 FROM e0 WHERE p2 IS NOT NULL)"""
_FACETS = f"""{_EDGES}, nodes AS (SELECT o_custkey AS project, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderpriority < '3' THEN 'plan' ELSE 'design' END AS kind, 'Order ' || o_orderkey AS title,
 CASE WHEN o_orderpriority < '3' THEN CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in-progress' ELSE 'todo' END ELSE CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'P' THEN 'proposed' ELSE 'superseded' END END AS status, CAST(o_orderkey % 17 AS VARCHAR) AS body_hash FROM orders),
deps AS (SELECT o_custkey AS project, CAST(src AS VARCHAR) AS id, CAST(dst AS VARCHAR) AS dep, CASE WHEN src % 7 < 4 THEN CAST(dst % 17 AS VARCHAR) WHEN src % 7 = 4 THEN 'stale' END AS checked FROM edges
  UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 'none', NULL FROM orders WHERE o_orderkey % 101 = 0),
dcause AS (SELECT * FROM (SELECT d.project, d.id, CASE WHEN n.id IS NULL THEN 'dep-deleted' WHEN n.status = 'proposed' THEN NULL WHEN d.checked IS NULL THEN 'new-unverified-edge' WHEN d.checked <> n.body_hash THEN CASE WHEN n.status = 'superseded' THEN 'dep-superseded' ELSE 'dep-edited' END END AS cause, d.dep, coalesce(n.title, d.dep) AS label
  FROM deps d LEFT JOIN nodes n ON n.project = d.project AND n.id = d.dep) WHERE cause IS NOT NULL),
scause AS (SELECT o_custkey AS project, CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 3 WHEN 1 THEN 'source-changed' ELSE 'source-missing' END AS cause, CAST(NULL AS VARCHAR) AS dep, 'spec.md#' || (o_orderkey % 3) AS label FROM orders WHERE o_orderkey % 31 = 0 AND o_orderkey % 3 <> 0),
causes AS (SELECT * FROM dcause UNION ALL SELECT * FROM scause)"""


def _taint(seeds: str, name: str) -> str:
    return f"""{name} AS (SELECT project, id FROM {seeds} UNION SELECT d.project, d.id FROM {name} t JOIN nodes n ON n.project = t.project AND n.id = t.id AND n.status <> 'proposed' JOIN deps d ON d.project = t.project AND d.dep = t.id)"""


_BLOCK = f"""{_FACETS}, {_taint('dcause', 'gate')},
b AS (SELECT n.project, n.id, n.status, list_sort(list(DISTINCT d.dep) FILTER ((t.kind = 'plan' AND t.status NOT IN ('done', 'verified')) OR (t.kind = 'design' AND (t.status = 'proposed' OR g.id IS NOT NULL)))) AS blocked_by,
  count(DISTINCT d.dep) FILTER (d.dep IS NOT NULL AND t.id IS NULL AND n.project % 2 = 0) AS note_deps, count(DISTINCT d.dep) FILTER (d.dep IS NOT NULL AND t.id IS NULL AND n.project % 2 = 1) AS missing_deps
  FROM nodes n LEFT JOIN deps d ON d.project = n.project AND d.id = n.id LEFT JOIN nodes t ON t.project = d.project AND t.id = d.dep LEFT JOIN gate g ON g.project = d.project AND g.id = d.dep WHERE n.kind = 'plan' GROUP BY 1, 2, 3),
blk AS (SELECT *, coalesce(len(blocked_by), 0) > 0 AS blocked FROM b)"""
_NOTES = f"""{_SYM}, notes AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.md' AS relpath, CASE p_partkey % 4 WHEN 1 THEN symbol_ref WHEN 2 THEN was ELSE 'gone.py#' || name END AS bound, CASE WHEN p_partkey % 3 = 0 THEN 'elsewhere.py' ELSE file END AS nfile FROM sym WHERE p_partkey % 4 <> 0)"""
_MOVES = "m AS (SELECT user_id AS sid, event_id AS pos, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'consult' WHEN 'purchase' THEN 'save' ELSE 'other' END AS kind FROM events)"


def _bursts(gap: str) -> str:
    return f"""g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL {gap} THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)"""


ORACLE_SQL = {
    "hash_gate_diff": f"WITH {_STORED} SELECT coalesce(f.doc_id, s.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'delete' WHEN s.doc_id IS NULL OR s.content_hash <> f.content_hash THEN 'embed' WHEN s.source IS DISTINCT FROM f.source THEN 'meta' ELSE 'noop' END AS action FROM f FULL JOIN s ON s.doc_id = f.doc_id",
    "snapshot_diff": f"""WITH {_STORED}, j AS (SELECT coalesce(f.doc_id, s.doc_id) AS doc_id, f.doc_id AS n, s.doc_id AS o, f.source AS ns, s.source AS os, f.content_hash AS nh, s.content_hash AS oh FROM f FULL JOIN s ON s.doc_id = f.doc_id)
SELECT doc_id, CASE WHEN o IS NULL THEN 'added' ELSE 'removed' END AS change, NULL AS field, NULL AS old, NULL AS new FROM j WHERE o IS NULL OR n IS NULL
UNION ALL SELECT doc_id, 'changed', 'source', os, ns FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND os IS DISTINCT FROM ns
UNION ALL SELECT doc_id, 'changed', 'content_hash', oh, nh FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND oh IS DISTINCT FROM nh""",
    "store_digest": """WITH h AS (SELECT lang, sha256(doc_id || chr(0) || sha1(text)) AS h FROM documents), b AS (SELECT lang, substr(h, 1, 2) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n FROM h GROUP BY 1, 2)
SELECT lang, substr(sha256(string_agg(d, chr(10) ORDER BY b)), 1, 16) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY lang""",
    "orphan_prune": "SELECT doc_id FROM labels WHERE quality < 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "enrichment_targets": "WITH s AS (SELECT DISTINCT md5(text) AS section_hash FROM documents), w AS (SELECT section_hash, unnest(['summary', 'asks']) AS label FROM s) SELECT * FROM w WHERE (section_hash, label) NOT IN (SELECT md5(text), CASE WHEN quality = 1 THEN 'summary' ELSE 'asks' END FROM labels JOIN documents USING (doc_id))",
    "duplicate_ids": "SELECT md5(text) AS id, string_agg(DISTINCT lpad(CAST(doc_id AS VARCHAR), 12, '0'), ',' ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS paths FROM documents GROUP BY 1 HAVING count(*) > 1",
    "bulk_batches": "SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 3) AS INTEGER) AS batch FROM conversations",
    "version_ring": "SELECT id, event_id, seq FROM (SELECT user_id AS id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 20",
    "three_way_merge": f"""WITH b AS (SELECT * FROM {_SIDE}), o AS (SELECT record, key, CASE WHEN record % 3 = 0 AND key = 'segment' THEN 'OURS' WHEN record % 5 = 0 AND key = 'name' THEN NULL ELSE value END AS value FROM b),
t AS (SELECT record, key, CASE WHEN record % 2 = 0 AND key = 'segment' THEN 'THEIRS' WHEN record % 10 = 0 AND key = 'name' THEN 'renamed' ELSE value END AS value FROM b),
m AS (SELECT b.record, b.key, CASE WHEN o.value IS NOT DISTINCT FROM t.value THEN o.value WHEN o.value IS NOT DISTINCT FROM b.value THEN t.value WHEN t.value IS NOT DISTINCT FROM b.value THEN o.value WHEN o.value IS NULL THEN t.value WHEN t.value IS NULL THEN o.value ELSE least(o.value, t.value) END AS value FROM b JOIN o USING (record, key) JOIN t USING (record, key))
SELECT * FROM m WHERE value IS NOT NULL""",
    "reverse_edges": "SELECT l_partkey AS symbol_ref, string_agg(DISTINCT lpad(CAST(l_suppkey AS VARCHAR), 8, '0'), ',' ORDER BY lpad(CAST(l_suppkey AS VARCHAR), 8, '0')) AS called_by FROM lineitem GROUP BY 1",
    "symbol_match_tiers": f"""WITH {_SYM} SELECT p_partkey * 10 + form AS query_id, query, symbol_ref, tier FROM (SELECT *, unnest(range(5)) AS form, unnest([name, container || '.' || name, symbol_ref, was, replace(regexp_replace(file, '[.]py$', ''), '/', '.') || '.' || container || '.' || name]) AS query, unnest(['name', 'suffix', 'ref', 'was', 'exact']) AS tier FROM sym)""",
    "unique_or_refuse": f"WITH {_SYM} SELECT p_partkey AS query_id, 'unique' AS status, symbol_ref, 'suffix' AS via FROM sym",
    "edge_resolution": f"""WITH {_SYM}, l AS (SELECT DISTINCT l_partkey AS s, l_partkey + l_linenumber * 3 AS t FROM lineitem), j AS (SELECT a.symbol_ref AS source, l.t, b.symbol_ref AS target FROM l JOIN sym a ON a.p_partkey = l.s LEFT JOIN sym b ON b.p_partkey = l.t)
SELECT source, count(*) AS edges, count(target) AS resolved, min(target) AS first_target FROM j GROUP BY source""",
    "longest_prefix": f"WITH {_SYM}, r AS (SELECT p_partkey, file, CASE WHEN file LIKE 'src/brand_1%' THEN regexp_extract(file, '^(src/[^/]*)/', 1) ELSE 'src' END AS root FROM sym) SELECT p_partkey, root, substr(file, length(root) + 2) AS relpath FROM r",
    "enclosing_interval": "WITH s AS (SELECT user_id, event_type, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1, 2), m AS (SELECT e.user_id, e.event_id, s.event_type, row_number() OVER (PARTITION BY e.event_id ORDER BY b - a, -a, s.event_type) AS r FROM events e JOIN s ON s.user_id = e.user_id AND e.event_id BETWEEN a AND b) SELECT user_id AS file, event_id AS line, event_type AS enclosing FROM m WHERE r = 1",
    "graph_bfs": f"""WITH RECURSIVE {_EDGES}, w AS (SELECT max(o_orderkey) AS root, max(o_orderkey) AS node, 0 AS depth FROM orders GROUP BY o_custkey UNION SELECT root, dst, depth + 1 FROM w JOIN edges ON src = node WHERE depth < 3),
m AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2) SELECT root, node, CAST(depth AS INTEGER) AS depth, depth = 3 AND node IN (SELECT src FROM edges) AS truncated FROM m""",
    "graph_closure": f"WITH {_EDGES}, r AS (SELECT o_orderkey AS src, row_number() OVER w - 1 AS reaches, min(o_orderkey) OVER w AS furthest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT * FROM r WHERE reaches > 0",
    "graph_cycles": """WITH RECURSIVE e AS (SELECT DISTINCT event_type AS src, nxt AS dst FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL),
c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst) SELECT DISTINCT string_agg(b.dst, ',' ORDER BY b.dst) AS members FROM c a JOIN c b ON a.src = b.src JOIN c r ON r.src = b.dst AND r.dst = b.src WHERE a.src = a.dst GROUP BY a.src""",
    "graph_rollup": f"""WITH {_EDGES}, n AS (SELECT o_orderkey AS node, 'n' || c_nationkey AS g FROM orders JOIN customer ON c_custkey = o_custkey), l AS (SELECT a.g AS s, b.g AS d, count(*) AS weight FROM (SELECT DISTINCT src, dst FROM edges) JOIN n a ON a.node = src JOIN n b ON b.node = dst GROUP BY 1, 2)
SELECT q.g AS "group", symbols, d AS dst, weight FROM (SELECT g, count(*) AS symbols FROM n GROUP BY 1) q LEFT JOIN l ON l.s = q.g""",
    "node_degrees": f"WITH {_EDGES} SELECT o_orderkey AS node, (SELECT count(DISTINCT dst) FROM edges WHERE src = o_orderkey) AS deps, (SELECT count(DISTINCT src) FROM edges WHERE dst = o_orderkey) AS dependents FROM orders",
    "design_tree": """WITH RECURSIVE e AS (SELECT DISTINCT event_type AS src, nxt AS dst FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL),
t AS (SELECT DISTINCT event_type AS root, [event_type] AS p, event_type AS node, 0 AS depth, false AS repeat FROM events UNION ALL SELECT root, list_append(p, dst), dst, depth + 1, list_contains(p, dst) FROM t JOIN e ON src = node WHERE NOT repeat AND depth < 3)
SELECT root, array_to_string(p, '>') AS path, CAST(depth AS INTEGER) AS depth, repeat FROM t""",
    "plan_order": "SELECT o_custkey AS project, o_orderkey AS node, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position FROM orders",
    "taint_direct": f"WITH {_FACETS} SELECT * FROM causes",
    "taint_transitive": f"WITH RECURSIVE {_FACETS}, {_taint('causes', 'taint')} SELECT DISTINCT project, id FROM taint",
    "taint_chains": f"""WITH RECURSIVE {_FACETS}, {_taint('causes', 'taint')}, tt AS (SELECT DISTINCT project, id FROM taint),
thru AS (SELECT DISTINCT d.project, d.id, d.dep FROM deps d JOIN tt ON tt.project = d.project AND tt.id = d.dep JOIN nodes n ON n.project = d.project AND n.id = d.dep AND n.status <> 'proposed'),
p AS (SELECT n.project, n.id, n.id AS pos, [n.id] AS path, [n.title] AS chain, 0 AS depth FROM tt JOIN nodes n USING (project, id) UNION ALL SELECT p.project, p.id, h.dep, list_append(path, h.dep), list_append(chain, n.title), depth + 1 FROM p JOIN thru h ON h.project = p.project AND h.id = p.pos JOIN nodes n ON n.project = h.project AND n.id = h.dep WHERE NOT list_contains(path, h.dep) AND depth < 4),
f AS (SELECT p.project, c.cause, CASE WHEN c.cause LIKE 'source%' THEN list_append(chain, c.label) ELSE chain END AS chain FROM p JOIN causes c ON c.project = p.project AND c.id = p.pos)
SELECT project, cause, count(*) AS chains, CAST(max(len(chain)) AS INTEGER) AS longest, min(array_to_string(chain, ' > ')) AS first_chain FROM f GROUP BY 1, 2""",
    "plan_blocked": f"""WITH RECURSIVE {_BLOCK} SELECT project, id, CASE WHEN status = 'done' THEN 'done' WHEN status = 'in-progress' THEN 'in-progress' WHEN blocked THEN 'blocked' ELSE 'ready' END AS "group", coalesce(array_to_string(blocked_by, ','), '') AS blocked_by, CAST(note_deps AS INTEGER) AS note_deps, CAST(missing_deps AS INTEGER) AS missing_deps FROM blk""",
    "plan_unblocked": f"""WITH RECURSIVE {_BLOCK}, fin AS (SELECT b.project, b.id FROM blk b JOIN nodes n USING (project, id) WHERE b.blocked AND n.status = 'todo')
SELECT f.project, f.id FROM fin f WHERE NOT EXISTS (SELECT 1 FROM deps d JOIN nodes t ON t.project = d.project AND t.id = d.dep LEFT JOIN gate g ON g.project = d.project AND g.id = d.dep WHERE d.project = f.project AND d.id = f.id AND ((t.kind = 'plan' AND t.status = 'todo') OR (t.kind = 'design' AND (t.status = 'proposed' OR g.id IS NOT NULL))))""",
    "learning_attach": f"""WITH {_NOTES} SELECT s.symbol_ref, coalesce(a.relpath, b.relpath) AS relpath, CASE WHEN coalesce(a.relpath, b.relpath) IS NOT NULL THEN s.p_partkey % 5 = 0 AND 'x' <> CAST(s.p_partkey % 10 AS VARCHAR) END AS stale, CASE WHEN coalesce(a.relpath, b.relpath) IS NOT NULL THEN 'about ' || s.name END AS body FROM sym s LEFT JOIN notes a ON a.bound = s.symbol_ref LEFT JOIN notes b ON b.bound = s.was""",
    "learning_report": f"WITH {_NOTES} SELECT relpath, bound AS symbol, CASE WHEN n.p_partkey % 4 = 3 THEN 'orphan' WHEN s.file <> nfile THEN 'moved' ELSE 'ok' END AS status, nfile AS file, CASE WHEN n.p_partkey % 4 <> 3 AND s.file <> nfile THEN s.file END AS new_file FROM notes n JOIN sym s USING (p_partkey)",
    "rehome_rank": f"WITH {_NOTES} SELECT relpath, s.symbol_ref, CASE WHEN nfile = s.file THEN 7.0::DOUBLE ELSE 5.0 END AS score FROM notes n JOIN sym s USING (p_partkey) WHERE n.p_partkey % 4 = 3",
    "status_inventory": "SELECT lang AS project, count(*) AS notes, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1",
    "kind_histogram": "SELECT p_brand AS project, p_type AS kind, count(*) AS n FROM part GROUP BY 1, 2",
    "first_move": f"WITH {_MOVES}, f AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts, pos) AS r FROM m WHERE kind IN ('consult', 'search', 'read') AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') SELECT sid, kind FROM f WHERE r = 1",
    "usage_funnel": f"""WITH {_MOVES}, b AS (SELECT *, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-05' THEN 'pre' WHEN CAST(ts AS DATE) < DATE '2024-01-15' THEN 'early' ELSE 'current' END AS regime FROM m),
g AS (SELECT regime, count(*) AS events, count(DISTINCT sid) AS sessions, count(DISTINCT CASE WHEN kind = 'consult' THEN sid END) AS consult_sessions, count(DISTINCT CASE WHEN kind = 'save' THEN sid END) AS save_sessions FROM b GROUP BY 1)
SELECT *, round(consult_sessions::DOUBLE / sessions, 6) AS consult_rate, round(save_sessions::DOUBLE / sessions, 6) AS save_rate FROM g""",
    "debounce_sessions": f"WITH {_bursts('1 HOUR')} SELECT user_id AS project, arg_max(event_id, ts) AS event, count(*) AS n FROM s GROUP BY user_id, burst",
    "batch_coalesce": f"""WITH {_bursts('6 HOURS')}, l AS (SELECT user_id, burst, event_type, arg_max(event_id, ts) AS event FROM s GROUP BY 1, 2, 3)
SELECT user_id AS project, string_agg(event_type || ':' || event, ',' ORDER BY event_type) AS changes, CAST(count(*) AS INTEGER) AS n, count(*) > 3 AS revalidate FROM l GROUP BY user_id, burst""",
    "plan_next": f"""WITH RECURSIVE {_BLOCK}, ord AS (SELECT project, id, row_number() OVER (PARTITION BY project ORDER BY CAST(id AS BIGINT)) AS r FROM blk WHERE status = 'todo' AND NOT blocked) SELECT project, id, CAST(r AS INTEGER) AS place FROM ord WHERE r <= 2""",
}
