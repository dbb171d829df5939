"""Graph walks over edge tables: frontiers as joins, roll-ups as aggregations.

Iterations are driver loops over tables: each step joins a frontier with the
edges and takes out what has been seen. Step results are written to the shared
folder, so that plans stay short and lost executors cost one step.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotweave.functions import symbols as S
from knotweave.storage import saved

MAX_DEPTH, MAX_NODES = 25, 5000
#: Rows of small projects that are ordered in one call, on average.
BUCKET_ROWS = 20_000


def direction(edges: DataFrame, which: str) -> DataFrame:
    """``a b`` to walk from a to b: callees along edges (src, dst), callers against them."""
    if which in ("callees", "references", "deps"):
        return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if which in ("callers", "dependents"):
        return edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    raise ValueError("direction must be callees, callers, references, deps or dependents")


def bfs(seeds: DataFrame, edges: DataFrame, depth: int, which: str = "callees") -> tuple[DataFrame, DataFrame]:
    """(``root node depth truncated``, ``root src dst``) reached from each root within ``depth``.

    ``seeds`` has ``root node``. Each node is reached once, at its least depth.
    All edges out of expanded nodes are kept, once, as caller and callee.
    Nodes at the last depth that have further edges are truncated.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_DEPTH}")
    steps = direction(edges, which).distinct()
    seen = saved(seeds.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        nodes = frontier.join(steps, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        frontier = saved(nodes.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    inside = seen.where(F.col("depth") < depth)
    kept = inside.join(steps, F.col("node") == F.col("a")).select("root", "a", "b").distinct()
    backward = which in ("callers", "dependents")
    oriented = kept.select("root", F.col("b" if backward else "a").alias("src"), F.col("a" if backward else "b").alias("dst"))
    more = steps.select(F.col("a").alias("node"), F.lit(True).alias("__more")).distinct()
    nodes = seen.join(more, "node", "left").withColumn("truncated", (F.col("depth") == depth) & F.coalesce("__more", F.lit(False)))
    return nodes.select("root", "node", "depth", "truncated"), oriented


def closure(edges: DataFrame) -> DataFrame:
    """``src dst`` for all pairs that a path connects: what is new in a step takes one more edge."""
    steps = saved(edges.select("src", "dst").distinct())
    seen = new = steps
    while True:
        longer = new.withColumnRenamed("dst", "via").join(steps.withColumnRenamed("src", "via"), "via").select("src", "dst").distinct()
        new = saved(longer.join(seen, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new)


def _settled(step, now: DataFrame, *by: str) -> DataFrame:
    """``now`` after ``step`` until no row changes; each step is written."""
    state = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64(*by).cast("decimal(38,0)"))).first()
        if seen == state:
            return now
        state, now = seen, saved(step(now))


def cycles(edges: DataFrame) -> DataFrame:
    """Sets of nodes that reach each other, sorted: one row for each, by ``members``.

    These are the strongly connected components of two or more nodes, and
    single nodes with an edge to themselves. Edges to unknown nodes do no harm;
    an empty table has none.

    No closure is built. Nodes that nothing enters or leaves are trimmed away;
    the least node that reaches a node colours it; what reaches a colour's own
    node inside the colour is one component. Found ones go, and the rest is
    coloured again. Tables never hold more rows than there are edges.
    """
    edges = saved(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    rest = edges.where("src <> dst")
    found: DataFrame | None = None

    def trim(now: DataFrame) -> DataFrame:
        ends = now.select(F.col("dst").alias("src")).distinct(), now.select(F.col("src").alias("dst")).distinct()
        return now.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst")

    while True:
        rest = _settled(trim, saved(rest), "src", "dst")
        if rest.isEmpty():
            break
        arrows = rest

        def colour(now: DataFrame) -> DataFrame:
            passed = now.withColumnRenamed("node", "src").join(arrows, "src").select(F.col("dst").alias("node"), "colour")
            return now.union(passed).groupBy("node").agg(F.min("colour").alias("colour"))

        own = _settled(colour, rest.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct(), "node", "colour")
        inside = saved(rest.join(own.withColumnsRenamed({"node": "src", "colour": "__a"}), "src").join(own.withColumnsRenamed({"node": "dst", "colour": "__b"}), "dst").where("__a = __b").select("src", "dst"))

        def reach(now: DataFrame) -> DataFrame:
            back = now.withColumnRenamed("node", "dst").join(inside, "dst").select(F.col("src").alias("node"), "colour")
            return now.union(back).distinct()

        whole = _settled(reach, own.where("node = colour"), "node", "colour")
        found = whole if found is None else found.unionByName(whole)
        gone = whole.select("node")
        rest = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    alone = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("colour"))
    if found is not None:
        many = found.join(found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour"), "colour", "left_semi").select("node", "colour")
        alone = many.unionByName(alone.join(many.select("node"), "node", "left_anti"))
    return alone.groupBy("colour").agg(F.array_sort(F.collect_list("node")).alias("members")).select("members")


def roll_up(nodes: DataFrame, edges: DataFrame, axis: str, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges by group: ``group symbols external truncated`` and ``src dst weight``.

    ``nodes``: node file scope external truncated. A group's weight counts
    different symbol edges, those inside a group too. A group is external or
    truncated only if all its members are.
    """
    placed = nodes.withColumn("group", S.group_key(axis, F.col("file"), F.col("scope"), depth))
    groups = placed.groupBy("group").agg(F.count_distinct("node").alias("symbols"), F.min("external").alias("external"), F.min("truncated").alias("truncated"))
    at = placed.select("node", "group")
    ends = edges.select("src", "dst").distinct().join(at.select(F.col("node").alias("src"), F.col("group").alias("__a")), "src").join(at.select(F.col("node").alias("dst"), F.col("group").alias("__b")), "dst")
    return groups, ends.groupBy(F.col("__a").alias("src"), F.col("__b").alias("dst")).agg(F.count("*").alias("weight"))


def project_graph(symbols: DataFrame, edges: DataFrame, rolled_up: bool = False) -> tuple[DataFrame, DataFrame]:
    """All symbols and edges of a project; ends that no symbol answers are external nodes.

    ``edges``: source target edge resolved. More than ``MAX_NODES`` nodes are an
    error unless they are to be rolled up.
    """
    own = symbols.select(F.col("symbol_ref").alias("node"), "file", "scope", F.lit(False).alias("external"), F.lit(False).alias("truncated"))
    outside = edges.where(~F.col("resolved")).select(F.col("edge").alias("node"), F.lit("").alias("file"), F.array().cast("array<string>").alias("scope"), F.lit(True).alias("external"), F.lit(False).alias("truncated")).distinct()
    nodes = own.unionByName(outside)
    if not rolled_up and (count := nodes.count()) > MAX_NODES:
        raise ValueError(f"{count} nodes; at most {MAX_NODES} are shown unless grouped by file, dir or scope")
    return nodes, edges.select(F.col("source").alias("src"), F.coalesce("target", "edge").alias("dst")).distinct()


def scoped(nodes: DataFrame, edges: DataFrame, under: str = "", exclude: str = "") -> tuple[DataFrame, DataFrame]:
    """The part of a graph in a folder and outside of another.

    Edges stay if either end is in scope; an end outside is a truncated node.
    External ends count only if their source is in scope.
    """
    inside = S.under(F.col("file"), F.lit(under)) & (F.lit(not exclude) | ~S.under(F.col("file"), F.lit(exclude)))
    marked = nodes.withColumn("__in", inside & ~F.col("external"))
    mark = marked.select("node", "__in", "external")
    ends = edges.join(mark.select(F.col("node").alias("src"), F.col("__in").alias("__s")), "src").join(mark.select(F.col("node").alias("dst"), F.col("__in").alias("__d"), F.col("external").alias("__x")), "dst")
    kept = ends.where(F.col("__s") | (F.col("__d") & ~F.col("__x"))).select("src", "dst")
    touched = kept.select(F.col("src").alias("node")).union(kept.select(F.col("dst").alias("node"))).distinct().withColumn("__t", F.lit(True))
    out = marked.join(touched, "node", "left").where(F.col("__in") | F.col("__t"))
    return out.withColumn("truncated", F.col("truncated") | (~F.col("__in") & ~F.col("external"))).drop("__in", "__t"), kept


def marked(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Flag nodes whose owning project has a learning on them (``marks``: project, node)."""
    flag = marks.select("project", "node", F.lit(True).alias("has_learning")).distinct()
    return nodes.join(flag, ["project", "node"], "left").withColumn("has_learning", F.coalesce("has_learning", F.lit(False)))


def dependents(edges: DataFrame) -> DataFrame:
    """``node dependents``: who depends on each node, sorted."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node deps dependents`` counts; isolated nodes have 0."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("deps"))
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("dependents"))
    return nodes.select("node").distinct().join(out, "node", "left").join(back, "node", "left").na.fill(0, ["deps", "dependents"])


def tree(edges: DataFrame, depth: int, roots: DataFrame | None = None) -> DataFrame:
    """``root path node depth repeat``: the unfolded tree under each root.

    Shared nodes unfold again under each parent; a node that is its own
    ancestor is a ``repeat`` and unfolds no further. Without ``roots``, nodes
    that no edge leads to are the roots.
    """
    steps = edges.select("src", "dst").distinct()
    if roots is None:
        roots = steps.select(F.col("src").alias("node")).distinct().join(steps.select(F.col("dst").alias("node")), "node", "left_anti")
    level = roots.select(F.col("node").alias("root"), F.array("node").alias("path"), "node", F.lit(0).alias("depth"), F.lit(False).alias("repeat"))
    out = level
    for n in range(1, depth + 1):
        grown = level.where(~F.col("repeat")).join(steps, F.col("node") == F.col("src"))
        level = saved(grown.select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), F.lit(n).alias("depth"), F.array_contains("path", F.col("dst")).alias("repeat")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def process_tree(nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """``root position node depth repeat``: one pre-order listing for each root.

    A node is expanded once in a root's listing; later visits are repeats. That
    depends on visits before it, so each root's reachable edges (bounded by
    ``depth`` and ``MAX_NODES``) are walked in one task.
    """
    reached, kept = bfs(nodes, edges, depth)
    sizes = reached.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > MAX_NODES)
    if not sizes.isEmpty():
        raise ValueError(f"a walk reaches more than {MAX_NODES} nodes")

    def walk(key, table):
        import pandas as pd

        root = key[0]
        children = defaultdict(list)
        for a, b in sorted(zip(table["src"], table["dst"], strict=True)):
            if a is not None and a == a:
                children[a].append(b)
        expanded, rows, stack = set(), [], [(root, 0)]
        while stack:
            node, level = stack.pop()
            repeat = node in expanded
            rows.append((root, len(rows), node, level, repeat))
            if not repeat and level < depth:
                expanded.add(node)
                stack += [(c, level + 1) for c in reversed(children[node])]
        return pd.DataFrame(rows, columns=["root", "position", "node", "depth", "repeat"])

    kind = nodes.schema["node"].dataType.simpleString()
    roots = nodes.select("root").distinct().join(kept, "root", "left").select("root", "src", "dst")
    return roots.groupBy("root").applyInPandas(walk, f"root {kind}, position int, node {kind}, depth int, repeat boolean")


def topological(nodes: DataFrame, edges: DataFrame, by: str = "project") -> DataFrame:
    """Add ``position``: dependencies first, the least (rank, title, node) of the ready ones next.

    ``nodes``: by node rank title; ``edges``: by src dst, src after dst. The
    order is sequential within a project, so a project is never split; what is
    caught in a cycle comes last, by (rank, title). Projects go to Python by the
    bucket, about ``BUCKET_ROWS`` rows at a time: a call for each small project
    costs many times its work.
    """
    deps = edges.groupBy(by, F.col("src").alias("node")).agg(F.collect_set("dst").alias("__deps"))
    buckets = max(1, -(-nodes.count() // BUCKET_ROWS))
    joined = nodes.join(deps, [by, "node"], "left").withColumn("__bucket", F.pmod(F.xxhash64(by), F.lit(buckets)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)

    def order(table: pa.Table) -> pa.Table:
        members = defaultdict(list)
        for at, project in enumerate(table[by].to_pylist()):
            members[project].append(at)
        rows = list(zip(*(table[c].to_pylist() for c in ("node", "rank", "title", "__deps")), strict=True))
        position = [0] * len(rows)
        for own in members.values():
            place = _ordered([rows[at] for at in own])
            for at in own:
                position[at] = place[rows[at][0]]
        return table.select(names).append_column("position", pa.array(position, pa.int32()))

    names = nodes.columns
    return joined.groupBy("__bucket").applyInArrow(order, kinds + ", position int")


def _ordered(rows: list[tuple]) -> dict:
    """The place of each node of one project's (node, rank, title, deps)."""
    names = {n: (r or "", t or "", n) for n, r, t, _ in rows}
    waits = {n: {d for d in own or () if d in names and d != n} for n, _, _, own in rows}
    loops = {n for n, _, _, own in rows if own and n in own}
    frees = defaultdict(list)
    for n, own in waits.items():
        for d in own:
            frees[d].append(n)
    ready = [names[n] for n, own in waits.items() if not own and n not in loops]
    heapq.heapify(ready)
    place: dict = {}
    while ready:
        n = heapq.heappop(ready)[2]
        place[n] = len(place)
        for other in frees[n]:
            waits[other].discard(n)
            if not waits[other] and other not in loops:
                heapq.heappush(ready, names[other])
    for key in sorted(names[n] for n in names if n not in place):
        place[key[2]] = len(place)
    return place


def facet_graph(nodes: DataFrame, deps: DataFrame, sources: DataFrame | None, kind: str) -> tuple[DataFrame, DataFrame]:
    """One facet's node and edge tables: deps, supersessions, and citations if asked for.

    Ends outside of the facet, or missing, become lean nodes.
    """
    own = nodes.where(F.col("kind") == kind)
    edges = deps.join(own.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", F.lit("dep").alias("kind"))
    if "superseded_by" in nodes.columns:
        edges = edges.union(own.where("superseded_by is not null").select(F.col("id").alias("src"), F.col("superseded_by").alias("dst"), F.lit("superseded_by").alias("kind")))
    if sources is not None:
        edges = edges.union(sources.join(own.select(F.col("id").alias("src")), "src", "left_semi").select("src", F.concat_ws("#", "ref", "heading").alias("dst"), F.lit("source").alias("kind")))
    full = own.select(F.col("id").alias("node"), "title", "status", F.lit(False).alias("lean"))
    ends = edges.select(F.col("dst").alias("node")).distinct().join(full.select("node"), "node", "left_anti")
    lean = ends.join(nodes.select(F.col("id").alias("node"), "title", "status"), "node", "left").withColumn("lean", F.lit(True))
    return full.unionByName(lean), edges.distinct()


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write a graph as two JSON tables under ``path``."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def first_references(references: DataFrame, cap: int = 80) -> DataFrame:
    """The first ``cap`` references of each symbol, in order of place."""
    order = Window.partitionBy("symbol_ref").orderBy("file", "line")
    return references.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__n")
