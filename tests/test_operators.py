from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from knotweave.operators import chunking, decisions, evaluate, fusion, graph, index, learnings, lexical, ltr, merge, planning, resolve, retrieve


def test_headings_in_fences():
    body = "# Real\ntext\n```toml\n# not a heading\nk = 1\n```\nmore\n## Second\nbody\n"
    paths = [s["path"] for s in chunking.scan_sections(body) if s["text"]]
    assert paths == [["Real"], ["Real", "Second"]]


def test_repeated_headings_and_spans(spark):
    body = "---\nid: x\n---\nintro\n# A\n## Notes\none\n## Notes\ntwo\n"
    spans = {r.section_key: (r.start_line, r.end_line) for r in chunking.line_map(spark.createDataFrame([("n", body)], "relpath string, body string")).collect()}
    assert spans == {"": (4, 4), "A": (5, 5), "A/Notes": (6, 7), "A/Notes#2": (8, 9)}


@pytest.mark.parametrize(("window", "overlap", "count"), [(100, 20, 10), (400, 40, 3)])
def test_windows(spark, window, overlap, count):
    notes = spark.createDataFrame([("p", "notes", "n.md", "# H\n" + " ".join(f"word{i}" for i in range(800)))], "project string, store string, relpath string, body string")
    chunks = chunking.chunk_notes(notes, window, overlap).collect()
    assert len(chunks) == count
    assert len({c.section_hash for c in chunks}) == 1
    assert len({c.chunk_id for c in chunks}) == count


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "restart a single backing server with MCPRestartServer"), (1, "oauth verify the persistent connection in the combiner log"), (2, "the combiner manages per-server processes and lifecycles")], "doc_id int, text string")
    asked = spark.createDataFrame([(0, "restart server"), (1, "kubernetes helm")], "query_id int, query string")
    post = lexical.postings(docs, ["doc_id"], F.col("text"))
    best = lexical.top(lexical.bm25(asked, post, ["doc_id"], docs), 1).collect()
    assert [(r.query_id, r.doc_id) for r in best] == [(0, 0)]


def test_enrichment_weight(spark):
    docs = spark.createDataFrame([(0, "plain words"), (1, "other words")], "doc_id int, text string")
    post = lexical.postings(docs, ["doc_id"], F.col("text"))
    terms = spark.createDataFrame([(0, ["kubernetes"])], "doc_id int, terms array<string>")
    asked = spark.createDataFrame([(0, "kubernetes")], "query_id int, query string")
    scores = []
    for weight in (0.0, 0.5, 1.0):
        rows = lexical.bm25(asked, lexical.enrich(post, ["doc_id"], terms, weight), ["doc_id"], docs).collect()
        scores.append(rows[0].score if rows else 0.0)
    assert scores[0] == 0 < scores[1] < scores[2]


def test_rrf(spark):
    lists = [("q", 0, i, x) for i, x in enumerate("abcd", 1)] + [("q", 1, i, x) for i, x in enumerate("dbxa", 1)]
    order = [r.id for r in fusion.rrf(spark.createDataFrame(lists, "query_id string, list_no int, rank int, id string")).orderBy("rank").collect()]
    assert "b" in order[:2] and order.index("b") < min(order.index("c"), order.index("x"))


@pytest.mark.parametrize(
    ("scores", "ce", "head", "want"),
    [([0.51, 0.50, 0.10], [0, 1, 0.2], 50, "c1 c0 c2"), ([0.9, 0.5, 0.1], [0, 0, 1], 50, "c0 c2 c1"), ([0.9, 0.8, 0.7, 0.6, 0.5], [0.1, 0.9, 1.0, 0, 0], 3, "c1 c0 c2 c3 c4")],
)
def test_rerank(spark, scores, ce, head, want):
    rows = spark.createDataFrame([(0, f"c{i}", s, float(c), i + 1) for i, (s, c) in enumerate(zip(scores, ce, strict=True))], "query_id int, id string, score double, ce double, rank int")
    order = [r.id for r in fusion.rerank(rows, F.col("ce"), head=head).orderBy("rank").collect()]
    assert order == want.split()


def test_rerank_survives_a_broken_scorer(spark):
    rows = spark.createDataFrame([(0, "a", 0.9, None, 1), (0, "b", 0.1, 5.0, 2)], "query_id int, id string, score double, ce double, rank int")
    assert [r.id for r in fusion.rerank(rows, F.col("ce")).orderBy("rank").collect()] == ["a", "b"]


def test_lookup_pipeline(spark):
    notes = spark.createDataFrame([("p", "notes", "a.md", "# Alpha\nthe frobnicator calibrates gaskets"), ("p", "notes", "b.md", "# Beta\nseals under pressure"), ("q", "notes", "c.md", "# Gaskets\nfrobnicator elsewhere")], "project string, store string, relpath string, body string")
    chunks = chunking.chunk_notes(notes).withColumn("document", F.col("window_text")).withColumn("heading_path", F.array_join("heading_path", "/")).withColumns({"tags": F.array(F.lit("t")), "type": F.lit("note")})
    from knotweave.functions.vectors import hash_embedding

    vectors = chunks.select("chunk_id", hash_embedding(F.col("index_text")).alias("v"))
    asked = spark.createDataFrame([(0, "p", "notes", "frobnicator gaskets")], "query_id int, project string, store string, query string")
    hits = retrieve.lookup(asked, chunks, vectors, 3).orderBy("rank").collect()
    assert hits[0].relpath == "a.md" and all(h.project == "p" for h in hits)
    assert retrieve.lookup(asked, chunks, vectors, 3, tags=["none"]).count() == 0
    with pytest.raises(ValueError):
        retrieve.check_arguments(0)


def test_neighbours_of_many_queries(spark, monkeypatch):
    """Dealt by shares or sent to the rows, one hot project or none: the same neighbours as by brute force."""
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    unit = lambda v: [float(x) for x in v / math.sqrt(float(v @ v))]
    rows = [(i, "hot" if i % 3 else f"p{i % 7}", unit(rng.normal(size=6))) for i in range(90)]
    asked = [(i, "hot" if i % 2 else "p0", unit(rng.normal(size=6))) for i in range(12)]
    corpus, queries = spark.createDataFrame(rows, "id int, project string, v array<double>"), spark.createDataFrame(asked, "query_id int, project string, v array<double>")
    for on in ([], ["project"]):
        want = set()
        for q, p, v in asked:
            near = sorted(((-round(float(np.dot(v, w)), 9), i) for i, r, w in rows if not on or r == p))[:4]
            want |= {(q, i, rank + 1) for rank, (_, i) in enumerate(near)}
        for travel in (True, False):
            monkeypatch.setattr(retrieve, "_travel", lambda _, t=travel: t)
            found = retrieve.knn(queries, corpus, 4, ["id"], on=on)
            assert {(r.query_id, r.id, r["rank"]) for r in found.collect()} == want
    monkeypatch.undo()
    wide = queries.select("query_id", F.col("v").alias("__q"))
    assert retrieve._travel(wide) and retrieve._travel(wide.limit(0))
    monkeypatch.setattr(retrieve, "SMALL_BYTES", 500)
    assert not retrieve._travel(wide)


def test_lengths_with_enrichment(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "c")], "id int, text string")
    more = spark.createDataFrame([(1, ["b c", "d"]), (1, ["e"]), (2, ["a", None])], "id int, terms array<string>")
    whole = lexical.enrich(lexical.postings(docs, ["id"], F.col("text")), ["id"], more, 0.5)
    want = {r.id: r.len for r in lexical.document_lengths(whole, ["id"], docs).collect()}
    own = docs.select("id", F.size(F.expr("filter(split(text, ' '), x -> x <> '')")).cast("double").alias("len"))
    assert {r.id: r.len for r in lexical.enriched_lengths(own, ["id"], more, 0.5).collect()} == want == {1: 5.0, 2: 0.5, 3: 1.0}


def test_code_index_gates(spark):
    s = "file string, container array<string>, name string, content_hash string, description string, file_hash string"
    prior = spark.createDataFrame([("a.py", [], "f", "1", "about f", "h0"), ("a.py", [], "gone", "2", "about gone", "h0"), ("b.py", [], "kept", "3", "d", "h1"), ("c.py", [], "lost", "4", "d", "same")], s)
    fresh = spark.createDataFrame([("a.py", [], "f", "1", None, "h2"), ("a.py", [], "new", "9", None, "h2"), ("c.py", [], "x", "5", None, "same")], s)
    files = spark.createDataFrame([("a.py", "h2", 10), ("b.py", "h9", 10), ("c.py", "same", 10)], "file string, file_hash string, code_lines int")
    rows = {(r.file, r.name): (r.state, r.description, r.content_hash) for r in index.code_index(prior, fresh, files).collect()}
    assert rows == {("a.py", "f"): ("same", "about f", "1"), ("a.py", "new"): ("added", None, "9"), ("b.py", "kept"): ("kept", "d", "3"), ("c.py", "lost"): ("dirty", "d", ""), ("c.py", "x"): ("added", None, "5")}


def test_apply_keeps_vectors(spark):
    stored = spark.createDataFrame([("a", "h", [1.0]), ("b", "h", [2.0]), ("c", "h", [3.0])], "chunk_id string, content_hash string, v array<double>")
    fresh = spark.createDataFrame([("a", "h", [9.0]), ("b", "new", [8.0]), ("d", "x", [7.0])], "chunk_id string, content_hash string, v array<double>")
    out = {r.chunk_id: r.v for r in index.apply(stored, fresh, index.plan(fresh, stored)).collect()}
    assert out == {"a": [1.0], "b": [8.0], "d": [7.0]}


def _build(spark):
    """A build graph: web and cli need api, api needs db and log, db needs log and libc."""
    pairs = [("web", "api"), ("cli", "api"), ("web", "css"), ("api", "db"), ("api", "log"), ("db", "log"), ("db", "libc"), ("css", "log")]
    return spark.createDataFrame(pairs, "src string, dst string")


def _roots(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "root string, node string")


def test_walks_by_depth(spark):
    nodes, edges = graph.bfs(_roots(spark, "web", "cli"), _build(spark), 5)
    depths = {}
    for r in nodes.collect():
        depths.setdefault(r.root, {})[r.node] = r.depth
    assert depths == {"web": {"web": 0, "api": 1, "css": 1, "db": 2, "log": 2, "libc": 3}, "cli": {"cli": 0, "api": 1, "db": 2, "log": 2, "libc": 3}}
    assert edges.where("root = 'web'").count() == 7 and edges.where("root = 'cli'").count() == 5
    near, _ = graph.bfs(_roots(spark, "web"), _build(spark), 1)
    assert {r.node for r in near.collect() if r.truncated} == {"api", "css"}
    _, arrows = graph.bfs(_roots(spark, "log"), _build(spark), 1, "callers")
    assert {(r.src, r.dst) for r in arrows.collect()} == {("api", "log"), ("db", "log"), ("css", "log")}


def test_rollup_and_process_tree(spark):
    files = {"web": "ui.py", "css": "ui.py", "cli": "ui.py", "api": "srv.py", "db": "srv.py", "log": "srv.py"}
    nodes = spark.createDataFrame([(n, f, [], False, False) for n, f in files.items()], "node string, file string, scope array<string>, external boolean, truncated boolean")
    groups, links = graph.roll_up(nodes, _build(spark), "file")
    assert {r.group: r.symbols for r in groups.collect()} == {"ui.py": 3, "srv.py": 3}
    assert {(r.src, r.dst): r.weight for r in links.collect()} == {("ui.py", "ui.py"): 1, ("ui.py", "srv.py"): 3, ("srv.py", "srv.py"): 3}
    tree = graph.process_tree(_roots(spark, "web"), _build(spark), 6).orderBy("position").collect()
    assert [(r.node, r.depth, r.repeat) for r in tree] == [("web", 0, False), ("api", 1, False), ("db", 2, False), ("libc", 3, False), ("log", 3, False), ("log", 2, True), ("css", 1, False), ("log", 2, True)]


def test_cycles_of_random_graphs(spark):
    import random

    rng = random.Random(4)
    for size, count in ((8, 12), (20, 33)):
        pairs = [(rng.randrange(size), rng.randrange(size)) for _ in range(count)]
        reach = {a: {a} for a in range(size)}
        for _ in range(size):
            for a, b in pairs:
                for own in reach.values():
                    if a in own:
                        own.add(b)
        sets = {tuple(sorted(b for b in reach[a] if a in reach[b])) for a in range(size)}
        want = sorted(list(s) for s in sets if len(s) > 1 or (s[0], s[0]) in pairs)
        assert sorted(r.members for r in graph.cycles(spark.createDataFrame(pairs, "src int, dst int")).collect()) == want
    assert graph.cycles(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "c"), ("d", "gone"), ("a", "d")], "src string, dst string")
    assert sorted(r.members for r in graph.cycles(edges).collect()) == [["a", "b"], ["c"]]


def test_topological_breaks_ties_by_rank(spark):
    nodes = spark.createDataFrame([("p", "x", "c", "X"), ("p", "y", "a", "Y"), ("p", "z", "b", "Z"), ("p", "l", "a", "L"), ("p", "m", "a", "M")], "project string, node string, rank string, title string")
    edges = spark.createDataFrame([("p", "y", "x"), ("p", "l", "m"), ("p", "m", "l"), ("p", "z", "gone")], "project string, src string, dst string")
    assert [r.node for r in graph.topological(nodes, edges).orderBy("position").collect()] == ["z", "x", "y", "l", "m"]


def test_taint(spark):
    nodes = spark.createDataFrame([("p", i, "design", f"{i}.md", t, s, h) for i, t, s, h in [("a", "A", "active", "1"), ("b", "B", "active", "2"), ("c", "C", "proposed", "3"), ("d", "D", "active", "4"), ("e", "E", "active", "5")]], "project string, id string, kind string, relpath string, title string, status string, body_hash string")
    deps = spark.createDataFrame([("p", "a", "b", "old"), ("p", "d", "a", "1"), ("p", "c", "a", "1"), ("p", "e", "c", None)], "project string, id string, dep string, checked string")
    causes = decisions.direct_causes(nodes, deps)
    assert [(r.id, r.cause) for r in causes.collect()] == [("a", "dep-edited")]
    marked = decisions.tainted(nodes, deps, causes)
    assert {r.id for r in marked.collect()} == {"a", "c", "d"}  # a proposed node is tainted, but spreads nothing
    paths = {(r.id, tuple(r.chain)) for r in decisions.chains(nodes, deps, causes, marked).collect()}
    assert paths == {("a", ("A",)), ("d", ("D", "A")), ("c", ("C", "A"))}
    fixed = decisions.reaffirm(deps, nodes, spark.createDataFrame([("p", "a")], "project string, id string"))
    assert decisions.direct_causes(nodes, fixed).count() == 0
    with pytest.raises(ValueError):
        decisions.add_deps(deps, spark.createDataFrame([("p", "b", "d")], "project string, id string, dep string"), nodes, False)
    left, refused = decisions.forget(nodes, deps, spark.createDataFrame([("p", "a"), ("p", "e")], "project string, id string"))
    assert {r.id for r in refused.collect()} == {"a"} and left.count() == 4


def test_three_way_merge(spark):
    s = "record string, key string, value string"
    base = spark.createDataFrame([("n", "imported", "2026-01-01"), ("n", "id", "1")], s)
    ours = spark.createDataFrame([("n", "imported", "2026-06-27"), ("n", "id", "1"), ("n", "source_repo", "$HOME/a"), ("n", "content_hash", "x")], s)
    theirs = spark.createDataFrame([("n", "imported", "2026-06-28"), ("n", "id", "1"), ("n", "source_repo", "$HOME/b"), ("n", "content_hash", "y")], s)
    for o, t in ((ours, theirs), (theirs, ours)):
        out = {r.key: r.value for r in merge.merge_symbols(base, o, t).collect()}
        assert out == {"id": "1", "imported": "2026-06-27", "source_repo": "$HOME/a", "content_hash": ""}


def test_merge_lines():
    assert merge.merge_lines("a\nb\nc\n", "A\nb\nc\n", "a\nb\nC\n") == ("A\nb\nC\n", False)
    text, conflict = merge.merge_lines("a\n", "x\n", "y\n")
    assert conflict and "x\n" in text and "y\n" in text
    assert merge.merge_lines("a\n", "a\nn\n", "a\nn\n") == ("a\nn\n", False)


def test_versions(spark):
    versions = spark.createDataFrame([("a", i, f"v{i}") for i in range(1, 21)], "id string, seq int, body string")
    new = spark.createDataFrame([("a", "new", 1), ("b", "first", 1)], "id string, body string, at int")
    out = merge.stash(versions, new).orderBy("id", "seq").collect()
    assert [(r.id, r.seq) for r in out if r.id == "b"] == [("b", 1)]
    assert [r.seq for r in out if r.id == "a"] == list(range(2, 22))


def test_learnings(spark):
    e = "symbol_ref string, fqn string, name string, file string, content_hash string, signature string, symbol_was array<string>"
    symbols = spark.createDataFrame([("a.py#f", "a.f", "f", "a.py", "1", "def f(x, y)", ["old.f"]), ("b.py#g", "b.g", "g", "b.py", "2", "def g(x)", [])], e)
    n = "relpath string, symbol_ref string, symbol_was array<string>, file string, content_hash string, signature string, body string"
    notes = spark.createDataFrame([("1.md", "old.f", [], "z.py", "0", "", " hi "), ("2.md", "c.py#g", [], "b.py", "2", "def g(x)", "")], n)
    got = {r.symbol_ref: r.learning for r in learnings.attach(symbols, notes).collect()}
    assert got["a.py#f"].stale and got["a.py#f"].body == "hi" and got["b.py#g"] is None
    assert {r.relpath: r.status for r in learnings.report(notes, symbols).collect()} == {"1.md": "moved", "2.md": "orphan"}
    best = learnings.candidates(notes.where("relpath = '2.md'"), symbols).orderBy("rank").collect()
    assert (best[0].symbol_ref, best[0].score) == ("b.py#g", 7.0)
    status = {r.relpath: r.status for r in learnings.convert(notes, symbols).collect()}
    assert status == {"1.md": "convert", "2.md": "orphan"}


def test_ambiguity(spark):
    e = "project string, symbol_ref string, file string, container array<string>, name string, lang string, symbol_was array<string>"
    symbols = spark.createDataFrame([("p", "a.py#foo", "a.py", [], "foo", "python", []), ("p", "b.py#foo", "b.py", [], "foo", "python", []), ("dep", "util.py#helper", "util.py", [], "helper", "python", [])], e)
    asked = spark.createDataFrame([(0, "p", "foo"), (1, "p", "a.foo"), (2, "p", "nope.nope"), (3, "p", "util.helper")], "query_id int, project string, query string")
    callers = spark.createDataFrame([("b.py#foo", 5)], "symbol_ref string, callers int")
    refs = spark.createDataFrame([("p", "dep", 0)], "project string, ref string, position int")
    out = {r.query_id: r for r in resolve.local_then_refs(asked, symbols, refs, callers).collect()}
    assert out[0].status == "ambiguous" and [c.symbol_ref for c in out[0].candidates] == ["b.py#foo", "a.py#foo"]
    assert out[1].symbol_ref == "a.py#foo" and out[2].status == "unknown"
    assert (out[3].symbol_ref, out[3].found_in) == ("util.py#helper", "dep")


def test_plan_groups(spark):
    n = "project string, id string, kind string, title string, status string, body_hash string, rank string"
    nodes = spark.createDataFrame([("p", "d", "design", "D", "proposed", "1", ""), ("p", "x", "plan", "X", "todo", "2", "a"), ("p", "y", "plan", "Y", "todo", "3", "b"), ("p", "z", "plan", "Z", "in-progress", "4", "c"), ("p", "w", "plan", "W", "done", "5", "d")], n)
    deps = spark.createDataFrame([("p", "x", "d", "1"), ("p", "y", "w", "5"), ("p", "y", "note", None), ("p", "z", "void", None)], "project string, id string, dep string, checked string")
    notes = spark.createDataFrame([("p", "note")], "project string, id string")
    rows = planning.blocking(nodes, deps, nodes.select("project", "id").limit(0), notes)
    got = {r.id: (r.group, r.blocked_by, r.note_deps, r.missing_deps) for r in rows.collect()}
    assert got == {"x": ("blocked", ["d"], [], []), "y": ("ready", [], ["note"], []), "z": ("in-progress", [], [], ["void"]), "w": ("done", [], [], [])}
    assert [r.id for r in planning.working_set(rows, deps).orderBy("place").collect()] == ["z", "y", "x"]
    assert [r.id for r in planning.next_items(rows, deps).collect()] == ["y"]


def test_learning_to_rank(spark):
    rows = [(q, f"i{i}", float(i == 2), float(i == 2) + 0.1 * i, 0.5) for q in range(4) for i in range(4)]
    out = ltr.leave_one_out(spark.createDataFrame(rows, "query_id int, id string, label double, a double, b double"), ["a", "b"])
    assert {r.query_id: r["rank"] for r in out.collect()} == {0: 1, 1: 1, 2: 1, 3: 1}


def test_gold_queries(spark):
    terms = spark.createDataFrame([("a.md", "H", ["shared phrase", "only  here  now", "short"]), ("b.md", "G", ["Shared Phrase"])], "relpath string, heading string, terms array<string>")
    assert [(r.query, r.relpath) for r in evaluate.gold_queries(terms).collect()] == [("only here now", "a.md")]


def test_chains_and_trees_of_any_depth(spark):
    n = 28
    ids = [f"n{i:02d}" for i in range(n)]
    nodes = spark.createDataFrame([("p", i, "design", f"{i}.md", i.upper(), "active", i) for i in ids], "project string, id string, kind string, relpath string, title string, status string, body_hash string")
    deps = spark.createDataFrame([("p", ids[i], ids[i + 1], "old" if i == n - 2 else ids[i + 1]) for i in range(n - 1)], "project string, id string, dep string, checked string")
    causes = decisions.direct_causes(nodes, deps)
    marked = decisions.tainted(nodes, deps, causes)
    found = {r.id: r.chain for r in decisions.chains(nodes, deps, causes, marked).collect()}
    assert len(found["n00"]) == n - 1 and found["n00"][-1] == "N26"
    from knotweave.sources import code

    rows = [("f", i, i - 1 if i else None, f"c{i}", "class") for i in range(n)]
    flat = {r.id: r.container for r in code.flatten_tree(spark.createDataFrame(rows, "file string, id int, parent int, name string, kind string")).collect()}
    assert len(flat) == n and flat[n - 1] == [f"c{i}" for i in range(n - 1)]


@pytest.mark.parametrize(
    ("body", "paths"),
    [
        ("~~~\n# no\n```\n# no\n~~~\n# yes\n", [["yes"]]),
        ("## b\n# a\n### c\n## d\n", [["b"], ["a"], ["a", "c"], ["a", "d"]]),
        ("```\n# never closed\n# no\n", []),
        ("  ```py\n# no\n  ```\n#nospace\n####### seven\n###### six", [["six"]]),
        ("# a\r\n```\r\n# no\r\n```\r\n# b", [["a"], ["b"]]),
        ("", []),
        (None, []),
    ],
)
def test_heading_paths(body, paths):
    assert [s["path"] for s in chunking.scan_sections(body)][1:] == paths


def test_small_is_by_rows_and_bytes(spark):
    from knotweave.storage import is_small

    wide = spark.range(9).withColumn("t", F.repeat(F.lit("x"), 8 << 20))
    assert not is_small(wide) and is_small(wide.limit(3)) and is_small(spark.range(100)) and not is_small(spark.range(100), 99)
    assert is_small(spark.range(0).withColumn("m", F.create_map(F.lit("a"), F.array(F.lit("b")))))
