from __future__ import annotations

from pyspark.sql import functions as F

from knotweave.engine import Engine

KEY = "project string, store string, relpath string"


def test_notes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", "hash:64")
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    e.note_store(one([("p", "notes", "a.md", "# Widgets\nThe frobnicator calibrates gaskets."), ("p", "notes", "b.md", "# Seals\nunder pressure"), ("p", "design", "d.md", "decision text")], KEY + ", body string"))
    hits = e.note_lookup(one([(0, "p", "notes", "frobnicator gaskets")], "query_id int, project string, store string, query string"), 2).orderBy("rank").collect()
    assert hits[0].relpath == "a.md" and {h.store for h in hits} == {"notes"}
    near = e.note_store(one([("p", "notes", "c.md", "The frobnicator calibrates gaskets.")], KEY + ", body string"))
    assert "a.md" in {r.relpath for r in near.collect()}
    counts = {r.action: r.n for r in e.note_reindex().collect()}
    assert counts == {"noop": 4}
    e.note_append(one([("p", "notes", "a.md", "more", "Usage")], KEY + ", content string, heading string"))
    assert "## Usage\n\nmore" in e.note_read(one([("p", "notes", "a.md")], KEY)).first().body
    note_id = e.note_read(one([("p", "notes", "a.md")], KEY)).first().id
    versions = e.note_versions(one([(note_id,)], "id string")).collect()
    assert [v.seq for v in versions] == [1]
    e.note_restore(one([(note_id, 1)], "id string, seq int"))
    assert "Usage" not in e.note_read(one([("p", "notes", "a.md")], KEY)).first().body
    span = e.note_apropos(one([(0, "p", "notes", "frobnicator")], "query_id int, project string, store string, query string"), 3).where("relpath = 'a.md'").first()
    assert (span.start_line, span.end_line) == (1, 2) and span.slice.startswith("# Widgets")
    refused = e.note_move(one([("p", "b.md", "p", "a.md")], "project string, relpath string, to_project string, to_relpath string"))
    assert refused.count() == 1
    e.note_forget(one([("p", "notes", "b.md")], KEY))
    assert {r.relpath for r in e.table("chunks").select("relpath").collect()} == {"a.md", "c.md", "d.md"}


def test_code_and_learnings(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", "hash:64")
    s = "project string, file string, name string, lang string, kind string, container array<string>, content_hash string, signature string, description string, calls array<string>, called_by array<string>"
    e.code_index(spark.createDataFrame([("p", "a.py", "load_index", "python", "function", [], "1", "def load_index(p)", "reads the index from disk", ["save [b.py]"], []), ("p", "b.py", "save", "python", "function", [], "2", "def save(p)", "writes rows", [], ["load_index [a.py]"])], s))
    q = spark.createDataFrame([(0, "p", "load index")], "query_id int, project string, query string")
    assert e.code_lookup(q, 1).first().symbol_ref == "a.py#load_index"
    nodes, edges = e.code_graph(spark.createDataFrame([(0, "p", "load_index")], "query_id int, project string, query string"), depth=2)
    assert {r.node for r in nodes.collect()} == {"a.py#load_index", "b.py#save"} and edges.count() == 1
    assert e.code_dossier(spark.createDataFrame([(0, "p", "save")], "query_id int, project string, query string")).count() == 1
    e.learning_add(spark.createDataFrame([("p", "b.py#save", "beware")], "project string, symbol_ref string, text string"), "2024-01-01")
    assert e.table("learnings").first().body == "### 2024-01-01\n\nbeware\n"
    e.code_index(spark.createDataFrame([("p", "b.py", "save", "python", "function", [], "3", "def save(p)", None, [], [])], s))
    assert e.code_lookup(spark.createDataFrame([(0, "p", "save")], "query_id int, project string, query string"), 2).where("symbol_ref = 'b.py#save'").first().learning.stale
    assert e.learning_report().first().status == "ok"
    assert e.project_status().first().symbols == 2


def test_decisions_and_plans(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", "hash:64")
    n = "project string, id string, kind string, relpath string, title string, body string, rank string"
    e.note_store(spark.createDataFrame([("p", "notes", "spec.md", "# One\ntext")], KEY + ", body string"))
    e.facet_add(spark.createDataFrame([("p", "d1", "design", "d1.md", "Base", "a", "")], n), sources=spark.createDataFrame([("p", "d1", "spec.md", "One")], "project string, id string, ref string, heading string"))
    e.facet_add(spark.createDataFrame([("p", "d2", "design", "d2.md", "Top", "b", ""), ("p", "w1", "plan", "w1.md", "Work", "c", "m")], n), spark.createDataFrame([("p", "d2", "d1"), ("p", "w1", "d2")], "project string, id string, dep string"))
    assert e.tainted().count() == 0 and [r.id for r in e.plan_next().collect()] == ["w1"]
    new = e.facet_edit(spark.createDataFrame([("p", "d1", "changed")], "project string, id string, new_content string"))
    assert {r.id for r in new.collect()} == {"d2", "w1"} and e.plan_next().count() == 0
    assert {tuple(r.chain) for r in e.design_chains().collect()} == {("Top",), ("Work", "Top")}
    e.design_reaffirm(spark.createDataFrame([("p", "d2")], "project string, id string"))
    assert e.tainted().count() == 0
    e.note_edit(spark.createDataFrame([("p", "notes", "spec.md", "# One\nother")], KEY + ", new_content string"))
    assert [(r.id, r.cause) for r in e.causes().collect()] == [("d1", "source-changed")]
    assert e.plan_next().count() == 1  # sources never gate
    assert e.plan_move("p", "w1", after=None) and e.status().first().tainted == 3


def test_paths_imports_and_projects(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", "hash:64")
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    new = "project string, store string, title string, body string"
    made = e.note_create(rows([("p", "notes", "My Note", "a"), ("p", "notes", "My note!", "b"), ("p", "notes", "Other", "c")], new)).collect()
    assert sorted(r.relpath for r in made) == ["my-note-2.md", "my-note.md", "other.md"]
    again = e.note_create(rows([("p", "notes", "my note", "d"), ("q", "notes", "my note", "e")], new)).collect()
    assert {(r.project, r.relpath) for r in again} == {("p", "my-note-3.md"), ("q", "my-note.md")}
    files = "project string, name string, text string"
    e.note_import(rows([("p", "x.md", "first")], files), "2024-01-01")
    before = e.table("notes").where("relpath = 'imported/x.md'").first()
    e.note_import(rows([("p", "x.md", "second")], files), "2024-02-02")
    after = e.table("notes").where("relpath = 'imported/x.md'").first()
    assert (before.body, after.body) == ("first", "second") and before.id == after.id and after.type == "imported:2024-01-01"
    e.note_import_memory(rows([("p", "a.md", "one"), ("p", "b.md", "two"), ("p", "MEMORY.md", "index")], files), "h")
    e.note_import_memory(rows([("p", "a.md", "one more")], files), "h")
    assert {r.relpath: r.body for r in e.table("notes").where("relpath like 'memory/%'").collect()} == {"memory/h/a.md": "one more"}
    spot = e.note_locate(rows([("p", "notes", "other.md"), ("p", "notes", "none.md")], KEY), "/r/").collect()
    assert [r.path for r in spot] == ["/r/p/notes/other.md"]
    assert {r.relpath for r in e.project_migrate("imported/", "in/").collect()} == {"imported/x.md"}
    assert e.table("chunks").where("relpath = 'in/x.md'").count() == 1
    e.project_setup("r", rows([("m.py", "def f(x):\n    return g(x)\n"), ("docs/d.md", "# D\ntext"), ("n.txt", "no")], "file string, text string"))
    assert e.table("symbols").first().symbol_ref == "m.py#f" and e.table("notes").where("project = 'r'").first().relpath == "sources/r/docs/d.md"
    assert {r.status for r in e.code_convert().collect()} == {"noop"}
    counts, dirty = e.project_reconcile()
    assert {r.action for r in counts.collect()} == {"noop"} and dirty.count() == 0
    assert e.project_current(default="z") == "z"
    markers = rows([("/w", "top"), ("/w/sub", "inner")], "root string, project string")
    assert e.project_current(path="/w/sub/x.py", markers=markers) == "inner"
    e.project_use("mine")
    assert e.project_current(path="/w/x.py", markers=markers) == "mine" and e.project_current("named") == "named"
    assert len(e.tables.versions("notes")) <= 8


def test_toml_strings(spark):
    from knotweave.functions import text as T

    odd = ['a"b', "back\\slash \\n", "tab\tline\nend\r", "", "\\\\\""]
    frame = spark.createDataFrame([(t,) for t in odd], "t string").withColumn("e", T.toml_escape(F.col("t")))
    import tomllib

    for r in frame.withColumn("back", T.toml_unescape(F.col("e"))).collect():
        assert tomllib.loads(f'x = "{r.e}"')["x"] == r.t and r.back == r.t
