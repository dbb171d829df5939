from __future__ import annotations

import json
import time

import pytest

from pyspark.sql import functions as F

from knotweave.sources import code, notes, tables, transcripts
from knotweave.streaming import events


def test_notes(spark, tmp_path):
    root = tmp_path / "root"
    (root / "p" / "notes").mkdir(parents=True)
    (root / "p" / "notes" / "a.md").write_text("---\nid: 1x\ntitle: T\ntags: [a, b]\n---\n\nbody\n")
    (root / "p" / "notes" / "b.md").write_text("---\nid: 2x\nbad: [\n---\nbody\n")
    rows = notes.parse(notes.located(notes.scan(spark, str(root)), str(root)))
    got = {r.relpath: r for r in rows.collect()}
    assert (got["a.md"].id, got["a.md"].tags, got["a.md"].body, got["a.md"].project) == ("1x", ["a", "b"], "body\n", "p")
    assert got["b.md"].id == "2x"


def test_heal_header():
    assert notes.heal_header("id: b\nid: a\nx: 1\n") == ("id: a\nx: 1\n", True)
    assert notes.heal_header("id: a\n") == ("id: a\n", False)
    assert notes.heal_header("t:\n  - 1\nt:\n  - 0\n") == ("t:\n  - 1\n", True)


def test_globs(spark):
    rows = spark.createDataFrame([("docs/a.md",), ("docs/x/b.md",), ("src/c.py",)], "relpath string")
    assert {r.relpath for r in notes.in_situ(rows, "r", ["docs/**/*.md"]).collect()} == {"sources/r/docs/a.md", "sources/r/docs/x/b.md"}


def test_python_extraction(spark):
    text = "# about f\n@deco\ndef f(a):\n    def g():\n        pass\n    x = 1\n    return h(a.b())\n\nclass C:\n    def m(self): pass\nTOP = 1\n"
    found = {s["name"]: s for s in code.extract_python(text)}
    assert set(found) == {"f", "g", "C", "m", "TOP"}
    assert found["f"]["comment"] == "about f" and found["f"]["calls"] == ["b", "h"] and found["m"]["container"] == ["C"] and found["m"]["kind"] == "method"
    assert code.extract_python("def (") == []
    files = spark.createDataFrame([("p", "a.py", text), ("p", "b.py", None)], "project string, file string, text string")
    assert code.extract(files).count() == 5
    assert code.leading_comment(["/* one", " * two */", "", "fn x"], 3, "rust") == "one\ntwo"


def test_records(spark, tmp_path):
    (tmp_path / "a.toml").write_text('symbol_ref = "a.py#f"\nname = "f"\nfile = "a.py"\nline = 3\ncalls = ["g [b.py]"]\ncontent_hash = "1"\n')
    (tmp_path / "b.toml").write_text('symbol_ref = "b.py#g"\nname = "g"\nfile = "b.py"\nbroken = \n')
    (tmp_path / "c.toml").write_text("x = 1\n")
    got = {r.symbol_ref: r for r in code.read_records(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py#f", "b.py#g"} and got["a.py#f"].calls == ["g [b.py]"] and got["b.py#g"].content_hash == ""


def test_transcripts(spark, tmp_path):
    lines = [{"timestamp": "2024-01-01T00:00:00Z", "sessionId": "s", "message": {"content": [{"type": "text"}, {"type": "tool_use", "name": "Grep", "input": {"pattern": "x"}}]}}, {"message": {"content": "plain"}}]
    (tmp_path / "t.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["{broken"]))
    rows = transcripts.read(spark, str(tmp_path / "t.jsonl")).collect()
    assert [(r.sid, r.pos, r.tool) for r in rows] == [("s", 1, "Grep")]
    out = spark.createDataFrame([(1, "- one\n2. \"Two\"\n```\n* ONE\n\n")], "k int, text string")
    assert [r.term for r in transcripts.parse_terms(out, "k").orderBy("position").collect()] == ["one", "Two"]


def test_tables(spark, tmp_path):
    store = tables.Tables(spark, f"file://{tmp_path}/t")
    assert not store.exists("notes")
    for n in (1, 2):
        store.write("notes", spark.createDataFrame([("p", "notes", n)], "project string, store string, n int"))
    assert store.read("notes").first().n == 2 and store.versions("notes") == [1, 2]
    store.expire("notes", 1)
    assert store.versions("notes") == [2]


def test_decode(spark):
    rows = spark.createDataFrame([("/r/p/notes/x/a.md", "m"), ("/r/p/other/a.md", "m"), ("/r/p/notes/.a.md.tmp", "m"), ("/else/a", "m")], "path string, event string")
    assert [(r.project, r.store, r.relpath) for r in events.decode(rows, "/r").collect()] == [("p", "notes", "x/a.md")]


def test_stream_debounce(spark, tmp_path):
    rows = [("p", "a", "m1", "2024-01-01 00:00:00.000"), ("p", "a", "m2", "2024-01-01 00:00:00.100"), ("p", "a", "m3", "2024-01-01 00:00:01"), ("p", "a", "end", "2024-01-01 01:00:00")]
    source = spark.createDataFrame(rows, "project string, relpath string, event string, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    source.write.parquet(str(tmp_path / "in"))
    stream = events.watermarked(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), "1 second")
    query = events.debounce(stream, ["project", "relpath"], events.NOTE_GAP).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.event, r.n) for r in spark.table("bursts").collect()}
    assert {("m2", 2), ("m3", 1)} <= got
    static = {(r.event, r.n) for r in events.debounce(source, ["project", "relpath"], events.NOTE_GAP).collect()}
    assert static == {("m2", 2), ("m3", 1), ("end", 1)}


def test_describe_queue(spark, tmp_path):
    rows = spark.createDataFrame([("p", "f.py", "s", "old", 0), ("p", "f.py", "s", "new", 0), ("p", "f.py", "t", "x", 0)], "project string, file string, symbol string, body string, level int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = events.describe_queue(stream, base=0.5).writeStream.format("memory").queryName("settled").outputMode("append").trigger(processingTime="300 milliseconds").option("checkpointLocation", str(tmp_path / "cp")).start()
    end = time.time() + 40
    while time.time() < end and spark.table("settled").count() < 2:
        time.sleep(0.5)
    query.stop()
    assert {(r.symbol, r.body) for r in spark.table("settled").collect()} == {("s", "new"), ("t", "x")}


def test_config(spark):
    import pytest

    from knotweave.sources import config

    assert config.settings({"rerank": False})["rerank"] is False
    with pytest.raises(ValueError):
        config.settings({"other": 1})
    paths = spark.createDataFrame([("/home/a/repo/sub/x.py",), ("/other/y",)], "path string")
    markers = spark.createDataFrame([("/home/a/repo", "outer"), ("/home/a/repo/sub", "inner")], "root string, project string")
    assert {r.path: r.project for r in config.nearest_marker(paths, markers).collect()} == {"/home/a/repo/sub/x.py": "inner", "/other/y": None}
    one = spark.createDataFrame([(None, "", "seed", "d")], "a string, b string, c string, d string")
    assert one.select(config.project_of(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p")).first().p == "seed"


@pytest.mark.parametrize(
    ("lang", "lines", "said"),
    [
        ("python", ["x = 1", "# a", "# b", "@dec", ""], "a\nb"),
        ("python", ["# far", "", "", "# near"], "near"),
        ("python", ["# said", "", "# more", ""], "said\n\nmore".replace("\n\n", "\n")),
        ("python", ["x = 1"], ""),
        ("c", ["int a;", "/* one", "   two", " * three */"], "one\ntwo\nthree"),
        ("rust", ["/// doc", "#[inline]"], "doc"),
        ("lua", ["--[[ block", "text ]]", "-- line"], "block\ntext\nline"),
        ("cobol", ["# none"], ""),
    ],
)
def test_leading_comments(lang, lines, said):
    assert code.leading_comment([*lines, "target"], len(lines), lang) == said
