"""Versions of tables: deltas against tables written anew, failures between two files, compaction."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from knotweave.sources import tables as S

NOTE = "project string, store string, relpath string, body string, tags array<string>"
KEY = ["project", "store", "relpath"]


@pytest.fixture(autouse=True)
def no_table_is_tiny(monkeypatch):
    monkeypatch.setattr(S, "WHOLE_BYTES", 0)


def shown(df):
    return sorted(((r.project, r.store, r.relpath, r.body, r.tags) for r in df.collect()), key=repr)


def test_random_edits_equal_a_table_written_anew(spark, tmp_path):
    tables, rng = S.Tables(spark, f"file://{tmp_path}/t"), random.Random(3)
    projects = ["a", "b c", "d/e%=", "ü"]
    state: dict[tuple, tuple] = {(rng.choice(projects), "notes", f"n{i}.md"): (f"body {i}", ["t"]) for i in range(300)}
    tables.write("notes", spark.createDataFrame([(*k, *v) for k, v in state.items()], NOTE))
    sizes = {}
    for step in range(50):
        came = {}
        for _ in range(rng.randint(0, 3)):
            key = rng.choice(list(state)) if rng.random() < 0.7 else (rng.choice(projects), "notes", f"new{step}.md")
            came[key] = (f"edit {step}", [str(step)] if step % 2 else None)
        went = [k for k in rng.sample(list(state), rng.randint(0, 2)) if k not in came] + [("zz", "notes", "unknown.md")]
        tables.change("notes", KEY, spark.createDataFrame([(*k, *v) for k, v in came.items()], NOTE), spark.createDataFrame(went, ", ".join(NOTE.split(", ")[:3])))
        for k in went:
            state.pop(k, None)
        state |= came
        last = tables.versions("notes")[-1]
        if (told := tables._commit("notes", last)) is not None:
            assert told["rows"] == len(came)
            assert sum(told["gone"].values()) <= len(came) + len(went)
        sizes[last] = len(state)
        if step % 16 == 1:
            assert shown(tables.read("notes")) == sorted(((*k, *v) for k, v in state.items()), key=repr)
            old = [v for v in sizes if v in tables.versions("notes")][0]
            assert tables.read("notes", old).count() == sizes[old]
            tables.expire("notes", 8)
            assert len(tables.versions("notes")) <= 8
    assert shown(tables.read("notes")) == sorted(((*k, *v) for k, v in state.items()), key=repr)
    assert shown(tables.read("notes").where("project = 'b c'")) == sorted(((*k, *v) for k, v in state.items() if k[0] == "b c"), key=repr)


def test_a_failure_between_two_files_leaves_the_old_state(spark, tmp_path, monkeypatch):
    tables = S.Tables(spark, f"file://{tmp_path}/t")
    one = lambda *rows: spark.createDataFrame([("p", "notes", r, b, None) for r, b in rows], NOTE)
    tables.write("notes", one(("a", "1"), ("b", "2")))
    for broken in ("_settle", "_delta"):
        with monkeypatch.context() as patch:
            patch.setattr(S.Tables, broken, lambda *_: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError):
                tables.change("notes", KEY, one(("a", "9"), ("c", "9")))
        assert [r[2:4] for r in shown(tables.read("notes"))] == [("a", "1"), ("b", "2")] and tables.versions("notes") == [1]
    tables.change("notes", KEY, one(("a", "3")))
    assert [r[2:4] for r in shown(tables.read("notes"))] == [("a", "3"), ("b", "2")]
    assert [r[2:4] for r in shown(tables.read("notes", 1))] == [("a", "1"), ("b", "2")]


def test_changes_from_the_table_itself_and_odd_rows(spark, tmp_path, monkeypatch):
    tables = S.Tables(spark, f"file://{tmp_path}/t")
    rows = [("p", "notes", None, "no key", None), ("p", "notes", None, "no key", None), ("p", "notes", "a", "1", []), ("p", "notes", "a", "1", []), (None, "notes", "x", "2", None)]
    tables.change("notes", KEY, spark.createDataFrame(rows, NOTE))
    tables.change("notes", KEY, tables.read("notes").where("relpath = 'a'").distinct().withColumn("body", F.concat("body", F.lit("!"))))
    want = sorted([rows[0], rows[1], ("p", "notes", "a", "1!", []), rows[4]], key=repr)
    assert shown(tables.read("notes")) == want
    tables.replace("notes", tables.read("notes").where("body <> '2'").unionByName(spark.createDataFrame([("q", "notes", "z", "new", ["t"])], NOTE)))
    last = tables.versions("notes")[-1]
    assert tables._commit("notes", last)["rows"] == 1 and sum(tables._commit("notes", last)["gone"].values()) == 1
    assert shown(tables.read("notes")) == sorted([*(w for w in want if w[3] != "2"), ("q", "notes", "z", "new", ["t"])], key=repr)
    monkeypatch.setattr(S, "MAX_DELTAS", 1)
    tables.change("notes", KEY, gone=spark.createDataFrame([("p", "notes", "a")], "project string, store string, relpath string"))
    assert tables._chain("notes")[1] == {} and "a" not in {r.relpath for r in tables.read("notes").collect()}
    monkeypatch.setattr(S.storage, "SMALL_ROWS", 0)  # places that are many are joined by a shuffle
    monkeypatch.setattr(S, "MAX_DELTAS", 9)
    tables.change("notes", KEY, gone=spark.createDataFrame([("q", "notes", "z")], "project string, store string, relpath string"))
    assert "z" not in {r.relpath for r in tables.read("notes").collect()}
    with pytest.raises(ValueError, match="no version"):
        tables.read("notes", 99)


def test_a_tiny_table_is_written_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "WHOLE_BYTES", 1 << 20)
    tables = S.Tables(spark, f"file://{tmp_path}/t")
    tables.write("notes", spark.createDataFrame([("p", "notes", "a", "1", None), ("p", "notes", None, "2", None)], NOTE))
    tables.change("notes", KEY, spark.createDataFrame([("p", "notes", "a", "3", None)], NOTE), spark.createDataFrame([("p", "notes", None)], "project string, store string, relpath string"))
    assert sorted(r.body for r in tables.read("notes").collect()) == ["2", "3"] and tables._chain("notes") == (2, {})
