"""The stored inverted index against scans: edits, unread blocks, failures, corpora."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from knotweave.operators import lexical
from knotweave.sources import postings as P
from knotweave.sources import tables as S

WORDS = [f"w{i}" for i in range(60)]
DOC = "project string, doc_id bigint, text string"


@pytest.fixture(autouse=True)
def no_table_is_tiny(monkeypatch):
    monkeypatch.setattr(S, "WHOLE_BYTES", 0)


def written(rng):
    """A text whose frequent words are far more frequent than its rare ones."""
    return " ".join(WORDS[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randint(0, 40)))


def shown(df, *more):
    return sorted((*(r[c] for c in more), r.query_id, r.doc_id, round(r.score, 8), r["rank"]) for r in df.collect())


def scanned(spark, state, queries, k, corpus=()):
    docs = spark.createDataFrame([(*key, text) for key, text in state.items()], DOC)
    key = ["project", "doc_id"]
    scored = lexical.bm25(queries, lexical.postings(docs, key, F.col("text")), key, docs, corpus=corpus)
    return lexical.top(scored, k, ties=key)


def test_edits_equal_a_scan(spark, tmp_path):
    rng = random.Random(5)
    state = {("p", i): written(rng) for i in range(150)} | {("p", 900): None, ("p", 901): ""}
    frame = lambda rows: spark.createDataFrame(rows, DOC)
    index = P.PostingIndex(S.Tables(spark, f"file://{tmp_path}/i"), ["project", "doc_id"], F.col("text"))
    index.build(frame([(*key, text) for key, text in state.items()] + [("p", None, "w1 w2"), (None, 3, "w1")]))
    queries = spark.createDataFrame([(1, "w0 w30"), (2, "w1 w1 w45 w2"), (3, "unknown"), (4, ""), (5, None), (6, "w50 w51 w52 w53")], "query_id int, query string")
    assert shown(index.top(queries, 4)) == shown(scanned(spark, state, queries, 4))
    for step in range(3):
        came = {("p", rng.randrange(160)): written(rng) + " new" * step for _ in range(3)}
        went = [key for key in rng.sample(list(state), 2)] + [("p", 5000)]
        index.update(frame([(*key, text) for key, text in came.items()]), spark.createDataFrame(went, "project string, doc_id bigint"))
        for key in went:
            state.pop(key, None)
        state |= came
    assert shown(index.top(queries, 4)) == shown(scanned(spark, state, queries, 4))
    head = index._head()
    stored = index._blocks_of(index._postings(index._read("forward", head), head.ref, head.buckets))
    block = ["bucket", "term", "level", "n"]
    assert sorted(map(tuple, index._read("terms", head).select(*block).collect())) == sorted(map(tuple, stored.select(*block).collect()))


def test_an_edit_touches_only_its_terms_buckets(spark, tmp_path):
    rng = random.Random(6)
    tables = S.Tables(spark, f"file://{tmp_path}/i")
    index = P.PostingIndex(tables, ["project", "doc_id"], F.col("text"))
    index.build(spark.createDataFrame([("p", i, written(rng) + " once") for i in range(80)] + [("p", 99, "alpha beta")], DOC))
    before = tables.versions("postings")[-1]
    index.update(spark.createDataFrame([("p", 99, "alpha gamma")], DOC))
    last = tables.versions("postings")[-1]
    assert last == before + 1
    told = tables._commit("postings", last)
    assert told["rows"] == 1 and sum(told["gone"].values()) == 1  # alpha stays where it is
    folder = tmp_path / "i" / "postings" / str(last) / "rows"
    gamma = spark.sql("select 'gamma' as term").select(P.bucket_of(index._head().buckets, "term")).first()[0]
    assert [p.name for p in folder.iterdir() if p.is_dir()] == [f"bucket={gamma}"]


def test_blocks_that_cannot_reach_the_kth_score_are_not_read(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = [("p", i, "common " * rng.randint(1, 3) + written(rng)) for i in range(400)]
    rows += [("p", 1000 + i, "rare rare rare common") for i in range(6)]
    index = P.PostingIndex(S.Tables(spark, f"file://{tmp_path}/i"), ["project", "doc_id"], F.col("text"))
    index.build(spark.createDataFrame(rows, DOC))
    queries = spark.createDataFrame([(1, "rare common")], "query_id int, query string")
    told = index.split(index.blocks(queries), 3)
    sizes = {r.read: r.n for r in told.groupBy("read").agg(F.sum("n").alias("n")).collect()}
    assert sizes[False] >= 300 and sizes[True] <= 106
    seen, partial = [], P.PostingIndex._partial

    def counting(self, blocks, query_key):
        seen.append(blocks.agg(F.sum("n")).first()[0])
        return partial(self, blocks, query_key)

    monkeypatch.setattr(P.PostingIndex, "_partial", counting)
    found = index.top(queries, 3)
    assert sum(seen) <= 50  # of 412 postings: the blocks that set the floor, then those that are left
    assert shown(found) == shown(scanned(spark, {r[:2]: r[2] for r in rows}, queries, 3))


def test_a_failed_update_leaves_the_old_state_and_the_next_one_is_right(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    state = {("p", i): written(rng) for i in range(60)}
    index = P.PostingIndex(S.Tables(spark, f"file://{tmp_path}/i"), ["project", "doc_id"], F.col("text"))
    index.build(spark.createDataFrame([(*key, text) for key, text in state.items()], DOC))
    queries = spark.createDataFrame([(1, "w0 w9 lost found")], "query_id int, query string")
    with monkeypatch.context() as m:
        m.setattr(P.PostingIndex, "_commit", lambda self, ref, buckets: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.update(spark.createDataFrame([("p", 1, "lost")], DOC))
    assert shown(index.top(queries, 5)) == shown(scanned(spark, state, queries, 5))
    index.update(spark.createDataFrame([("p", 2, "found")], DOC))
    state["p", 2] = "found"
    assert shown(index.top(queries, 5)) == shown(scanned(spark, state, queries, 5))


def test_corpora_have_their_own_counts_and_may_be_empty(spark, tmp_path):
    rng = random.Random(9)
    state = {(p, i): written(rng) for p, n in (("a", 50), ("b", 10)) for i in range(n)}
    index = P.PostingIndex(S.Tables(spark, f"file://{tmp_path}/i"), ["project", "doc_id"], F.col("text"), corpus=["project"])
    index.build(spark.createDataFrame([(*key, text) for key, text in state.items()], DOC))
    queries = spark.createDataFrame([(1, "a", "w0 w20"), (2, "b", "w0 w20"), (3, "zz", "w0")], "query_id int, project string, query string")
    assert shown(index.top(queries, 6), "project") == shown(scanned(spark, state, queries, 6, ["project"]), "project")
    none = P.PostingIndex(S.Tables(spark, f"file://{tmp_path}/e"), ["project", "doc_id"], F.col("text"), corpus=["project"])
    none.build(spark.createDataFrame([], DOC))
    assert none.top(queries, 6).count() == 0
    none.update(spark.createDataFrame([("b", 1, "w0")], DOC))
    assert [(r.query_id, r.doc_id) for r in none.top(queries, 6).collect()] == [(2, 1)]


def test_dense_batches_are_scored_where_documents_lie(spark, tmp_path, monkeypatch):
    """Blocks that hold more postings than there are documents make no pairs: the same rows from the documents."""
    rng = random.Random(6)
    state = {("p" if i % 2 else "q", i): written(rng) + " w1" * (i % 3) for i in range(120)} | {("p", 900): None, ("p", 901): ""}
    index = P.PostingIndex(S.Tables(spark, f"file://{tmp_path}/i"), ["project", "doc_id"], F.col("text"), code=True)
    index.build(spark.createDataFrame([(*key, text) for key, text in state.items()], DOC))
    index.update(spark.createDataFrame([("p", 1, "w7 w8 w9"), ("q", 1000, "w1 w1")], DOC), spark.createDataFrame([("q", 2)], "project string, doc_id bigint"))
    queries = spark.createDataFrame([(1, "a", "w0 w30"), (2, "a", "w1 w1 w45 w2"), (2, None, "w1"), (3, "b", "unknown"), (4, "b", ""), (6, "b", "w50 w51 w52 w53")], "query_id int, asker string, query string")
    one = queries.where("asker is not null").drop("asker")
    unread = shown(index.top(one, 4))
    monkeypatch.setattr(P, "SCAN_ROWS", 0)
    monkeypatch.setattr(P.PostingIndex, "split", None)
    assert unread == shown(index.top(one, 4)) and len(unread) > 10
    both = shown(index.top(queries, 4, ["query_id", "asker"]))
    assert len(both) == len(unread) + 4
