"""Steps whose cost must follow the rows, not the values or the pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from knotweave.operators import chunking, resolve


def test_spans_of_any_length(spark):
    rng = random.Random(5)
    spans = [("a", 0, 10**12, "file"), ("b", 7, 3, "upside down"), (None, 0, 9, "none")]
    for n in range(60):
        start = rng.choice([rng.randrange(-70, 600), rng.randrange(10**12)])
        spans.append((rng.choice("ab"), start, start + rng.choice([0, 1, 7, 8, 63, 300, 10**9]), f"s{n % 9}"))
    points = [(f, x) for f, a, b, _ in spans if f for x in (a - 1, a, b, b + 1)] + [("a", 5), ("a", 5), ("c", 5), (None, 5), ("a", None)]

    def inner(f, x):
        over = [(b - a, -a, name) for g, a, b, name in spans if x is not None and g == f is not None and a <= x <= b]
        return min(over)[2] if over else None

    got = chunking.enclosing(spark.createDataFrame(points, "file string, line bigint"), spark.createDataFrame(spans, "file string, start_line bigint, end_line bigint, name string"), "file", "line")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((f, x, inner(f, x)) for f, x in points), key=key)


@pytest.mark.parametrize("few", [True, False])
def test_symbols_never_travel(spark, monkeypatch, few):
    """Symbols' keys and paths outgrow the file sizes by which Spark would broadcast them."""
    monkeypatch.setattr(resolve, "is_small", lambda rows: few, raising=False)
    symbols = spark.range(50).select(F.lit("p").alias("project"), F.concat(F.lit("f.py#n"), "id").alias("symbol_ref"), F.lit("f.py").alias("file"), F.array().cast("array<string>").alias("container"), F.concat(F.lit("n"), "id").alias("name"), F.lit("python").alias("lang"), F.array().cast("array<string>").alias("symbol_was"))
    queries = spark.range(50).select(F.col("id").alias("query_id"), F.lit("p").alias("project"), F.concat(F.lit("n"), "id").alias("query"))
    found = resolve.matches(queries, symbols)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("BuildRight" in plan and "BroadcastHashJoin" in plan) if few else ("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan)
    assert {(r.query_id, r.symbol_ref, r.tier) for r in found.collect()} == {(n, f"f.py#n{n}", "name") for n in range(50)}


def test_a_poor_first_text_costs_one_row(spark):
    """A bucket whose first text is unlike the others: it alone is compared with all of them."""
    from knotweave.llm import neardup

    members = spark.range(40).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("n"), F.lit(9).alias("size"), F.lit(0).cast("long").alias("first"))
    classes = spark.range(1, 40).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("root"))
    assert [(r.key, r.n) for r in neardup._apart(members, classes).collect()] == [(1, 0)]


@pytest.mark.parametrize("block", [1, 1 << 21])
def test_batches_match_the_joins(spark, monkeypatch, block):
    from knotweave.operators import batch, embedding, lexical

    monkeypatch.setattr(batch, "BLOCK", block)
    rng = random.Random(3)
    words = [*"abcdefgh", "the", "server", "restart", "éa", "x_1"]
    docs = spark.createDataFrame([(f"d{n}", " ".join(rng.choices(words, k=rng.randrange(12)))) for n in range(60)] + [("null", None), ("none", "")], "id string, text string").repartition(3)
    asked = spark.createDataFrame([(n, " ".join(rng.choices(words, k=4))) for n in range(7)] + [(7, "the the"), (8, "unknown"), (9, "")], "query_id bigint, query string")
    post = lexical.postings(docs, ["id"], F.col("text"))
    told = lambda rows, *c: {(r.query_id, r.id): tuple(round(r[x], 9) for x in c) for r in rows.collect()}
    scored, share = lexical.bm25(asked, post, ["id"], docs), lexical.coverage(asked, post, ["id"])
    both = scored.join(share, ["query_id", "id"]).select("query_id", "id", (F.col("score") * F.col("coverage")).alias("score"))
    terms = batch.Terms(asked, docs, ["id"], F.col("text"))
    assert told(terms.coverage(), "coverage") == told(share, "coverage")
    assert told(terms.best(3), "score", "rank") == told(lexical.top(scored, 3, ties=["id"]), "score", "rank")
    assert told(terms.best(3, covered=True), "score", "rank") == told(lexical.top(both, 3, ties=["id"]), "score", "rank")
    some = scored.where("query_id % 2 = 0 and id > 'd3'")
    assert told(terms.scores(some.select("query_id", "id")), "score") == told(some, "score")
    vectors, queries = (batch.hashed(rows, [key], text, 16) for rows, key, text in ((docs, "id", "text"), (asked, "query_id", "query")))
    old = embedding.dense(embedding.sparse(docs, ["id"], "text", 16), ["id"], 16)
    assert {r.id: [round(x, 12) for x in r.v] for r in vectors.collect()} == {r.id: [round(x, 12) for x in r.v] for r in old.collect()}
    from knotweave.functions import vectors as V

    queries = queries.withColumnRenamed("v", "q")
    cosines = queries.crossJoin(vectors).select("query_id", "id", V.dot(F.col("q"), F.col("v")).alias("cosine"))
    assert told(batch.nearest(queries, vectors, ["id"], 4), "cosine", "rank") == told(lexical.top(cosines, 4, score="cosine", ties=["id"]), "cosine", "rank")


def test_pairs_are_never_shuffled(spark):
    """Each task lets go all but the best of its documents before a shuffle."""
    from knotweave.plans import retrieval

    plan = retrieval.bm25_topk(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "HashAggregate" not in plan


def test_projects_are_ordered_together(spark, monkeypatch):
    """Small projects share a call; their numbers stay exact next to a null one."""
    from knotweave.operators import graph

    monkeypatch.setattr(graph, "BUCKET_ROWS", 1000, raising=False)
    big = 2**60
    nodes = spark.createDataFrame([(p, n, "m", str(n)) for p in (big, big + 1, None) for n in range(5)], "project bigint, node int, rank string, title string")
    edges = spark.createDataFrame([(p, 0, 4) for p in (big, big + 1)] + [(big, 4, 3), (big, 3, 4)], "project bigint, src int, dst int")
    rows = graph.topological(nodes, edges)
    got = {p: [r.node for r in sorted(rows.collect(), key=lambda r: r.position) if r.project == p] for p in (big, big + 1, None)}
    assert got == {big: [1, 2, 0, 3, 4], big + 1: [1, 2, 3, 4, 0], None: [0, 1, 2, 3, 4]}
    assert "__bucket" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_spread_writes_about_the_edges(spark, monkeypatch):
    """A chain of taint: edges to what is tainted already are not read again."""
    from knotweave.operators import decisions

    written = []
    keep = decisions.saved
    monkeypatch.setattr(decisions, "saved", lambda rows: written.append(keep(rows)) or written[-1])
    nodes = spark.range(40).select(F.lit(1).alias("project"), F.col("id").cast("string").alias("id"), F.lit("active").alias("status"))
    deps = spark.range(1, 40).select(F.lit(1).alias("project"), F.col("id").cast("string").alias("id"), F.when(F.col("id") < 37, "0").otherwise((F.col("id") - 1).cast("string")).alias("dep"))
    marked = decisions.tainted(nodes, deps, nodes.where("id = '0'"))
    assert marked.count() == 40
    edges = [w.count() for w in written if "from" in w.columns]
    assert edges == [39, 3, 2, 1, 0]


def test_hot_keys_are_named_not_joined(spark):
    """Rows of frequent keys leave the rest by a filter: the rest is joined once."""
    from knotweave.llm import neardup

    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).cast("long").alias("key"), "id")
    keys = rows.groupBy("key").agg(F.count("*").alias("w"), F.min("id").alias("first"))
    out = neardup.join_counted(rows, keys, ["key"], 3000)
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(1, n, 0) for n in range(2000)] + [(n, n, n) for n in range(2000, 3000)]
