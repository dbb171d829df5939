"""Lookups of a batch: each project by itself, as by joins, and embeddings that cost one pass."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import functions as F

from knotweave.functions import vectors as V
from knotweave.operators import embedding, retrieve


def by_hand(text: str, dim: int) -> list[float]:
    v = [0.0] * dim
    for w in text.lower().split():
        d = int(hashlib.md5(w.encode()).hexdigest(), 16)
        v[d % dim] += 1.0 if d >> 8 & 1 else -1.0
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v] if n else v


def test_embedding_costs_one_pass(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 900}é" for j in range(600)) for i in range(150)] + ["", "  ", "One one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    began = time.time()
    for dim in (64, 256):
        got = {r.id: r.v for r in rows.select("id", V.hash_embedding(F.col("text"), dim).alias("v")).collect()}
        assert all(abs(a - b) < 1e-12 for i, t in enumerate(texts) for a, b in zip(got[i], by_hand(t, dim), strict=True))
    assert time.time() - began < 30  # the length once for each component took minutes


def test_batch_equals_joins(spark, monkeypatch):
    words = "copper gasket valve ring bolt plate pump seal rotor shaft Maße café K".split()
    chunks = []
    for i in range(120):
        body = None if i == 5 else " ".join(words[(i * a + a * a) % len(words)] for a in range(i % 9))
        chunks.append((None if i == 77 else f"c{i:03}", None if i == 78 else "pqr"[i % 3], "notes" if i % 4 else "design", f"f{i % 7}.md", f"h/{i % 5}", 1, body, [], "note"))
    chunks = spark.createDataFrame(chunks, "chunk_id string, project string, store string, relpath string, heading_path string, occurrence int, document string, tags array<string>, type string")
    vectors = embedding.dense(embedding.sparse(chunks.where("chunk_id is not null"), ["chunk_id"], "document", 64), ["chunk_id"], 64)
    asked = spark.createDataFrame([(0, "p", "notes", "copper gasket"), (1, "q", "notes", "copper ring ring"), (2, "p", "design", "valve café"), (3, "none", "notes", "copper"), (4, None, "notes", "copper"), (5, "q", "notes", "!?")], "query_id int, project string, store string, query string")

    def found():
        hits = retrieve.lookup(asked, chunks, vectors, 5, embed=lambda t: V.hash_embedding(t, 64))
        return sorted((r.query_id, r["rank"], r.chunk_id, r.project, round(r.score, 4), r.snippet) for r in hits.collect())

    batch = found()
    monkeypatch.setattr(retrieve, "BATCH", -1)
    assert batch == found() and {r[0] for r in batch} >= {0, 1, 2} and {r[0] for r in batch}.isdisjoint({3, 4})
