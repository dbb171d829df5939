from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from knotweave.llm import queries as Q
from knotweave.llm import toxicity as X


def corpus(seed=4, n=400):
    rng = np.random.default_rng(seed)
    plain, bad = [f"word{i}" for i in range(120)], ["vile", "vilest", "wretch", "scum"]
    rows = []
    for i in range(n):
        words = rng.choice(plain, rng.integers(20, 60)).tolist()
        if i % 5 == 0:
            words[:: len(words) // 4] = rng.choice(bad, len(words[:: len(words) // 4])).tolist()
        rows.append((i, " ".join(words).capitalize() + ".", int(i % 5 == 0)))
    return rows


def model_of(spark, rows, **more):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id bigint, toxic int")
    return docs, X.learn(docs, labels, F.col("doc_id") % 4 != 0, **more)


def test_nearest_are_exact_and_blocks_are_left_out(spark):
    rows = corpus()
    _, model = model_of(spark, rows, evidence=0.0)
    judge = X.Judge(model)
    own, term, weight = judge.space.vectors(pa.array(model.texts))
    dense = np.zeros((len(model.texts), len(judge.space.idf)))
    dense[own, term] = weight
    assert np.allclose((dense**2).sum(1), 1)
    index = X.BlockMaxIndex(own, term, weight, dense.shape[1], len(dense), block=4)
    for n in range(0, len(dense), 7):
        t = np.flatnonzero(dense[n])
        near, score = index.nearest(t, dense[n][t], 5, skip=n)
        want = dense @ dense[n]
        want[n] = -1
        best = sorted(range(len(dense)), key=lambda i: (-round(want[i], 12), i))[:5]
        assert near.tolist() == best and np.allclose(score, want[best])
    index.scored = 0
    rare = np.argmax(judge.space.idf)
    index.nearest(np.array([rare]), np.ones(1), 2)
    assert index.scored < index.blocks  # blocks without the term are not looked at
    lumps = X.BlockMaxIndex(np.arange(4000), np.zeros(4000, int), np.where(np.arange(4000) < 64, 1.0, 0.1), 1, 4000)
    lumps.nearest(np.zeros(1, int), np.ones(1), 10)
    assert lumps.scored <= 4 < lumps.blocks  # the others' bounds are below the tenth


def test_counts_cover_all_documents(spark):
    rows = corpus(n=100) + [(1000 + i, "vile thing", None) for i in range(40)] + [(None, "vile", None), (1, None, None)]
    docs, model = model_of(spark, rows)
    assert model.docs == len(rows) and model.words == sorted(model.words)
    where = model.words.index(int(X.terms_of(pa.array(["scum"]))[1].max())) if int(X.terms_of(pa.array(["scum"]))[1].max()) in model.words else None
    for k, df in zip(model.words, model.df, strict=True):
        assert df == sum(k in X.terms_of(pa.array([r[1] or ""]))[1].tolist() for r in rows)
    assert where is None or model.df[where] > 0
    assert {i % 4 for i in model.ids} <= {1, 2, 3}


def test_odd_rows(spark):
    rows = corpus() + [(400 + i, "vilest scum and wretch " * 5, 1) for i in range(8)]
    docs, model = model_of(spark, rows)
    assert len(model.ids) < 308  # near copies count once
    odd = [(1, None), (2, ""), (3, "..."), (None, "vile scum wretch vile scum wretch"), (5, "vile scum wretch vile scum wretch"), (5, "vile scum wretch vile scum wretch"), (6, "word1 word2 " * 20000), (7, "Vile SCUM, wretch! vile; scum? wretch")]
    frame = spark.createDataFrame([(*r, "a", [1]) for r in odd], "doc_id bigint, text string, score string, evidence array<int>")
    out = X.score(frame, model)
    assert out.columns == ["doc_id", "text", "score", "predicted", "evidence"]
    got = out.collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.text, set()).add((r.score, r.predicted))
    assert all(len(v) == 1 for v in by.values())
    assert by[odd[4][1]] == by[odd[7][1]] and next(iter(by[odd[4][1]]))[1] == 1
    assert next(iter(by[odd[6][1]]))[1] == next(iter(by[None]))[1] == 0
    assert X.score(frame.limit(0), model).count() == 0
    none = X.learn(docs.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"), F.lit(True))
    assert {r.score for r in X.score(frame, none).collect()} == {0.0}
    _, clean = model_of(spark, [r for r in rows if r[2] == 0])
    assert {r.predicted for r in X.score(frame, clean).collect()} == {0}


def test_sample_is_bounded_by_whole_texts(spark):
    rows = corpus()
    _, model = model_of(spark, rows, examples=20, example_bytes=3000)
    texts = {r[0]: r[1] for r in rows}
    assert len(model.ids) <= 40 and sum(len(t.encode()) for t in model.texts) <= 3000 and all(texts[i] == t for i, t in zip(model.ids, model.texts, strict=True))


def test_held_out_rows_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    out = Q.op12_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hit, all_bad = sum(r.toxic and r.predicted for r in out), sum(r.toxic for r in out)
    assert hit / all_bad > 0.85 and sum(r.predicted and not r.toxic for r in out) <= 3
    assert not math.isnan(sum(r.score for r in out))
