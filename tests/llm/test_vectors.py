from __future__ import annotations

import math

import numpy as np
import pytest

from knotweave.llm import ann, vafile
from knotweave.llm import queries as Q

SF = "/root/testdata/sf0.01"


def odd_vectors(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(3).normal(size=(300, 8)))]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (2000, None), (2001, [0.0] * 8), (2002, [math.nan] * 8), (2003, [math.inf] + [0.0] * 7), (None, [1.0] * 8), (2004, [None] + [1.0] * 7), (2005, []), (3000, [1.0, 2.0]), (3020, [2.0, 1.0]), (2006, [1e300] * 8), (2007, [1e-300] * 8)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, score string"), rows


def usable(v, zero=True):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def test_neighbours_of_odd_vectors(spark):
    frame, rows = odd_vectors(spark)
    good = ann.usable_vectors(frame, "embedding", "vec_id")
    out = ann.nearest(good, good.where("key % 20 = 0"), 5).collect()
    table = {k: np.array(v) for k, v in rows if k is not None and usable(v, False)}
    assert {r.query_id for r in out} == {k for k in table if k % 20 == 0}
    hits = total = 0
    for q in {r.query_id for r in out}:
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert all(r.vec_id != q and len(table[r.vec_id]) == len(table[q]) for r in mine)
        unit = lambda v: v / abs(v).max() / math.sqrt(((v / abs(v).max()) ** 2).sum())
        want = sorted(((-round(float(unit(table[q]) @ unit(v)), 9), k) for k, v in table.items() if k != q and len(v) == len(table[q])))[:5]
        total += len(want)
        hits += len({k for _, k in want} & {r.vec_id for r in mine})
        assert [(-round(r.score, 9), r.vec_id) for r in mine if abs(r.score) < 2] == sorted((-round(r.score, 9), r.vec_id) for r in mine)
    assert hits / total >= 0.9
    assert ann.nearest(good.limit(0), good.limit(0), 5).count() == 0


def test_few_candidates_are_all_found(spark):
    rows, many = [], {}
    for count in range(2, 7):
        for n, dim in enumerate(range(8 * count, 8 * count + 7)):  # each length is a table of its own
            for i in range(count):  # opposed pairs, orthogonal to one another
                rows.append((1000 * count + 10 * n + i, [(-1.0 if i % 2 else 1.0) * (j == i // 2) for j in range(dim)]))
                many[rows[-1][0]] = count - 1
    good = ann.usable_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "embedding", "vec_id")
    out = {}
    for r in ann.nearest(good, good, 5).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    of = dict(rows)
    want = {}
    for q in of:
        near = sorted((-sum(a * b for a, b in zip(of[q], of[v], strict=True)), v) for v in of if v != q and len(of[v]) == len(of[q]))
        want[q] = [(n, v) for n, (_, v) in enumerate(near, 1)]
    assert {q: len(x) for q, x in want.items()} == many
    assert {q: sorted(x) for q, x in out.items()} == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", SF, "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    out = Q.op7_multiprobe_neighbours(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v = np.array(table.embedding.tolist(), np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    at = np.flatnonzero(table.vec_id % 50 == 0)
    score = v[at] @ v.T
    score[np.arange(len(at)), at] = -2
    ids = table.vec_id.to_numpy()
    found = out.groupby("query_id").vec_id.agg(set).to_dict()
    hits = sum(len(found[ids[q]] & set(ids[np.argsort(-score[n])[:5]])) for n, q in enumerate(at))
    assert hits / (5 * len(at)) >= 0.9
    exact = {(ids[q], ids[j]): score[n, j] for n, q in enumerate(at) for j in range(len(ids))}
    assert all(abs(exact[r.query_id, r.vec_id] - r.score) < 1e-12 for r in out.itertuples())


def best_by_hand(table, k):
    """{query: [(rank, key, score)]} of rows (key, integers): repeated rows once."""
    table = list({(key, tuple(v)) for key, v in table})
    out = {}
    for q in {key for key, _ in table if key % 20 == 0}:
        pairs = [(-sum(a * b for a, b in zip(v, w, strict=True)), key) for mine, v in table if mine == q for key, w in table if key != q and len(w) == len(v)]
        if pairs:
            out[q] = [(n, key, -s) for n, (s, key) in enumerate(sorted(pairs)[:k], 1)]
    return out


def found(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_exact_top_k_of_odd_vectors(spark):
    frame, rows = odd_vectors(spark)
    more = [(4000, [3e6] + [0.5] * 7), (4001, [-1e15] + [0.0] * 7), (4020, [2.0**20] + [1.0] * 7), (4040, []), (4041, []), (4060, [0.0] * 8), *[(20 * n, rows[0][1]) for n in (0, 0, 250)], (40, [1.0] * 8)]
    frame = frame.where("vec_id is null or vec_id <> 2006").union(spark.createDataFrame([(*r, "clash") for r in more], frame.schema))
    rows = [r for r in rows if r[0] != 2006] + more
    ints = vafile.integer_vectors(frame, "embedding", 64, "vec_id")
    out = vafile.top_inner_products(ints, ints.where("key % 20 = 0"), 20, block_rows=64, block_queries=4)
    table = [(k, [math.floor(64 * x) for x in v]) for k, v in rows if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert found(out.collect()) == best_by_hand(table, 20)
    assert vafile.top_inner_products(ints.limit(0), ints.limit(0), 20).count() == 0


def test_scores_beyond_a_long_are_errors(spark):
    ints = vafile.integer_vectors(spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id int, embedding array<double>"), "embedding", 64, "vec_id")
    with pytest.raises(Exception, match="beyond 64 bits"):
        vafile.top_inner_products(ints, ints.where("key = 0"), 1).collect()
    assert [r.vec_id for r in vafile.top_inner_products(ints.where("key <> 1"), ints.where("key = 0").limit(0), 1).collect()] == []


def test_wide_cells_are_read_again(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 6)) * np.array([1e6, 1e3, 1, 50, 1e5, 10]))]
    ints = vafile.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "embedding", 64, "vec_id")
    out = vafile.top_inner_products(ints, ints.where("key % 20 = 0"), 7, block_rows=90, block_queries=6)
    assert found(out.collect()) == best_by_hand([(k, [math.floor(64 * x) for x in v]) for k, v in rows], 7)


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(101 + i // 2, [0.9, 0.1, 0.0, 0.0]) for i in range(16)] + [(501 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(10, 4)))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good = ann.usable_vectors(frame, "embedding", "vec_id")
    out = ann.nearest(good, good.where("key = 0"), 5).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in out] == [(n + 1, 101 + n) for n in range(5)]
    one = spark.createDataFrame([(0, [1.0, 0.0]), *[(7, [0.9, 0.1])] * 8, *[(10 + i, [0.5, 0.1 * i]) for i in range(10)]], "vec_id bigint, embedding array<double>")
    good = ann.usable_vectors(one, "embedding", "vec_id")
    assert len({r.vec_id for r in ann.nearest(good, good.where("key = 0"), 5).collect()}) == 5
    ints = vafile.integer_vectors(frame, "embedding", 64, "vec_id")
    assert found(vafile.top_inner_products(ints, ints.where("key = 0"), 20).collect()) == best_by_hand([(k, [math.floor(64 * x) for x in v]) for k, v in rows], 20)


def test_hashes_grow_with_the_rows():
    rng = np.random.default_rng(7)
    sample = [(32, v) for v in rng.normal(size=(8, 32))]
    counts = [ann._hashes(n, sample, 4, 2.0, 1, 0.8, 0.5) for n in (100, 10**6, 10**9)]
    assert counts[0] == ann.LEAST_HASHES and counts == sorted(counts) and counts[-1] > 10
    made = ann.Tables(32, 4, 9, 2.0, 1)
    query = rng.normal(size=32)
    unit = query / np.linalg.norm(query)
    other = rng.normal(size=(4000, 32))
    other -= np.outer(other @ unit, unit)
    near = 0.7 * unit + math.sqrt(1 - 0.49) * other / np.linalg.norm(other, axis=1, keepdims=True)
    inside = np.isin(made.buckets(near, 2), made.probes(unit, 2, 0.7, 0.6)).mean()
    assert 0.55 < inside < 0.72


def test_recall_of_loose_queries_among_clusters(spark):
    rng = np.random.default_rng(7)
    n = 12000
    x = np.repeat(rng.normal(size=(n // 8, 64)) / 8, 8, 0) + 0.06 * rng.normal(size=(n, 64))
    loose = rng.random(n) < 0.23
    x[loose] = rng.normal(size=(int(loose.sum()), 64))
    good = ann.usable_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>"), "embedding", "vec_id")
    found: dict[int, set] = {}
    for r in ann.nearest(good, good.where("key % 50 = 0"), 5).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    units, hit = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for q in range(0, n, 50):
        score = units @ units[q]
        score[q] = -2
        hit[q] = len(found[q] & set(np.argsort(-score)[:5].tolist())) / 5
    assert np.mean(list(hit.values())) >= 0.9 and np.mean([h for q, h in hit.items() if loose[q]]) >= 0.9
