from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from oracle import expected
from oracle import rows as shown

from knotweave.llm import codes
from knotweave.llm import queries as Q

SF = "/root/testdata/sf0.01"


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, label, code, error, label_error, sha) of every usable row, by plain loops."""
    kept = [(k, lab, [math.floor(256 * x) for x in v]) for k, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    told = []
    for dim in {len(v) for *_, v in kept}:
        mine = [(k, lab, v + [0] * (-dim % parts)) for k, lab, v in kept if len(v) == dim]
        size = -(-dim // parts)
        first = {}
        for k, _, v in sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i2").tobytes())):
            first.setdefault(k, v)
        book = [[v[p * size : (p + 1) * size] for v in list(first.values())[:entries]] for p in range(parts)]
        nearest = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], c, strict=True)), i) for i, c in enumerate(book[p]))
        for _ in range(rounds):
            own = [[nearest(v, p)[1] for p in range(parts)] for *_, v in mine]
            for p in range(parts):
                for e in range(len(book[p])):
                    held = [v[p * size : (p + 1) * size] for (*_, v), o in zip(mine, own, strict=True) if o[p] == e]
                    if held:
                        book[p][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        sha = hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()
        for k, lab, v in mine:
            best = [nearest(v, p) for p in range(parts)]
            told.append((k, lab, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), sha))
    by = {}
    for _, lab, _, error, _ in told:
        by[lab] = by.get(lab, 0) + error
    return sorted(((k, lab, code, error, by[lab], sha) for k, lab, code, error, sha in told), key=repr)


def run(spark, rows, schema="vec_id bigint, label int, embedding array<double>, code string", **more):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], schema)
    out = codes.vector_codes(frame, "embedding", "vec_id", codes.F.col("label"), **more)
    assert out.columns == ["key", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_odd_rows_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(180, 32)).round(1))]
    rows += [(7, 1, rows[7][2]), (7, 2, rows[9][2]), (200, None, rows[3][2]), (None, None, rows[4][2]), (None, 3, rows[5][2])]
    rows += [(201, 1, None), (202, 1, [math.nan] * 32), (203, 1, [math.inf] + [0.0] * 31), (204, 1, [None] + [1.0] * 31), (205, 9, []), (206, 9, [1.5, -0.25]), (207, 9, [0.0, -0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, entries=3, rounds=4) == brute(rows, entries=3, rounds=4)
    assert run(spark, [r for r in rows if r[0] == 201]) == [] == run(spark, [])


def test_large_components_are_exact(spark):
    rows = [(i, 0, [1e9 + 10.0 * x for x in range(i, i + 16)]) for i in range(0, 300, 3)]
    want = {r[0]: r[2:4] for r in brute_wide(rows)}
    assert {r[0]: r[2:4] for r in run(spark, rows)} == want
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(0, 0, [1e15] * 16), (1, 0, [-1e15] * 16)] * 2, entries=1)


def brute_wide(rows):
    """As brute, for rows with one vector a key."""
    kept = [(k, lab, [math.floor(256 * x) for x in v]) for k, lab, v in rows]
    book = [[[v[p]] for _, _, v in kept[:64]] for p in range(16)]
    near = lambda v, p: min(((v[p] - c[0]) ** 2, i) for i, c in enumerate(book[p]))
    for _ in range(2):
        own = [[near(v, p)[1] for p in range(16)] for *_, v in kept]
        for p in range(16):
            for e in range(len(book[p])):
                held = [v[p] for (*_, v), o in zip(kept, own, strict=True) if o[p] == e]
                if held:
                    book[p][e] = [sum(held) // len(held)]
    for k, lab, v in kept:
        best = [near(v, p) for p in range(16)]
        yield k, lab, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best)


def test_bounds_spare_scans_and_keep_ties():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (4000, 4, 3))
    book = codes.Book(np.ascontiguousarray(x[:32].transpose(1, 0, 2)))
    state = codes.State.unknown(len(x), 4)
    assert codes.assign(x, book, state) == 16000
    scans = []
    for _ in range(12):
        after = book.entries.copy()
        for p in range(4):
            for e in range(32):
                held = x[state.code[:, p] == e, p]
                if len(held):
                    after[p, e] = held.sum(0) // len(held)
        moved = codes._roots(((after - book.entries) ** 2).sum(2), True)
        book = codes.Book(after, moved)
        scans.append(codes.assign(x, book, state))
        for p in range(4):
            d = ((x[:, p, None] - book.entries[p][None]) ** 2).sum(2)
            assert (d.argmin(1) == state.code[:, p]).all()  # argmin takes the first of equals
            assert (np.sqrt(d.min(1)) <= state.upper[:, p]).all()
            d[np.arange(len(d)), state.code[:, p]] = d.max() + 1
            assert (np.sqrt(d.min(1)) >= state.lower[:, p]).all()
    assert scans[0] < 16000 and scans[-1] < scans[0] / 2
    assert codes.assign(x, codes.Book(book.entries, np.zeros((4, 32))), state) < 1000  # only what lies between two


def test_query_matches_its_sql(spark):
    found = Q.QUERIES["op11_vector_codes"](spark, SF).toPandas()
    assert shown(found) == shown(expected(Q.ORACLE_SQL["op11_vector_codes"], SF))
