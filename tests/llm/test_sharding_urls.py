from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from knotweave.llm import sharding, urls
from knotweave.llm import queries as Q
from knotweave.llm.queries import URL_RULES


def jump(key: int, shards: int) -> int:
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([*range(-5, 3000), 2**62, -(2**63)], np.int64)
    for shards in (1, 2, 24, 25):
        assert sharding.jump_hash(keys, shards).tolist() == [jump(int(k), shards) for k in keys]
    a, b = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(b[a != b]) == {24} and 0.02 < (a != b).mean() < 0.06
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_shards(spark):
    rows = [(i, f"text {i}", "clash") for i in range(500)] + [(None, None, "c"), (7, "text 7", "c"), (7, "other", "c"), (8, "", "c")] + [(9, "hot", "c")] * 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, slot string")
    out = sharding.shard_documents(docs, 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for r in out:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25))
    for shard in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(docs.limit(0), 24).count() == 0
    kept = sharding.shard_rows(docs, 3)
    assert set(kept.columns) == {"doc_id", "text", "slot", "shard", "grown_shard"} and kept.count() == len(rows)


def judged(spark, list_of_urls, **options):
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(list_of_urls)], "page_id int, url string, verdict string")
    return [tuple(r) for r in urls.judge_urls(rows, URL_RULES, **options).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]


def test_rules(spark):
    found = judged(spark, ["http://A.NET/x?y", "https://m.example.net/en/25#top", "https://x.example.com/de/1", "http://b.org/fr/", "http://b.org/en/", "http://c.net?q", "nonsense", None, "", "http://notnet/x", "HTTP://É.net/", "a://b://c/d"])
    assert found == [
        ("a.net", "/x", "net/", "block"),
        ("m.example.net", "/en/25", "example.net/en/", "allow"),
        ("x.example.com", "/de/1", "example.com/de/", "block"),
        ("b.org", "/fr/", "org/fr/", "allow"),
        ("b.org", "/en/", None, "allow"),
        ("c.net", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("notnet", "/x", None, "allow"),
        ("É.net", "/", "net/", "block"),
        ("b:", "//c/d", None, "allow"),
    ]


def test_vocabulary(spark):
    verdicts = [v for *_, v in judged(spark, ["http://a.de/porn/1", "http://a.de/pornography", "http://a.de/poker", "http://a.de/poker-casino", "http://a.de/poker?poker", "http://sex.casino.de/", "http://essex.casino.de/", "http://a.de/XXX"])]
    assert verdicts == ["block", "allow", "allow", "block", "allow", "block", "allow", "block"]
    assert judged(spark, ["http://a.de/porn"], strict=(), soft=())[0][3] == "allow"
    assert urls.count_terms("adult-adult sex", urls._automaton(("sex",), ("adult", "sex"))) == (1, 1)


def test_no_urls(spark):
    assert judged(spark, []) == []


def test_keys_of_any_type(spark):
    frame = spark.createDataFrame([(f"k{i % 50}", "x") for i in range(400)] + [(None, "y")], "name string, row string")
    out = sharding.shard_rows(frame, 7, "name").collect()
    assert len(out) == 401 and {r.shard for r in out} <= set(range(7)) and len({r.shard for r in out}) > 4
    assert len({(r.name, r.shard, r.grown_shard) for r in out}) == 51 and all(r.grown_shard in (r.shard, 7) for r in out)
    for shard in range(7):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_op2_by_brute_force(spark, tmp_path):
    import zlib

    rows = [(i * 7919, t) for i, t in enumerate(["", None, "same", "same", "é" * 9, *map(str, range(200))])] + [(None, "same"), (7919, "again")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op2_jump_sharding(spark, str(tmp_path)).collect()

    def jump(key, shards):
        at, new = -1, 0
        while new < shards:
            at = new
            key = (key * 2862933555777941757 + 1) % 2**64
            new = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
        return at

    want = sorted((d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), jump(d or 0, 24), jump(d or 0, 25)) for d, t in rows)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want and {r.law for r in got} == {"key"}
    for shard in range(24):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_vocabulary_of_thousands_of_terms(spark):
    terms = [(f"Term{i}x", "strict" if i % 3 == 0 else "soft") for i in range(6000)] + [(None, "soft"), ("", "strict"), ("odd", "other"), ("Term1x", "soft")]
    strict, soft = urls.vocabulary(spark.createDataFrame(terms, "term string, weight string"))
    assert (len(strict), len(soft)) == (2000, 4000) and strict[0] == "term0x"
    rows = [(0, "http://a.b/term3x"), (1, "http://a.b/term4x"), (2, "http://a.b/TERM4X-term5x"), (3, "http://a.b/term3xx"), (4, None)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id int, url string, hits int")
    out = {r.page_id: (r.verdict, r.strict_hits, r.soft_hits, r.hits) for r in urls.judge_urls(frame, strict=strict, soft=soft).collect()}
    assert out == {0: ("block", 1, 0, 1), 1: ("allow", 0, 1, 1), 2: ("block", 0, 2, 1), 3: ("allow", 0, 0, 1), 4: ("allow", 0, 0, 1)}
