from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from knotweave.llm import packing
from knotweave.llm import queries as Q
from knotweave.llm.tokens import WordIds

PATH = P.path("word_bpe_49k.json")
ODD = ["", "İstanbul ΑΣ ΟΔΟΣ Σ", "a\x1cb\x1f c\x85d e", "ﬁ ﬃ Ⅷ ² ½ ٣٤", "日本語テキスト 🎉🎉 é e\u0301", "<|endoftext|> hi <|startoftext|>", "don't WE'LL I'D'VE 's'", "a" * 3000 + " " * 500 + "b" * 77, "​‍ x", "ǅ ß ŉ", " \n\n  x  \t\r\n y ", "abc" * 600 + "!" * 900, ":\U0003d000", "a\u0558: \ua7ce1"]


@pytest.fixture(scope="module")
def words():
    return WordIds(PATH)


def whole(tokenizer: Tokenizer, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_encode_like_the_tokenizer(words):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdeèéXYZ '.,!0123\n\t ßñΣσς日\u0301 ") for _ in range(150)) for _ in range(200)]
    assert words.by_word and words.encode(texts) == whole(words.tokenizer, texts)
    assert words.encode([None]) == [b""]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from knotweave.llm.common import worker_cache

    encoder = worker_cache("test_words", lambda: WordIds(PATH))
    assert encoder.encode([text]) == whole(encoder.tokenizer, [text])


def best_bins(sizes, capacity):
    """Fewest bins, by trying all placements."""
    best = [len(sizes)]

    def place(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(gaps)
            return
        for j, g in enumerate(gaps):
            if g >= sizes[i]:
                place(i + 1, [*gaps[:j], g - sizes[i], *gaps[j + 1 :]])
        place(i + 1, [*gaps, capacity - sizes[i]])

    place(0, [])
    return best[0]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_bound_and_packing_enclose_the_optimum(sizes):
    lengths = np.array(sizes)
    where, offset, gaps = packing.best_fit_decreasing(lengths, 20)
    assert packing.lower_bound(lengths, 20) <= best_bins(sorted(sizes, reverse=True), 20) <= len(gaps)
    for b in range(len(gaps)):
        inside = sorted(zip(offset[where == b], lengths[where == b], strict=True))
        at = 0
        for o, n in inside:
            assert o == at
            at += n
        assert at + gaps[b] == 20 and at <= 20


def test_pack_documents(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "x"]) for _ in range(rng.choice([1, 5, 30, 90, 400]))) for _ in range(400)] + ["", None, "same", "same"]
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, offset string")
    out = packing.pack(packing.token_pieces(docs, PATH, 100, with_ids=True), 100, part_pieces=64)
    pieces = out.collect()
    ids = {d: np.frombuffer(x, "<u4").tolist() + [0] for d, x in zip([r[0] for r in rows], whole(WordIds(PATH).tokenizer, [t or "" for t in texts]), strict=True)}
    by_doc, bins = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        bins.setdefault(p.sequence_id, []).append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    assert {d: [x for p in sorted(ps, key=lambda p: p.piece) for x in np.frombuffer(p.ids, "<u4").tolist()] for d, ps in by_doc.items()} == ids
    for ps in by_doc.values():
        ps.sort(key=lambda p: p.piece)
        assert [p.start for p in ps] == [100 * i for i in range(len(ps))] and all(p.length == 100 for p in ps[:-1])
    for ps in bins.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 100
    total = sum(p.length for p in pieces)
    assert len(bins) <= packing.lower_bound(np.array([p.length for p in pieces]), 100) + 1
    joined = packing.sequences(out)
    assert sum(len(r.ids) for r in joined.collect()) == 4 * total


def test_pack_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(docs, PATH).count() == 0


def rounds(monkeypatch):
    seen, real = [], packing._round

    def counted(rest, capacity, parts, *more):
        seen.append(parts)
        return real(rest, capacity, parts, *more)

    monkeypatch.setattr(packing, "_round", counted)
    return seen


def bins_of(out):
    fill = {}
    for r in out.collect():
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    return fill


@pytest.mark.parametrize(("low", "high"), [(1100, 1100), (1030, 1499)])
def test_certified_packings_end_in_the_first_round(spark, monkeypatch, low, high):
    seen = rounds(monkeypatch)
    pieces = spark.range(40000).select((F.col("id") % (high - low + 1) + low).alias("length"), F.col("id").alias("part"), F.lit(1).alias("open"))
    out = packing.pack(pieces, 2048)
    assert seen == [10] and out.where("certified").count() == 40000 and out.columns == ["length", "part", "open", "sequence_id", "offset", "certified"]
    assert len(bins_of(out)) == 40000


def test_rounds_reach_few_sequences_without_large_partitions(spark, monkeypatch):
    seen = rounds(monkeypatch)
    rng = random.Random(8)
    lengths = [rng.choice([rng.randrange(1, 300), rng.randrange(600, 1400), 2048]) for _ in range(6000)]
    out = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length int"), 2048, part_pieces=100)
    fill = bins_of(out)
    least = packing.lower_bound(np.array(lengths), 2048)
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(lengths) and len(fill) <= least * 1.01 + 2
    assert seen == sorted(seen, reverse=True) and len(seen) <= packing.ROUNDS


def test_op1_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma42", "don't", "ß"]) for _ in range(rng.choice([0, 3, 700, 2500])))) for i in range(60)] + [(100, None), (None, "x y"), (100, "again")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for (d, _), ids in zip(rows, whole(WordIds(PATH).tokenizer, [t or "" for _, t in rows]), strict=True):
        own = np.append(np.frombuffer(ids, "<u4"), 0).astype("<u4")
        want += [(d or -1, n, 2048 * n, len(x), zlib.crc32(x.tobytes())) for n, x in enumerate(np.split(own, range(2048, len(own), 2048)))]
    got = Q.op1_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, at, n), (t, after, _) in zip(places, places[1:], strict=False):
        assert after == (at + n if s == t else 0) and at + n <= 2048
    assert len({r.sequence_id for r in got}) <= packing.lower_bound(np.array([w[3] for w in want]), 2048) + 1
