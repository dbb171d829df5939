from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from knotweave.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(2)
    odd = ["", "İstanbul Σ", "a\x1cb\x1f c\x85d e", "ﬁ Ⅷ ² ½ ٣٤", "日本語 🎉 e\u0301", "<|endoftext|>", "don't WE'LL", "a" * 3000 + " " * 500 + "b" * 77, " \n\n  x  \t\r\n y ", "abc" * 400 + "!" * 900]
    return odd + ["".join(rng.choice("abcdeèéXYZ '.,!0123\n\t ßñΣσ日\u0301 ") for _ in range(200)) for _ in range(200)]


def test_encodes_like_the_library(ranks, library):
    encoder = bpe.RankedMerges(ranks, P.PATTERN)
    found = encoder.encode(texts())
    assert found == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts()]
    assert [encoder.decode(x) for x in found] == [t.encode() for t in texts()]
    assert encoder.encode([None]) == [b""]
    assert encoder.fold_long(b"hello world" * 9) == encoder.fold([b"hello world" * 9])[0]


def test_other_vocabulary_and_pattern():
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    pattern = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\s+"
    library = tiktoken.Encoding("multi", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.RankedMerges(ranks, pattern)
    assert encoder.encode(texts()) == [np.array(library.encode_ordinary(t), "<u4").tobytes() for t in texts()]


def test_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([*texts()[:8], None])] + [(None, "null id", "x"), (0, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    out = bpe.round_trip_digests(docs, PATH, P.PATTERN).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    encoded = bpe.encode_texts(docs.where("doc_id = 4"), PATH, P.PATTERN)
    assert encoded.select(bpe.decode_ids(encoded.ids, PATH, P.PATTERN).alias("d")).first().d == texts()[4].encode()
    assert bpe.round_trip_digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_native_fold(spark, ranks):
    words = [" the", "hello", "Ünïcode", "abcabcabc", "x", " antidisestablishment", "日本"]
    encoder = bpe.RankedMerges(ranks, P.PATTERN)
    rows = bpe.fold_words_native(spark.createDataFrame([(w,) for w in words], "w string"), "w", ranks).collect()
    assert {r.w: np.array(r.ids, "<u4").tobytes() for r in rows} == dict(zip(words, encoder.fold([w.encode() for w in words]), strict=True))
