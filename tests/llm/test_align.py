from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from knotweave import storage
from knotweave.llm import align
from knotweave.llm import queries as Q

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_hand(rows):
    """Rows of the contract from whole-text encodings and all pairs of tokens."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letters = {c: b for b, c in align.byte_letters().items()}
    told, docs_of = [], Counter()
    for doc, text in rows:
        a, b = [], []
        if text:
            a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
            for i in two.encode(text):
                piece = two.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if two.is_byte(i) else piece.replace("▁", " ").encode()))
            if not b"".join(s for _, s in a) == b"".join(s for _, s in b) == (" " + text).encode():
                a, b = [], []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, s in side:
                own.append((at, at + len(s), i))
                at += len(s)
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for s, e, i in side if begin <= s and e <= end) for side in spans))
            begin = end
        links, low = [], 0
        for s, e, i in spans[0]:
            while low < len(b) and spans[1][low][1] <= s:
                low += 1
            links += [(i, j) for t, u, j in spans[1][low : low + 2000] if t < e and s < u]
        docs_of.update(set(links))
        told.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (i, _), n in docs_of.items():
        best[i] = max(best.get(i, 0), n)
    return sorted(((doc, na, nb, ng, len(ls), sum(docs_of[x] == best[x[0]] for x in ls), sum(docs_of[x] for x in ls), sha) for doc, na, nb, ng, ls, sha in told), key=repr)


def run(spark, rows):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, rid string, pair int")
    out = align.align_tokens(frame, A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


ODD = ["Hello  world\n x", "", None, " ", "   \n\n  ", "a\tb  ", "naïve café — ‘quoted’ 1234567 don't", "日本語のテキスト", "emoji 👩‍👩‍👧 here", "has ▁ mark", "<|endoftext|> <s> <0x0A> </s>", "x" * 3000, "ab" * 700 + " tail", "　wide space line", "\x00zero", "é", "word " * 900, "line one\nline two\r\nthree", "Ünïcödé ßtraße ЖЖ ملف"]


@pytest.mark.parametrize("block, rows", [(4096, 500_000), (3, 10)])
def test_odd_texts_match_brute_force(spark, monkeypatch, block, rows):
    monkeypatch.setattr(align, "BLOCK_EVENTS", block)
    monkeypatch.setattr(storage, "SMALL_ROWS", rows)
    texts = [(n, t) for n, t in enumerate(ODD)] + [(1, "Hello  world\n x"), (None, "Hello world"), (None, "Hello world"), (5, "other text"), (None, None)]
    assert run(spark, texts) == by_hand(texts)
    assert run(spark, []) == []


def test_state_is_what_neither_side_has_closed():
    sweep = align.Sweep()
    one, two = [5, 6, 7, 8] * 500, [9, 10] * 500
    for a in range(0, 2000, 40):
        sweep.take(0, align.np.array(one[a : a + 40]), align.np.array([2, 1, 2, 1] * 10))
        sweep.take(1, align.np.array(two[a // 2 : a // 2 + 20]), align.np.array([3, 3] * 10))
        assert max(len(x) for x in sweep.ids) == 0 and len(sweep.pairs) <= 9
    n_a, n_b, groups, links, sha, pair, times = sweep.row()
    assert (n_a, n_b, groups, links) == (2000, 1000, 1000, 2000) and times.tolist() == [500] * 4
    assert sha == hashlib.sha256(";".join(["5,6|9", "7,8|10"] * 500).encode()).hexdigest()


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in Q.op13_token_alignment(spark, sf).collect()), key=repr) == by_hand(rows)
