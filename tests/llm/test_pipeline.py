from __future__ import annotations

from test_texts import classes_by_hand, cut_by_hand

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    base = " ".join(f"the word{i} of" for i in range(60))
    passage = " ".join(f"passage{i}" for i in range(60))
    other = " ".join(f"other{i} text" for i in range(30))
    rows = [(1, base, "en"), (2, base + " end", "en"), (3, " ".join(f"alone{i}" for i in range(60)) + f" {passage}", "en"), (4, f"{other} {passage} and more", "en"), (5, "123", "en"), (6, None, "en"), (7, "la mer est belle", "fr")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    named = P.identify_language(spark, docs, str(tmp_path))
    assert {r.doc_id for r in named.collect()} == {1, 2, 3, 4, 7} and named.columns == docs.columns
    one = P.drop_near_copies(spark, named, str(tmp_path))
    assert {r.doc_id for r in one.collect()} == {1, 3, 4, 7} and one.columns == docs.columns
    cut = P.cut_repeats(spark, one, str(tmp_path))
    texts = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert texts[4] == (f"{other} and more", len(other) + 9) and texts[3][0] == rows[2][1] and cut.columns == docs.columns
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == {1, 3, 4, 7}


def test_near_copies_weigh_by_exact_counts(spark):
    """Two texts that only a passage makes alike, which a fourteenth of all texts have, both stay."""
    words = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    passage = words("shared", 80)
    texts = [f"{passage} {words(f'own{n}', 6 if n < 2 else 60)}" for n in range(30)] + [words(f"alone{n}", 10) for n in range(400)]
    copy = words("copy", 150)
    rows = [*enumerate(texts), (900, copy), (901, copy + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()} == {*range(430), 900}


def test_nothing_learned_rejects_no_text(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "la mer", None), (3, "123", None), (4, None, None)], "doc_id bigint, text string, lang string")
    out = P.identify_language(spark, docs, "")
    assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(1, None), (2, None)] and out.columns == docs.columns


def test_run_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = sorted((r.doc_id, r.text) for r in docs if r.text and any(c.isalpha() for c in r.text))
    named, _ = classes_by_hand(rows)
    rows = [r for i, r in enumerate(rows) if named[i][0] == r[0]]
    words = [(d, t.encode().split()) for d, t in rows]
    kept = {d: (t if not any(gone) else b" ".join(w for w, g in zip(ws, gone, strict=True) if not g).decode()) for (d, gone), (_, ws), (_, t) in zip(cut_by_hand(words, 20), words, rows, strict=True)}
    import numpy as np
    import public_tokenizers

    from knotweave.llm.tokens import WordIds

    tokenizer = WordIds(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept.items()}
    got: dict[int, int] = {}
    fill: dict[int, int] = {}
    for r in P.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert got == want and max(fill.values()) <= 2048
    from knotweave.llm.packing import lower_bound

    pieces = np.array([n for d in want for n in ([2048] * (want[d] // 2048) + ([want[d] % 2048] if want[d] % 2048 else []))])
    assert len(fill) <= lower_bound(pieces, 2048) + 1


def test_stage_list():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "substring_dedup", "packing"] and P.ORACLE_SQL is None


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Null ids, repeated rows, repeated ids, null and empty texts, a very long text, and an empty table."""
    text = lambda name, n=60: " ".join(f"{name}{i} the" for i in range(n))
    rows = [(None, text("a")), (None, text("a")), (1, text("b")), (1, text("b")), (1, text("c")), (2, text("c")), (None, text("d") + " " + text("b")), (3, None), (None, None), (4, ""), (5, text("long", 30000)), (6, "12 34")]
    docs = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    out = P.run(spark, f"{tmp_path}/a").collect()
    assert sorted(r.doc_id or 0 for r in out if r.piece == 0) == [0, 0, 1, 1, 5]
    whole = {}
    for r in out:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in whole.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert P.run(spark, f"{tmp_path}/b").count() == 0
