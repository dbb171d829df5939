"""Columns of a caller that have the names operators use inside come back as they were."""

from __future__ import annotations

from knotweave.llm import langid, neardup, substrings, toxicity

NAMES = "row doc places all own0 own1 letter __letter __doc __digest digest first n h w size id bad place rid pair key label k1 repeated".split()


def frame(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (2, text + " and more"), (3, "short"), (4, None), (None, text)]
    columns = ", ".join(["doc_id bigint", "text string", *(f"`{n}` string" for n in NAMES)])
    return spark.createDataFrame([(*r, *(f"{n}-{r[0]}" for n in NAMES)) for r in rows], columns)


def own(rows):
    return sorted(tuple(r[n] for n in NAMES) for r in rows.collect())


def test_columns_stay(spark):
    docs = frame(spark)
    want = own(docs)
    cut = substrings.remove_repeats(docs, 20)
    assert own(cut) == want and cut.columns == [*docs.columns, "n_words", "n_removed"]
    named = langid.identify(docs, {"en": b"word short"})
    assert own(named) == want and named.columns == [*docs.columns, "lang_pred", "score"]
    model = toxicity.Model([], [], [], (0.0, 0.0), [], [], 0)
    assert own(toxicity.score(docs, model)) == want
    kept = neardup.keep_one(docs, neardup.near_duplicates(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4}
    assert own(kept) == [w for w in want if w[0] in ("row-1", "row-3", "row-4")]
