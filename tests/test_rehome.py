"""Candidates of orphaned notes: as by all pairs, and without making them."""

from __future__ import annotations

import random
import re
import time

import pytest

from knotweave.operators import learnings

SYMBOL = "symbol_ref string, symbol_was array<string>, name string, file string, signature string"
NOTE = "relpath string, symbol_ref string, file string, signature string"


def by_hand(notes, symbols, top):
    out = []
    words = lambda s: set(re.findall("[A-Za-z_][A-Za-z0-9_]*", s or ""))
    for rel, bound, file, sig in notes:
        fits = []
        for ref, was, name, f, other in symbols:
            if bound in (ref, *was):
                continue
            a, b = words(sig), words(other)
            score = 3.0 * (name == bound.split("#")[1]) + 2.0 * (bool(f) and f == file) + (2.0 * (len(a & b) / len(a | b)) if a and b else 0.0)
            if score > 0:
                fits.append((-score, ref))
        out += [(rel, ref, round(-score, 2), n + 1) for n, (score, ref) in enumerate(sorted(fits)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("hot", "top"), [(100, 6), (3, 6), (3, 1), (0, 4)])
def test_as_all_pairs(spark, monkeypatch, hot, top):
    monkeypatch.setattr(learnings, "HOT", hot)
    dice = random.Random(hot + top)
    some = lambda n: " ".join(["def", *(dice.choice("abcdefgh") for _ in range(n))]) if n else None
    symbols = [(f"f{i % 5}.py#s{i:02}", [f"old{i % 9}.py#x"], dice.choice(["run", "load", f"only{i}"]), dice.choice(["f0.py", "f1.py", "", None]), some(i % 6)) for i in range(70)]
    notes = [(f"{i:02}.md", dice.choice(["gone.py#run", "gone.py#none", f"gone.py#only{i}", "old3.py#x", "f1.py#s01"]), dice.choice(["f0.py", "f1.py", "f9.py", ""]), some(i % 5)) for i in range(40)]
    got = learnings.candidates(spark.createDataFrame(notes, NOTE), spark.createDataFrame(symbols, SYMBOL), top).collect()
    assert sorted(map(tuple, got)) == by_hand(notes, symbols, top)


def test_words_of_all_signatures_make_no_pairs(spark):
    n = 12_000
    symbols = spark.range(n).selectExpr("concat('src.py#f', id) symbol_ref", "array('') symbol_was", "concat('f', id) name", "'src.py' file", "concat('def f', id, '(self, depth)') signature")
    notes = spark.range(n).selectExpr("concat(id, '.md') relpath", "concat('gone.py#', if(id % 2 = 0, 'f', 'g'), id) symbol_ref", "'src.py' file", "concat('def f', id, '(self, depth)') signature")
    began = time.time()
    assert learnings.candidates(notes, symbols, 1).where("rank = 1").count() == n
    assert time.time() - began < 90  # all pairs took longer
