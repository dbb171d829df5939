from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from knotweave.functions import symbols as S
from knotweave.functions import text as T
from knotweave.functions import vectors as V
from knotweave.operators import planning


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(x):
    return F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


def test_tokens(spark):
    assert one(spark, T.tokenize(F.lit("Café_1 x-Y"))) == ["caf", "_1", "x", "y"]
    assert one(spark, T.tokenize(F.lit(None).cast("string"))) == []
    assert {"mcp", "restart", "server"} <= set(one(spark, T.subtokens(F.lit("MCPRestartServer"))))
    assert {"index", "file"} <= set(one(spark, T.subtokens(F.lit("index_file"))))
    assert one(spark, T.subtokens(F.lit("server"))) == []


def test_name_terms(spark):
    assert one(spark, T.name_terms(F.lit("BM25"), F.lit("crate.retrieve.BM25"))) == sorted({"BM25", "crate.retrieve.BM25", "bm", "25", "crate", "retrieve"})


def test_hashes_end_with_nul(spark):
    want = hashlib.sha1(b"Gaskets\n\nSeals under pressure.\x00").hexdigest()
    assert one(spark, T.content_hash(lit(["Gaskets"]), F.lit("Seals under pressure."))) == want == "f62cfbbf8b7bc6b674361cb0861a3c3b4ec4639d"
    assert one(spark, T.content_hash(lit(["Widgets"]), F.lit("The frobnicator calibrates gaskets."))) == "eef4ad16e494f6224a59b9f78053c6b137901cb9"


def test_hash_embedding(spark):
    words = ["alpha", "beta", "alpha"]
    v = [0.0] * 256
    for w in words:
        h = int(hashlib.md5(w.encode()).hexdigest(), 16)
        v[h % 256] += 1.0 if h >> 8 & 1 else -1.0
    n = math.sqrt(sum(x * x for x in v))
    assert one(spark, V.hash_embedding(F.lit("Alpha  beta\nALPHA"))) == pytest.approx([x / n for x in v])
    assert set(one(spark, V.hash_embedding(F.lit("")))) == {0.0}
    with pytest.raises(ValueError):
        V.Embedders().get("model:x")


@pytest.mark.parametrize(
    ("lang", "file", "container", "name", "ref", "fqn"),
    [
        ("python", "src/pkg/mod.py", ["Chunk"], "store", "src/pkg/mod.py#Chunk.store", "pkg.mod.Chunk.store"),
        ("python", "pkg/__init__.py", [], "x", "pkg/__init__.py#x", "pkg.x"),
        ("rust", "rust/src/core/state.rs", ["impl Server<T> for State<U>"], "exit", "rust/src/core/state.rs#State::exit", "core::state::State::exit"),
        ("lua", "lua/health/init.lua", ["M"], "check", "lua/health/init.lua#check", "health.M.check"),
        ("go", "src/store/db.go", [], "Open", "src/store/db.go#Open", "store.Open"),
        ("zsh", "core/omz.zsh", ["_load"], "git.push", "core/omz.zsh#_load.git.push", "core/omz.zsh#_load.git.push"),
        ("ruby", "lib/a.rb", ["A"], "b", "lib/a.rb#A.b", "A.b"),
    ],
)
def test_symbol_names(spark, lang, file, container, name, ref, fqn):
    args = lit(file), lit(container), lit(name), lit(lang)
    assert one(spark, S.symbol_ref(*args)) == ref
    assert one(spark, S.fqn(S.scope_of(args[3], args[0], args[1]), args[2], args[3], args[0], args[1])) == fqn


@pytest.mark.parametrize(
    ("query", "tier"),
    [("execute", "name"), ("check.execute", "suffix"), ("rust::src::cli::commands::check::execute", "exact"), ("check.rs#execute", "ref"), ("other.rs#execute", None), ("#execute", "ref"), ("old.name", "was"), ("xecute", None), ("", None)],
)
def test_match_tier(spark, query, tier):
    canon = S.canonical(F.lit("rust/src/cli/commands/check.rs"), lit([]), F.lit("execute"), F.lit("rust"))
    assert one(spark, S.match_tier(canon, F.lit("execute"), lit(["old.name"]), F.lit(query))) == tier


def test_edges_and_slugs(spark):
    e = one(spark, S.decode_edge(F.lit("helper [dep:src/util.py]"), F.lit("own")))
    assert tuple(e) == ("dep", "helper", "src/util.py", "dep:src/util.py")
    assert tuple(one(spark, S.decode_edge(F.lit("helper"), F.lit("own")))) == ("own", "helper", "", "")
    assert one(spark, S.edge_is_from(F.lit("f [a/b.py]"), F.lit("a/b.py")))
    slug = one(spark, S.ref_slug(F.lit("a/b.py#C.d")))
    assert slug == "a-b.py-C.d-" + hashlib.sha1(b"a/b.py#C.d").hexdigest()[:8]
    assert one(spark, S.ref_slug(F.lit("plain.name"))) == "plain.name"


def test_paths(spark):
    assert one(spark, S.path_matches(F.lit("core/state.rs"), F.lit("state.rs")))
    assert not one(spark, S.path_matches(F.lit("core/state.rs"), F.lit("ate.rs")))
    assert one(spark, T.portable_path(F.lit("/home/a/dev/x/y"), [("HOME", "/home/a"), ("DEV", "/home/a/dev")])) == "$DEV/x/y"
    assert one(spark, T.expand_path(F.lit("$DEV/x"), [("DEV", "/home/a/dev")])) == "/home/a/dev/x"
    assert not one(spark, T.safe_relpath(F.lit("a/../b")))
    assert one(spark, S.group_key("dir", F.lit("a/b/c.py"), lit([]), 1)) == "a"
    assert one(spark, S.group_key("dir", F.lit("c.py"), lit([]))) == "(root)"
    assert one(spark, S.group_key("scope", F.lit("c.py"), lit([]))) == "(no scope)"


def test_languages(spark):
    assert one(spark, T.language_of(F.lit("a/b.py"), F.lit(""))) == "python"
    assert one(spark, T.language_of(F.lit("bin/x"), F.lit("#!/usr/bin/env python3"))) == "python"
    assert one(spark, T.language_of(F.lit("bin/x"), F.lit("#!/bin/zsh -f"))) == "zsh"
    assert one(spark, T.language_of(F.lit("bin/x"), F.lit("plain"))) is None


@pytest.mark.parametrize(("low", "high", "rank"), [(None, None, "m"), ("m", "n", "mm"), ("y", None, "z"), ("z", None, "zm"), (None, "b", "am"), (None, "c", "am"), (None, "d", "b"), ("b", "bb", "bam"), ("cz", "d", "czm")])
def test_rank_between(low, high, rank):
    assert planning.rank_between(low, high) == rank


@pytest.mark.parametrize("side", ["after", "before", "inside"])
def test_ranks_always_fit_in_one_place(side):
    low, high = "f", "g"
    for n in range(60):
        middle = planning.rank_between(low, high)
        assert low < middle < high and middle[-1] != "a"
        low, high = {"after": (middle, high), "before": (low, middle), "inside": (low, middle) if n % 2 else (middle, high)}[side]


def test_ranks_that_can_not_fit():
    for low, high in (("n", "m"), ("m", "ma"), ("k", "k")):
        with pytest.raises(ValueError):
            planning.rank_between(low, high)


def test_spread_ranks():
    many = planning.spread_ranks(40)
    assert many == sorted(set(many)) and len(many) == 40
    assert planning.batch_refs([{}, {"deps": ["#1", "x"]}], ["a", "b"]) == [[], ["a", "x"]]
    with pytest.raises(ValueError):
        planning.batch_refs([{"deps": ["#1"]}], ["a"])
