from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from knotweave.llm import langid, licenses, neardup, substrings
from knotweave.llm import queries as Q
from knotweave.llm.common import string_buffers
from knotweave.llm.words import Words

SF = "/root/testdata/sf0.001"


def test_words():
    texts = ["a  b\tcc\n", "", None, "é\u00a0x y", "one", " \x0b\x0c\r z\x1c"]
    words = Words(pa.array(texts))
    assert words.count.tolist() == [len((t or "").encode().split()) for t in texts]
    again = Words(pa.array(["x", "b cc a"]).slice(1))
    at = dict(zip("a b cc".split(), words.hash[:3].tolist(), strict=True))
    assert again.hash.tolist() == [at["b"], at["cc"], at["a"]]
    assert again.runs(np.array([0]), np.array([2]))[0] == words.runs(np.array([1]), np.array([3]))[0]


def cut_by_hand(docs, window):
    """(removed flags by document) of rows (doc_id, words), windows judged on the input."""
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        out.append((d, gone))
    return out


@pytest.mark.parametrize(("window", "start"), [(20, None), (20, 5), (7, 2), (4, 1)])
def test_substrings(spark, window, start):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(55)]
    rows = []
    for d in range(60):
        w = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.choice([0, 3, 30, 120]))]
        if d % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(20) :]
        rows.append((d, w))
    rows += [(100, ["same"] * 90), (101, rows[5][1]), (102, rows[5][1]), (103, ["same"] * 40), (-4, passage)]
    docs = [(d, " ".join(w), "clash", 1) for d, w in rows] + [(200, None, "c", 1), (201, "", "c", 1)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, doc string, n_words int").repartition(5)
    out = {r.doc_id: r for r in substrings.remove_repeats(frame, window, start, rejoin=True).collect()}
    assert len(out) == len(docs) and set(next(iter(out.values())).asDict()) == {"doc_id", "text", "doc", "n_words", "n_removed"}
    for (d, gone), (_, w) in zip(cut_by_hand(rows, window), rows, strict=True):
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (out[d].n_words, out[d].n_removed, out[d].text) == (len(w), sum(gone), " ".join(kept)), d
    assert out[200].text is None and out[200].n_words == 0
    assert substrings.remove_repeats(frame.limit(0), window).count() == 0


def test_repeated_doc_ids_and_null(spark):
    w = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(1, w), (1, w), (None, w)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeats(frame, 20).collect()) == [(0, 0), (1, 30), (1, 30)]


@pytest.mark.parametrize("parts", [1, 4])
def test_rows_of_one_doc_id_lose_their_own_words_only(spark, parts):
    def words(x, n):
        return [f"{x}{i}" for i in range(n)]

    a, shared = words("a", 40), words("s", 30)
    rows = [
        (None, words("w", 30) * 2), (None, words("u", 60)), (None, [*words("y", 3), *shared]),
        (5, a), (6, a), (6, words("c", 50)), (6, [*words("e", 7), *shared, *words("f", 5)]),
        (7, [*shared, *words("g", 25)]), (7, [*shared, *words("h", 25)]), (7, [*words("i", 4), *shared]), (7, [*words("i", 4), *shared]), (8, [*words("k", 50), *words("k", 50)]), (8, words("l", 100)),
    ]
    keyed = [(-(1 << 63) if d is None else d, w) for d, w in rows]
    want = sorted((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)) for (d, w), (_, gone) in zip(keyed, cut_by_hand(keyed, 20), strict=True))
    for extra in ((), ("row", "doc")):
        frame = spark.createDataFrame([(d, " ".join(w), *extra) for d, w in rows], "doc_id bigint, text string" + "".join(f", {c} string" for c in extra)).repartition(parts)
        out = substrings.remove_repeats(frame, 20, 10, rejoin=True).collect()
        assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == want
        assert all((r.row, r.doc) == extra for r in out if extra)


def test_op10(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = [(d, t.encode().split()) for d, t in docs]
    want = {}
    for (d, gone), (_, w) in zip(cut_by_hand(rows, 20), rows, strict=True):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q.op10_substring_dedup(spark, SF).collect()} == want


def test_cross_parser():
    samples = {"a": b"the cat sat on the mat and ate the rat", "b": "le chat est là sur le tapis".encode()}
    long = " ".join(random.Random(1).choice("the cat sat on rat le chat tapis zz est".split()) for _ in range(900))
    texts = ["The CAT zz le chat", "", "zzzz", "q" * 700 + "the mat" * 50, "é chat é sur", "là", long, samples["a"].decode() * 40]
    parser = langid.CrossParser(samples)
    at, raw, _ = string_buffers(pa.array(texts))
    fold = lambda b: bytes(langid.fold_bytes(np.frombuffer(b, np.uint8)))
    want = [[phrases_by_hand(fold(samples[k]), fold(t.encode())) for t in texts] for k in "ab"]
    assert parser.phrases(at, raw).astype(int).tolist() == want


def phrases_by_hand(sample, raw):
    """Longest matches, one after the other, over the whole text."""
    n = i = 0
    while i < len(raw):
        j = i + 1
        while j <= len(raw) and raw[i:j] in sample:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_op9_by_brute_force(spark, tmp_path):
    import zlib

    from pyspark.sql import functions as F

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").where("octet_length(text) <= 1024").select("doc_id", "text", "lang").collect()]
    rows += [(5000, None, "en"), (5001, "12 34", "fr"), (None, "le la les", None), (5002, rows[0][1], rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mod = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 3
    hashed = {r.d: r.h for r in docs.where("doc_id is not null").select(F.col("doc_id").alias("d"), F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    letter = lambda t: t is not None and any(c.isalpha() for c in t)
    learned = {}
    for d, t, lang in sorted((r for r in rows if r[0] is not None), key=lambda r: (hashed[r[0]], r[0])):
        if mod(d) != 1 and lang is not None and letter(t):
            learned.setdefault(lang, []).append(t.encode())
    for k, texts in learned.items():  # whole texts that fit, in order, each once
        kept, room = [], langid.SAMPLE_BYTES
        for t in texts[: langid.SAMPLE_DOCS]:
            if t not in kept and len(t) <= room:
                kept.append(t)
                room -= len(t)
        learned[k] = kept
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    samples = {k: lower(b"".join(t + b"\n" for t in x)) for k, x in learned.items()}
    want = []
    for d, t, _ in rows:
        pred, score = "und", 0.0
        if letter(t):
            raw = lower(t.encode())
            rates = sorted((phrases_by_hand(x, raw) * math.log2(len(x) + 2), k) for k, x in samples.items())
            pred, score = rates[0][1], 1 - rates[0][0] / rates[1][0]
        want.append((d if d is not None else -1, mod(d) == 1, pred, round(score, 9)))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in Q.op9_language_id(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(samples) == 4


def test_sample_of_a_language_of_long_texts_only(spark):
    from pyspark.sql import functions as F

    rows = [(i, "mot " * (10000 + i), "fr") for i in range(3)] + [(10 + i, "word " * 9, f"l{i}") for i in range(20)] + [(50, "word", "en")] * 2
    samples = langid.learn(spark.createDataFrame(rows, "doc_id int, text string, lang string"), F.lit(True), sample_docs=2)
    assert len(samples) == 22 and samples["fr"] == b"mot " * 10000 + b"\n" and samples["en"] == b"word\n"  # the shortest, whole; copies once
    some = langid.learn(spark.createDataFrame([(i, f"{i} " + "mot " * 1000, "fr") for i in range(30)], "doc_id int, text string, lang string"), F.lit(True), sample_bytes=9000)
    assert len(some["fr"].split(b"\n")) == 3 and all(len(t) in (0, 4002, 4003) for t in some["fr"].split(b"\n"))


def test_language_edges(spark):
    from pyspark.sql import functions as F

    rows = [(1, "the cat sat on the mat", "en", "x"), (2, "le chat est sur le tapis", "fr", "x"), (3, None, "en", "x"), (4, "123 !?", "fr", "x"), (5, "", None, "x"), (None, "the mat", None, "x"), (1, "the cat", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    samples = langid.learn(docs, F.lit(True))
    assert sorted(samples) == ["en", "fr"]
    out = langid.identify(docs, samples)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in out.collect())
    assert got == [(0, "en"), (1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")]
    assert set(out.columns) == {"doc_id", "text", "lang", "lang_pred", "score"}
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.learn(docs.limit(0), F.lit(True)) == {}
    assert {r.score for r in langid.identify(docs.where("doc_id = 1"), {"en": b"the cat"}).collect()} == {1.0}


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 200 and (out.lang == out.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_licenses(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet the of a") for _ in range(n))
    texts, want = [], set()
    for i, (name, notices) in enumerate(sorted(licenses.TEMPLATES.items()) * 3):
        number = i % len(notices)
        notice = notices[number]
        if i % 2:
            notice = notice.upper().replace(" ", " \n")
        texts.append(f"{noise(rng.randrange(60))} {notice} {noise(rng.randrange(60))}")
        want.add((i, name, number))
    texts += [noise(500), "", None, "Licensed under the Patchy License"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, license string")
    out = licenses.scan_licenses(docs).collect()
    assert {(r.doc_id, r.license, r.template) for r in out} == want
    assert all(0.8 <= r.containment <= 1 for r in out)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_license_windows_by_brute_force(spark):
    """Every window of every text against every template, without MinHash."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    fold = licenses.fold_letters()
    clean = lambda t: bytes(fold[np.frombuffer(t.encode(), np.uint8)]).split()
    texts = {d: clean(t) for d, t in docs}
    sets, fits = {}, {}
    for name, notices in licenses.TEMPLATES.items():
        for number, notice in enumerate(notices):
            t = clean(notice)
            n = min(5, len(t))
            m = len(t) - n + 1
            grams = sets[name, number] = {tuple(t[i : i + n]) for i in range(m)}
            step = next(s for s in (k for p in range(30) for k in (1 << p, 3 << p >> 1)) if 2 * s >= 1.25 * m - 1)
            for d, w in texts.items():
                own = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
                if grams.isdisjoint(own):
                    continue
                for a in range(0, len(own), step):
                    share = len(grams & set(own[a : a + 3 * step])) / len(grams)
                    if share >= 0.8:
                        fits[d, name, number] = max(share, fits.get((d, name, number), 0))
    # a variant, which holds 0.8 of a template's shingles, stands for it where more of it is there
    count = lambda k: (round(fits.get(k, 0) * len(sets[k[1:]])), fits.get(k, 0))
    better = lambda k, v: count((k[0], *v)) > count(k) and len(sets[k[1:]] & sets[v]) >= 0.8 * len(sets[k[1:]])
    want = {k for k in fits if not any(better(k, v) for v in sets if v != k[1:])}
    got = {(r.doc_id, r.license, r.template) for r in Q.op5_license_scan(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len(want) > 20


def test_whole_licenses_with_edits(spark):
    rng = random.Random(12)
    texts, want = [], []
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "Apache-2.0"):
        number = max(range(len(licenses.TEMPLATES[name])), key=lambda n: len(licenses.TEMPLATES[name][n]))
        for edits in (0,) if name in ("ISC", "0BSD") else (0, 1, 3):  # these two are each other's neighbours
            w = licenses.TEMPLATES[name][number].split()
            for at in rng.sample(range(len(w)), edits):
                w[at] = "changed"
            noise = [[rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(300))] for _ in range(2)]
            texts.append(" ".join([*noise[0], *w, *noise[1]]))
            want.append((len(texts) - 1, name, number))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.license, r.template) for r in licenses.scan_licenses(docs).collect()}
    assert set(want) <= got
    kin = lambda name: {"0BSD": "ISC"}.get(name, name[:3])
    assert all(kin(lic) == kin(want[d][1]) for d, lic, _ in got)
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.8, 0.9999)
    assert all(8 <= b <= 40 for b in scanner.bands.values())


def classes_by_hand(rows, similar=0.8, floor=0.1):
    """Classes of (doc_id, text) by weighted Jaccard similarity of all pairs."""
    sets = []
    for _, t in rows:
        w = t.encode().split() if t else []
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        sets.append(Counter(grams))
    n = sum(t is not None for _, t in rows)
    df = Counter(k for s in sets for k in s)
    weight = {k: math.log1p(n / max(c, floor * n)) for k, c in df.items()}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if not same and a and b:
                low = sum(weight[k] * min(v, b[k]) for k, v in a.items() if k in b)
                high = sum(weight[k] * v for k, v in a.items()) + sum(weight[k] * v for k, v in b.items()) - low
                same = low / high >= similar
            if same:
                links.append((i, j))
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    named = {}
    for own in members.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        for i in own:
            named[i] = (min(ids, default=None), len(own))
    return named, links


def near_copy(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def test_near_duplicates(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        rows += [(len(rows) + i, " ".join(near_copy(rng, base, rng.choice([0, 1, 2, 3, 5, 9, 14])))) for i in range(rng.choice([1, 4, 20]))]
    rows += [(9000, rows[0][1]), (9000, rows[0][1]), (9001, None), (9002, None), (9003, ""), (9004, ""), (9005, "few words"), (9006, "few  words"), (None, rows[3][1]), (9007, "x " * 4000), (9008, "x " * 3900)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, class_id int").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(docs).collect())
    named, links = classes_by_hand(rows)
    assert got == Counter((rows[i][0], *named[i]) for i in range(len(rows))) and len(links) > 50
    kept = neardup.keep_one(docs, neardup.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_class_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, a), (None, a + " end"), (1, b), (1, b), (2, b), (2, c), (None, c), (3, d), (3, d + " end"), (None, None), (None, None), (4, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, source string").repartition(3)
    kept = neardup.keep_one(docs, neardup.near_duplicates(docs))
    got = Counter((r.doc_id, (r.text or "none")[0]) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == Counter([(None, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "n"), (None, "n"), (4, "n")])


@pytest.mark.parametrize(("edits", "size"), [((1, 2, 4), 90), ((0, 3, 6, 9), 60)])
def test_blocks_lose_no_link(spark, monkeypatch, edits, size):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 6000)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(near_copy(rng, base, rng.choice(edits)))) for i in range(size)]
    named, _ = classes_by_hand(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {rows[i][0]: named[i][0] for i in range(len(rows))}


def test_texts_apart_from_the_first_are_compared_with_all(spark):
    """A bucket whose texts link in a chain: the last is far from the first."""
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(115)]
    chain = [base[3 * n : 3 * n + 100] for n in range(6)] + [[f"z{i}" for i in range(100)]]
    whole = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(chain)], "n bigint, text string")
    members = whole.select(F.lit(1).cast("long").alias("key"), "n", F.length("text").alias("size"), F.lit(0).cast("long").alias("first"))
    weights = neardup.Weights(1000, {})
    sets = [{tuple(w[i : i + 5]) for i in range(96)} for w in chain]
    near = {(a, b) for a in range(7) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    stars = members.where("n <> first").select(F.col("first").alias("left"), "n", "size")
    links = neardup._linked_to_firsts(stars, whole, weights, 0.8)
    assert {(r.a, r.b) for r in links.collect()} == {(a, b) for a, b in near if b == 0} != near
    apart = neardup._apart(members, neardup.connected(links))
    more = neardup._linked_apart(members, apart, whole, weights, 0.8)
    assert {r.node: r.root for r in neardup.connected(links.union(more)).collect()} == dict.fromkeys(range(6), 0)


def test_op6_by_brute_force(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    named, links = classes_by_hand(rows)
    got = {r.doc_id: (r.class_id, r.class_size) for r in Q.op6_weighted_near_dedup(spark, SF).collect()}
    assert got == {rows[i][0]: named[i] for i in range(len(rows))} and len(links) > 10


def test_exact_counts_of_all_shingles(spark):
    rng = random.Random(33)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        rows += [(len(rows) + i, " ".join(near_copy(rng, base, rng.choice([0, 1, 2, 3, 5])))) for i in range(rng.choice([2, 5, 12]))]
    rows += [(9001, None), (9002, ""), (9003, "few words"), (None, rows[3][1]), (9004, rows[3][1])]
    named, links = classes_by_hand(rows, floor=0)
    assert named != classes_by_hand(rows)[0] and len(links) > 20
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), df_floor=0).collect())
    assert got == Counter((rows[i][0], *named[i]) for i in range(len(rows)))


def classes_by_class_counts(rows, similar=0.8):
    """Classes of (doc_id, text) by exact idf over the classes that equal weights give, of all pairs."""
    sets = []
    for _, t in rows:
        w = t.encode().split() if t else []
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
        sets.append(Counter(grams))

    def classes(weight):
        root = list(range(len(rows)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                low = sum(weight(k) * min(v, b[k]) for k, v in a.items() if k in b)
                high = sum(weight(k) * v for s in (a, b) for k, v in s.items()) - low
                if rows[i][1] is not None and rows[i][1] == rows[j][1] or high and low / high >= similar:
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        return root

    plain = classes(lambda k: 1.0)
    df = Counter(k for _, k in {(plain[i], k) for i, s in enumerate(sets) for k in s})
    texts = {plain[i] for i, (_, t) in enumerate(rows) if t is not None}
    root = classes(lambda k: math.log1p(len(texts) / df[k]))
    members = {c: [i for i, r in enumerate(root) if r == c] for c in root}
    ids = {c: [rows[i][0] for i in own if rows[i][0] is not None] for c, own in members.items()}
    return {i: (min(ids[c], default=None), len(members[c])) for i, c in enumerate(root)}


def test_exact_counts_of_classes(spark):
    """What unlike texts share weighs less, in far fewer than a tenth of them too; what copies share does not."""
    rng = random.Random(35)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(80)] for _ in range(4)]
    rows = []
    for g in range(24):
        base = [word() for _ in range(20)] + shared[g % 4] if g < 12 else [word() for _ in range(100)]
        rows += [(len(rows) + i, " ".join(near_copy(rng, base, rng.choice([0, 0, 1, 2, 3])))) for i in range(rng.choice([1, 2, 6, 16]))]
    # two texts that are alike by plain shingles, through a passage that many have
    for n in range(30):
        rows.append((5000 + n, " ".join(shared[0] + [word() for _ in range(6 if n < 2 else 60)])))
    rows += [(9001, None), (9002, ""), (9003, "few words"), (None, rows[3][1]), (9004, rows[3][1]), (9004, rows[3][1])]
    want = classes_by_class_counts(rows)
    assert want != classes_by_hand(rows)[0] and want != classes_by_hand(rows, floor=0)[0]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(docs, by_class=True).collect())
    assert got == Counter((rows[i][0], *want[i]) for i in range(len(rows)))
    assert neardup.near_duplicates(docs.limit(0), by_class=True).count() == 0


def test_op6_weighs_by_class_counts(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    texts = spark.createDataFrame([(i, i, t) for i, (_, t) in enumerate(rows)], "id bigint, root bigint, text string")
    told = {(r.id, x.h): x.w for r in neardup.class_counts(texts, 7).collect() for x in r.often}
    h = [set(neardup.shingles(neardup.Words(pa.array([t])))[1].view("int64").tolist()) for _, t in rows]
    df = Counter(k for s in h for k in s)
    assert told == {(i, k): df[k] for i, s in enumerate(h) for k in s if df[k] > 1} and len(told) > 1000
    named = classes_by_class_counts(rows)
    got = {r.doc_id: (r.class_id, r.class_size) for r in Q.op6_weighted_near_dedup(spark, SF).collect()}
    assert got == {rows[i][0]: named[i] for i in range(len(rows))}


def test_texts_alone_are_not_weighed(spark, monkeypatch):
    """Weights are drawn only for texts that counts of classes leave a link: the others' shingles don't travel again."""
    rng = random.Random(37)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [word() for _ in range(80)]
    rows = [(n, " ".join([word() for _ in range(60)])) for n in range(30)]
    rows += [(100 + n, " ".join(shared + [word() for _ in range(4 if n < 2 else 60)])) for n in range(6)]  # two could be alike
    rows += [(200, rows[0][1] + " end"), (201, None), (202, ""), (203, rows[5][1])]
    drawn, real = [], neardup._drawn
    monkeypatch.setattr(neardup, "_drawn", lambda held, *args: drawn.append(held.count()) or real(held, *args))
    got = {r.doc_id: (r.class_id, r.class_size) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), by_class=True).collect()}
    want = classes_by_class_counts(rows)
    assert got == {rows[i][0]: want[i] for i in range(len(rows))}
    assert drawn == [len(rows), 4]


def test_recall_of_near_copies(spark):
    """Pairs of a plain shingle similarity of 0.8 and more are found, rare and common words alike."""
    rng = random.Random(21)
    rows, pairs = [], []
    for g in range(150):
        base = [f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(rng.choice([60, 200, 600]))]
        copy = near_copy(rng, base, 0)
        for _ in range(60):
            edited = near_copy(rng, copy, 1)
            grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, edited)]
            if len(grams[0] & grams[1]) < 0.82 * len(grams[0] | grams[1]):
                break
            copy = edited
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        pairs.append((2 * g, 2 * g + 1))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) / len(pairs) >= 0.98 and len(set(got.values())) >= len(pairs)


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "SMALL_LINKS", small)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (3, 10), (11, 10), (4, 5)], "a bigint, b bigint")
    assert {r.node: r.root for r in neardup.connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 4: 4, 5: 4}
    path = [(n, n + 1) for n in range(0, 40)] + [(100, n) for n in range(101, 140)]
    random.Random(2).shuffle(path)
    assert {r.node: r.root for r in neardup.connected(spark.createDataFrame(path, "a bigint, b bigint")).collect()} == {n: 0 if n < 100 else 100 for n in [*range(41), *range(100, 140)]}
    assert neardup.connected(edges.limit(0)).count() == 0


def test_weighted_sampling_estimates_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a, b = rng.random(300) * 3 + 0.1, rng.random(300) * 3 + 0.1
    same = neardup.samples(h, a, np.array([0]), 2000) == neardup.samples(h, b, np.array([0]), 2000)
    assert abs(same.mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_minima_estimate_similarity():
    h = np.random.default_rng(1).integers(0, 2**64, 400, dtype=np.uint64)
    a, b = h[:300], h[100:]
    same = neardup.minima(a, np.array([0]), 4000) == neardup.minima(b, np.array([0]), 4000)
    assert abs(same.mean() - 0.5) < 0.03
