"""Toxicity by the nearest labelled examples under tf-idf cosine.

Examples are a bounded sample of labelled texts. The space has the words that
tell the labels apart in the sample (likelihood ratio); how many documents have
each is counted over all. Examples lie in an inverted index whose postings come
in blocks of neighbouring examples, each with its highest weight (block-max
index): a query adds up the blocks' bounds, scores the most promising blocks,
and stops when no other can hold a nearer example, so the nearest are exact.

The nearest vote, by nearness; a logistic curve, fitted on the examples' own
votes with each left out, makes votes probabilities.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.storage import broadcast_if_small

from .common import mix64, saved, small_batches, string_buffers, worker_cache
from .words import Words, chunks

#: Examples of each label, and bytes of their texts: the bound of the sample.
EXAMPLES, EXAMPLE_BYTES = 4096, 8 << 20
#: A word is in the space if its likelihood ratio in the sample reaches this.
EVIDENCE = 20.0
NEIGHBOURS, BLOCK = 15, 64
#: A neighbour at distance d votes with weight 1 / (NEAR + d).
NEAR = 0.1
#: The beginnings of words that are terms too, in bytes.
STEMS = (4, 5, 6, 7, 8)
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("'")] = ord("'")
for _low, _high in (("a", "z"), ("0", "9")):
    _FOLD[ord(_low) : ord(_high) + 1] = np.arange(ord(_low), ord(_high) + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def terms_of(texts: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often, words of each text): texts' different terms, in order; only those of ``among`` (sorted), if given.

    Terms are words, in small letters and without punctuation, and the
    beginnings of words, of ``STEMS`` bytes.
    """
    words = Words(texts, _FOLD)
    raw = _FOLD[string_buffers(texts)[1]]
    size = words.end - words.start
    own, found = [words.text], [words.hash]
    sums = np.zeros(len(size), np.uint64)
    for n in range(max(STEMS)):
        longer = np.flatnonzero(size > n)
        sums[longer] = mix64(sums[longer] + raw[words.start[longer] + n] + np.uint64(1))
        if n + 1 in STEMS:
            own.append(words.text[longer])
            found.append(sums[longer] ^ np.uint64(n + 1))
    own, h = np.concatenate(own), np.concatenate(found)
    if among is not None:
        held = _among(h, among)
        own, h = own[held], h[held]
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return own[new], h[new], np.diff(np.r_[new, len(h)]), words.count


def _among(h: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each is in the sorted array."""
    return among[np.minimum(np.searchsorted(among, h), len(among) - 1)] == h if len(among) else np.zeros(len(h), bool)


def originals(texts: pa.Array) -> np.ndarray:
    """Places of the texts without those that share their least run of five words with an earlier one: near copies say nothing new."""
    told = [np.zeros(0, np.uint64)]
    for part in chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        words = Words(part.column(0), _FOLD)
        start, h = words.grams(5)
        least = np.full(part.num_rows, np.iinfo(np.uint64).max)
        np.minimum.at(least, words.text[start], h)
        short = np.flatnonzero(words.count < 5)
        least[short] = words.runs(words.begin[short], words.begin[short] + words.count[short]) if len(words) else 0
        told.append(least)
    return np.sort(np.unique(np.concatenate(told), return_index=True)[1])


def telling_terms(texts: pa.Array, toxic: np.ndarray, evidence: float) -> np.ndarray:
    """The terms whose presence depends on the label: likelihood ratio G2 of ``evidence`` or more."""
    term, seen, bad = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    at = 0
    for part in chunks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        own, h, _, _ = terms_of(part.column(0))
        h, place = np.unique(np.r_[term, h], return_inverse=True)
        here = place[len(term) :]
        seen = np.bincount(here, minlength=len(h)) + np.bincount(place[: len(term)], seen, len(h))
        bad = np.bincount(here, toxic[at + own], len(h)) + np.bincount(place[: len(term)], bad, len(h))
        term, at = h, at + part.num_rows
    n, t = len(toxic), int(toxic.sum())
    g = np.zeros(len(term))
    for count, row, column in ((bad, seen, t), (seen - bad, seen, n - t), (t - bad, n - seen, t), (n - t - seen + bad, n - seen, n - t)):
        expected = row * (column / max(n, 1))
        g += 2 * np.where(count > 0, count * np.log(np.maximum(count, 1e-300) / np.maximum(expected, 1e-300)), 0.0)
    return term[g >= evidence]


class Space:
    """tf-idf vectors over some terms; ``df``: in how many of ``docs`` documents each is.

    One more term stands for any word: all texts with words have it, as often as
    they have words. So a long text needs more of the others to be like a short one.
    """

    def __init__(self, terms: np.ndarray, df: np.ndarray, docs: int):
        order = np.argsort(terms)
        self.terms, self.idf = terms[order], np.r_[np.log((docs + 1) / (df[order] + 1)) + 1, 1.0]

    def vectors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of unit vectors; texts without a word have none."""
        own, h, tf, count = terms_of(texts, self.terms)
        some = np.flatnonzero(count)
        own, at, tf = np.r_[own, some], np.r_[np.searchsorted(self.terms, h), np.full(len(some), len(self.terms))], np.r_[tf, count[some]]
        order = np.argsort(own, kind="stable")
        own, at, tf = own[order], at[order], tf[order]
        weight = (1 + np.log(tf)) * self.idf[at]
        norm = np.sqrt(np.bincount(own, weight * weight, len(texts)))
        return own, at, weight / norm[own]


class BlockMaxIndex:
    """Postings by term, in blocks of ``block`` neighbouring examples with the highest weight of each."""

    def __init__(self, own: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int, examples: int, block: int = BLOCK):
        order = np.lexsort((own, term))
        self.example, self.weight, term = own[order], weight[order], term[order]
        self.block, self.examples, self.blocks = block, examples, -(-examples // block)
        lane = term * max(self.blocks, 1) + self.example // block
        new = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]]) if len(lane) else np.zeros(0, np.int64)
        self.first = np.r_[new, len(lane)]  # where each block's postings begin
        self.of_block = (self.example // block)[new]
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.begin = np.searchsorted(term[new], np.arange(terms + 1))  # each term's first block
        self.scored = 0  # blocks whose examples were scored, of all queries

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of highest positive cosine and their cosines, ties to the earlier; ``skip`` takes no part."""
        lanes = [np.arange(self.begin[t], self.begin[t + 1]) for t in terms]
        lane, q = np.concatenate(lanes), np.repeat(weights, [len(x) for x in lanes])
        bound = np.bincount(self.of_block[lane], q * self.most[lane], self.blocks)
        todo = np.flatnonzero(bound)
        todo = todo[np.argsort(-bound[todo], kind="stable")]
        best, score, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(todo):
            kth = score[k - 1] if len(score) >= k else 0.0
            some = todo[at : at + step]
            some = some[bound[some] >= kth * (1 - 1e-9)]  # an equal score may win by its place
            if not len(some):
                break
            self.scored += len(some)
            wanted = np.zeros(self.blocks, bool)
            wanted[some] = True
            mine = wanted[self.of_block[lane]]
            a, size = self.first[lane[mine]], self.first[lane[mine] + 1] - self.first[lane[mine]]
            post = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            dense = np.bincount(self.example[post], np.repeat(q[mine], size) * self.weight[post], self.examples)
            if skip >= 0:
                dense[skip] = 0.0
            found = np.flatnonzero(dense)
            best, score = np.r_[best, found], np.r_[score, dense[found]]
            order = np.lexsort((best, -score))[:k]
            best, score = best[order], score[order]
            at, step = at + step, 2 * step
        return best, score


@dataclass
class Model:
    """The examples' texts with labels and ids, the weight of one example of each label, the words' counts."""

    texts: list[str]
    toxic: list[int]
    ids: list[int]
    weight: tuple[float, float]
    words: list[int]
    df: list[int]
    docs: int
    k: int = NEIGHBOURS

    @property
    def key(self) -> str:
        sums = hashlib.sha1(repr((self.toxic, self.ids, self.weight, self.words, self.df, self.docs, self.k)).encode())
        for text in self.texts:
            sums.update(text.encode("utf-8", "replace") + b"\0")
        return sums.hexdigest()


class Judge:
    """Scores texts under a model."""

    def __init__(self, model: Model):
        self.model, self.k = model, model.k
        self.toxic = np.array(model.toxic, np.float64)
        self.share = np.where(self.toxic > 0, model.weight[1], model.weight[0])
        total = float(self.share.sum())
        self.prior = float((self.share * self.toxic).sum() / total) if total else 0.0
        self.space = Space(np.array(model.words, np.uint64), np.array(model.df, np.float64), model.docs)
        made, at = [], 0
        for part in chunks(pa.RecordBatch.from_arrays([pa.array(model.texts, pa.string())], ["text"]), "text"):
            own, term, weight = self.space.vectors(part.column(0))
            made.append((own + at, term, weight))
            at += part.num_rows
        own, term, weight = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.index = BlockMaxIndex(own, term, weight, len(self.space.idf), len(model.texts))
        cut = np.searchsorted(own, np.arange(len(model.texts) + 1))
        votes = np.array([self.vote(*self.index.nearest(term[a:b], weight[a:b], self.k, n)) if b > a else self.prior for n, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))])
        self.plain: tuple | None = None
        self.curve = calibrated(votes, self.toxic, self.share)

    def vote(self, near: np.ndarray, score: np.ndarray) -> float:
        """The share of toxic votes, each by nearness; with the labels' share as one vote at distance 1."""
        w = self.share[near] / (NEAR + 1 - np.minimum(score, 1.0))
        base = float(self.share.mean()) / (NEAR + 1)
        return (float((w * self.toxic[near]).sum()) + base * self.prior) / (float(w.sum()) + base)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(probability, nearest examples, their cosines) of each text."""
        n = len(texts)
        if not len(self.toxic):
            return np.zeros(n), [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        own, term, weight = self.space.vectors(texts)
        cut = np.searchsorted(own, np.arange(n + 1))
        votes, near, cosine = np.full(n, self.prior), [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n
        for at in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[at], cut[at + 1]
            if b - a > 1:
                near[at], cosine[at] = self.index.nearest(term[a:b], weight[a:b], self.k)
            else:  # the term that all have, and no other
                near[at], cosine[at] = self.plain = self.plain or self.index.nearest(term[a:b], weight[a:b], self.k)
            votes[at] = self.vote(near[at], cosine[at])
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * votes, -500, 500))), near, cosine


def calibrated(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve a + b * vote that fits the labels best, b not negative.

    Targets stand a little inside 0 and 1 (Platt), so that labels that votes tell
    apart wholly have a curve too. Without both labels all get the one there is.
    """
    if not len(toxic) or toxic.min() == toxic.max():
        return (-4.0 if not len(toxic) or toxic[0] == 0 else 4.0), 0.0
    bad = toxic > 0
    target = np.where(bad, (bad.sum() + 1) / (bad.sum() + 2), 1 / ((~bad).sum() + 2))
    w = weight / weight.sum()
    x = np.stack([np.ones(len(votes)), votes], 1)
    beta = np.array([np.log((w * target).sum() / (1 - (w * target).sum())), 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (w * (target - p))
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[1] >= 0 else (float(np.log(1e-9 + (w * target).sum()) - np.log(1 - (w * target).sum())), 0.0)


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, examples: int = EXAMPLES, example_bytes: int = EXAMPLE_BYTES, evidence: float = EVIDENCE, k: int = NEIGHBOURS) -> Model:
    """Examples, words and counts.

    ``labels`` has ``doc_id`` and ``toxic``; ``may_learn`` speaks of them. Of
    several labels of a doc_id any toxic one decides; null ids and labels go. Of each
    label the ``examples`` doc_ids that hash lowest are looked up; of a doc_id's
    texts one is taken, whole. In that order the texts that fit into
    ``example_bytes`` together are the examples; one that doesn't fit is left
    out, not cut. Counts of documents are over all rows of ``docs``.
    """
    told = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("bad"))
    told = saved(told)
    many = {r.bad: r.n for r in told.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("bad").orderBy(F.xxhash64("id"), "id")
    picked = broadcast_if_small(told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= examples))
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("text"))
    texts = docs.where("text is not null").join(picked, "id").groupBy("id", "bad", "place").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    sized = saved(texts.select("id", "bad", "place", F.col("t.text").alias("text"), F.octet_length("t.text").cast("long").alias("size")))
    room, ids = example_bytes, []
    for row in sorted(sized.select("id", "bad", "place", "size").collect(), key=lambda r: (r.place, -r.bad)):
        if row.size <= room:
            room -= row.size
            ids.append(row.id)
    rows = sorted(sized.where(F.col("id").isin(ids)).collect() if ids else [], key=lambda r: r.id)
    rows = [rows[n] for n in originals(pa.array([r.text for r in rows], pa.string())).tolist()]
    toxic = np.array([r.bad for r in rows], np.float64)
    weight = tuple(many.get(b, 0) / max(sum(r.bad == b for r in rows), 1) for b in (0, 1))
    words = telling_terms(pa.array([r.text for r in rows], pa.string()), toxic, evidence)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(words), np.int64), 0
        for batch in batches:
            for part in chunks(batch, "text"):
                total += np.bincount(np.searchsorted(words, terms_of(part.column("text"), words)[1]), minlength=len(words))[: len(words)]
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(len(words))]), pa.array(np.r_[n, total])], ["word", "n"])

    counted = {r.word: r.n for r in docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    df = [counted.get(n, 0) for n in range(len(words))]
    return Model([r.text for r in rows], [r.bad for r in rows], [r.id for r in rows], weight, words.tolist(), df, counted.get(-1, 0), k)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` and ``evidence`` to every row, by its whole text.

    ``evidence`` lists the nearest examples (doc_id, toxic, cosine), nearest
    first, ties to the smaller doc_id; those that share no word of the space
    aren't listed. A text with no such word, an empty or a null one, has no
    neighbours: its score is what labelled texts of that kind have. Without any
    example scores are 0. Columns of those names are replaced, all others stay;
    there is no shuffle.
    """
    docs = small_batches(docs).drop("score", "predicted", "evidence")
    key, names = model.key, docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int, evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>"
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
    ids, toxic = np.array(model.ids, np.int64), np.array(model.toxic, np.int32)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = worker_cache(f"toxicity:{key}", lambda: Judge(held.value))
        for batch in batches:
            for part in chunks(batch, text):
                p, near, cosine = told.score(part.column(text))
                evidence = [[{"doc_id": i, "toxic": t, "cosine": c} for i, t, c in zip(ids[n].tolist(), toxic[n].tolist(), s.tolist(), strict=True)] for n, s in zip(near, cosine, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(evidence, kind)], [*names, "score", "predicted", "evidence"])

    return docs.mapInArrow(judge, schema)
