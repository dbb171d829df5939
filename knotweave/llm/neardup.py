"""Near-duplicate classes by improved consistent weighted sampling.

Ioffe, "Improved Consistent Weighted Sampling, Weighted Minhash and L1
Sketching" (2010): two weighted sets draw the same sample with the probability
of their weighted Jaccard similarity. Documents are sets of shingles of five
words, weighted by tf-idf. Samples are banded; texts that share a band are
candidates, and exact weighted Jaccard similarity decides.

idf is ln(1 + N / df), with df taken as at least ``df_floor`` of N: rarer
shingles all weigh the same. So only shingles in more than that share of all
documents need counts, a bounded number. A group of copies, be it thousands,
keeps full weights, and what a large part of the corpus shares says less. With
a floor of 0 every shingle weighs by its own exact df: all shingles are shuffled
to be counted, and the counts come back to the texts.

With ``by_class`` every shingle weighs by its exact df too, but df counts classes
of near copies as unweighted shingles tell them, not documents: what copies share
then says no less than their edits do, and what unlike texts share says less.
Texts that these counts show to be alone are not looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotweave.storage import broadcast_if_small, is_small

from .common import forget, mix64, require_whole_ids, saved, small_batches, string_buffers, unused
from .words import Words, chunks

SHINGLE, SIMILAR = 5, 0.8
#: A pair of similarity s is a candidate with probability 1 - (1 - s**ROWS)**BANDS:
#: 0.9992 at 0.8, 0.99996 at 0.85.
BANDS, ROWS = 10, 3
DF_FLOOR = 0.1
#: Bytes of text in one block of an exact comparison (a longer text is a block
#: of its own), and texts in it.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 256
#: Documents that a local count covers at least, unless its partition ends.
COUNT_DOCS = 64
MAX_STEPS = 50
#: Links that are counted to be no more than this are connected in one task (4 MB of numbers).
SMALL_LINKS = 1 << 18

#: Shingles (11 bytes each) that a task packs before it sends them on, and that a bucket of them is to hold.
PACKED, BUCKET_SHINGLES, MIN_BUCKETS, MAX_BUCKETS = 1 << 20, 1 << 21, 256, 1 << 15
#: Bits of the number of a text or class: of two classes with a shingle one goes
#: uncounted with probability 2**-40, and texts of one number share their lists.
NUMBER_BITS = 40
#: Rows of one number up to which they are broadcast (64 MB).
SMALL_KEYS = 1 << 22

_BITS = 12


def _gamma2(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the midpoints of n equal parts."""
    p = (np.arange(n) + 0.5) / n
    x = np.maximum(np.sqrt(2 * p), 1e-6)
    for _ in range(60):  # Newton's method on 1 - (1 + x) exp(-x) = p
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), x / 4)
        x = np.minimum(x, 60.0)
    return x


_R = _gamma2(1 << _BITS).astype(np.float32)
_INVERSE_R = (1 / _R).astype(np.float32)
_LN_C = np.log(_gamma2(1 << 20)).astype(np.float32)


def all_shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every place of a shingle, in no order.

    A text of fewer words than a shingle has all its words as its one shingle.
    """
    start, h = words.grams(SHINGLE)
    own = words.text[start]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        a = words.begin[short]
        own, h = np.r_[own, short], np.r_[h, words.runs(a, a + words.count[short])]
    return own, h


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, how often) of each text's different shingles, in order."""
    own, h = all_shingles(words)
    order = np.argsort(h)
    # numbers of 16 bits are sorted by their digits
    order = order[np.argsort(own[order].astype(np.uint16) if len(words.count) < 1 << 16 else own[order], kind="stable")]
    own, h = own[order], h[order]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return own[new], h[new], np.diff(np.r_[new, len(h)])


class Weights:
    """tf-idf weights from the number of documents and the counts of shingles that have their own."""

    def __init__(self, docs: int, counts: dict[int, int], floor: float = DF_FLOOR):
        h = np.fromiter(counts, np.uint64, len(counts))
        self._set(docs, h, np.fromiter(counts.values(), np.float64, len(counts)), floor)

    def _set(self, docs: int, h: np.ndarray, df: np.ndarray, floor: float) -> None:
        self.docs, self.floor, self.equal = max(docs, 1), floor, floor >= 1
        self.common, first = np.unique(h, return_index=True)
        self.idf = np.log1p(self.docs / np.maximum(df[first], floor * self.docs))
        self.most = math.log1p(1 / max(floor, 1 / self.docs))

    def told(self, rows) -> Weights:
        """Weights for rows that bring their counts as lists ``often``; these ones for rows that don't."""
        if "often" not in rows.schema.names:
            return self
        lists = rows.column("often")
        lists = (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten()
        out = Weights.__new__(Weights)
        out._set(self.docs, lists.field("h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), lists.field("w").to_numpy(zero_copy_only=False).astype(np.float64), self.floor)
        return out

    def __call__(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), self.most)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
            idf = np.where(self.common[at] == h, self.idf[at], idf)
        return idf * tf


def samples(h: np.ndarray, weight: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """[set, k]: consistent weighted samples; sets begin at ``starts``.

    A sample is the least ln a of its set, joined with a hash of the element and
    its level t. Uniform variates are bits of hashes; Gamma variates come from
    quantile tables.
    """
    out = np.zeros((len(starts), count), np.uint64)
    ln_w = np.log(weight).astype(np.float32)
    for k in range(count):
        z = mix64(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r_at = (z & np.uint64((1 << _BITS) - 1)).astype(np.int32)
        beta = ((z >> np.uint64(_BITS)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
        c_at = (z >> np.uint64(44)).astype(np.int32)
        r = _R[r_at]
        t = np.floor(ln_w * _INVERSE_R[r_at] + beta)
        ln_a = _LN_C[c_at] - r * (t - beta) - r
        high = (ln_a + np.float32(512)).view(np.uint32).astype(np.uint64) << np.uint64(32)
        level = (t.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(high | ((z ^ level) & np.uint64(0xFFFFFFFF)), starts)
    return out


def minima(h: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """[set, k]: the least of each of ``count`` hashes of a set's elements; sets begin at ``starts``.

    Two sets draw the same with the probability of their Jaccard similarity, as
    with ``samples`` of equal weights, for a fraction of the work.
    """
    out = np.zeros((len(starts), count), np.uint64)
    factor = mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    z, high = np.empty_like(h), np.empty_like(h)
    for k in range(count):
        np.multiply(h, factor[k], out=z)
        np.right_shift(z, np.uint64(32), out=high)
        np.bitwise_xor(z, high, out=z)
        np.multiply(z, np.uint64(0xD6E8FEB86659FD93), out=z)
        out[:, k] = np.minimum.reduceat(z, starts)
    return out


def band_keys(sample: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[set, band]: one number for the samples of each band."""
    key = np.zeros((len(sample), bands), np.uint64)
    for b in range(bands):
        own = np.full(len(sample), b + 1, np.uint64)
        for r in range(rows):
            own = mix64(own * np.uint64(0x9E3779B97F4A7C15) ^ sample[:, b * rows + r])
        key[:, b] = own
    return key.view(np.int64)


def common_shingles(docs: DataFrame, floor: float = DF_FLOOR) -> Weights:
    """Exact document counts of all shingles in at least ``floor`` of the documents.

    A shingle that common has half that share in some local count, summed over
    the local counts where it is that common. At most 2 / ``floor`` times the
    mean number of shingles in a document get so far; a second look counts them
    exactly over all documents.
    """
    total = docs.count()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            many = c >= floor * n / 2
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(c[many])], ["h", "c"])

        for batch in batches:
            for part in chunks(batch, "text"):
                held.append(shingles(Words(part.column("text")))[1])
                n += part.num_rows
                if n >= COUNT_DOCS:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    near = docs.select("text").mapInArrow(local, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= floor * total / 2)
    asked = np.array(sorted(r.h for r in near.select("h").collect()), np.int64).view(np.uint64)
    asked.sort()
    if not len(asked):
        return Weights(total, {}, floor)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(asked), np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                h = shingles(Words(part.column("text")))[1]
                at = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
                count += np.bincount(at[asked[at] == h], minlength=len(asked))
        some = count > 0
        yield pa.RecordBatch.from_arrays([pa.array(asked[some].view(np.int64)), pa.array(count[some])], ["h", "c"])

    counted = docs.select("text").mapInArrow(exact, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    return Weights(total, {r.h % (1 << 64): r.c for r in counted.collect()}, floor)


def own_counts(hashed: DataFrame) -> DataFrame:
    """``digest w often``: each different text's rows, and its shingles (h, w) that several documents have.

    ``hashed`` has ``digest`` and ``text``. Every shingle of every document is
    counted, after counts in each piece of a task, and the counts above 1 go
    back to the texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, c = np.unique(shingles(Words(part.column("text")))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                own, h, _ = shingles(Words(part.column("text")))
                cut = np.searchsorted(own, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))], ["digest", "h"])

    several = saved(hashed.select("text").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("w")).where("w > 1"))
    texts = hashed.select("digest", "text").mapInArrow(listed, "digest binary, h array<bigint>").groupBy("digest").agg(F.first("h").alias("h"))
    total = several.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    back = join_counted(texts.select("digest", F.explode("h").alias("h")), several.withColumn("c", F.col("w")), ["h"], total)
    lists = back.groupBy("digest").agg(F.collect_list(F.struct("h", F.col("c").alias("w"))).alias("often"))
    rows = hashed.groupBy("digest").agg(F.count("*").alias("w"))
    none = F.array().cast("array<struct<h:bigint,w:bigint>>")
    return rows.join(lists, "digest", "left").withColumn("often", F.coalesce("often", none))


def _packed(at: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """``bucket`` and, of its rows, each column's bytes [row, byte]; ``at`` says the rows' buckets, in order."""
    cut = np.searchsorted(at, np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cut))
    ends = cut[np.r_[some, buckets]] if len(some) else np.zeros(1, np.int64)
    blobs = [pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((ends * c.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *blobs], ["bucket", *columns])


def _bytes(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """[number, byte]: bytes of whole numbers, from the lowest one."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, first:last]


def _unpacked(table: pa.Table, widths: dict[str, int]) -> np.ndarray:
    """Numbers whose bytes lie in several columns, the lowest first."""
    held, at = [], 0
    for name, width in widths.items():
        held.append((at, np.frombuffer(b"".join(table[name].to_pylist()), np.uint8).reshape(-1, width)))
        at += width
    out = np.zeros((len(held[0][1]), 8), np.uint8)
    for at, part in held:
        out[:, at : at + part.shape[1]] = part
    return out.reshape(-1).view(np.uint64)


def class_counts(rooted: DataFrame, buckets: int, asked: DataFrame | None = None) -> DataFrame:
    """``id often``: each text's shingles (h, w) that several classes have, and how many have them.

    ``rooted`` has ``text id root``: ``id`` is a number of the text, alike for
    copies, ``root`` one of its class, both of ``NUMBER_BITS``. All shingles of
    all texts travel once, with these numbers, packed in arrays by buckets of
    shingles, as steps from one to the next; those of several classes travel back
    by buckets of texts. Nothing is left out, but where ``asked`` (id, least) says
    how many such shingles a text needs at least, texts of fewer don't return.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            h, root, own = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, root, own = h[order], root[order], own[order]
            # shingles that a text repeats need to go once; those that lie apart are told later
            new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]
            h, root, own = h[new], root[new], own[new]
            at = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            step = h - np.where(np.r_[True, at[1:] != at[:-1]], np.uint64(0), np.r_[np.uint64(0), h[:-1]])
            other = own ^ root  # mostly a text is its class: zeros pack well
            return _packed(at, buckets, {"h": _bytes(step, 0, 4), "h4": _bytes(step, 4, 6), "h6": _bytes(step, 6, 8), "root": _bytes(root, 0, 5), "other": _bytes(other, 0, 5)})

        for batch in batches:
            for part in chunks(batch, "text"):
                text, h = all_shingles(Words(part.column("text")))
                if len(h):
                    held.append((h, *(part.column(c).to_numpy()[text] for c in ("root", "id"))))
                n += len(h)
                if n >= PACKED:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        step = _unpacked(table, {"h": 4, "h4": 2, "h6": 2})
        size = np.array([len(x) // 4 for x in table["h"].to_pylist()])
        start = np.cumsum(size) - size
        h = np.cumsum(step)
        h -= np.repeat(h[start] - step[start], size)
        root, other = _unpacked(table, {"root": 5}), _unpacked(table, {"other": 5})
        order = np.argsort(h)
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        met = order[~new | np.r_[~new[1:], False]]  # shingles that stand alone are in one class
        h, root, own = h[met], root[met], root[met] ^ other[met]
        order = np.lexsort((own, root, h))
        h, root, own = h[order], root[order], own[order]
        first = np.r_[True, h[1:] != h[:-1]][: len(h)]
        new = first | np.r_[True, root[1:] != root[:-1]][: len(h)]
        group = np.cumsum(first) - 1
        classes = np.bincount(group, new, group[-1] + 1 if len(group) else 0).astype(np.int64)[group]
        kept = (classes > 1) & (new | np.r_[True, own[1:] != own[:-1]][: len(h)])
        h, classes, own = h[kept], classes[kept], own[kept]
        at = own % np.uint64(buckets)
        order = np.argsort(at.astype(np.uint16), kind="stable")
        h, classes, own = h[order], classes[order], own[order]
        return pa.Table.from_batches([_packed(at[order], buckets, {"h": _bytes(h, 0, 8), "w": _bytes(classes, 0, 1), "w1": _bytes(classes, 1, 8), "id": _bytes(own, 0, 5)})])

    def listed(table: pa.Table, least: pa.Table | None = None) -> pa.Table:
        own, h, w = _unpacked(table, {"id": 5}).view(np.int64), _unpacked(table, {"h": 8}).view(np.int64), _unpacked(table, {"w": 1, "w1": 7}).view(np.int64)
        order = np.argsort(own, kind="stable")
        own = own[order]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(own)], pa.int32()), pa.StructArray.from_arrays([pa.array(h[order]), pa.array(w[order])], ["h", "w"]))
        out = pa.table({"id": own[new], "often": lists})
        if least is None:
            return out
        told, back = np.unique(least["id"].to_numpy(), return_inverse=True)
        need = np.full(len(told), np.iinfo(np.int64).max)
        np.minimum.at(need, back, least["least"].to_numpy())
        at = np.searchsorted(told, own[new])
        place = np.minimum(at, max(len(told) - 1, 0))
        enough = (told[place] == own[new]) & (np.diff(np.r_[new, len(own)]) >= need[place]) if len(told) else np.zeros(len(new), bool)
        return out.filter(pa.array(enough))

    packed = rooted.select("text", "id", "root").mapInArrow(scan, "bucket int, h binary, h4 binary, h6 binary, root binary, other binary")
    several = packed.groupBy("bucket").applyInArrow(count, "bucket int, h binary, w binary, w1 binary, id binary")
    schema = "id bigint, often array<struct<h:bigint,w:bigint>>"
    if asked is None:
        return several.groupBy("bucket").applyInArrow(lambda table: listed(table), schema)
    needs = asked.select("id", "least", (F.col("id") % buckets).cast("int").alias("bucket"))
    return several.groupBy("bucket").cogroup(needs.groupBy("bucket")).applyInArrow(lambda table, least: listed(table, least), schema)


def _banded(weights: Weights, bands: int, rows: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                own, h, tf = shingles(Words(part.column("text")))
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
                keys: list = [None] * part.num_rows
                n_shingles = np.bincount(own, tf, part.num_rows).astype(np.int32)
                repeats = n_shingles - np.bincount(own, minlength=part.num_rows).astype(np.int32)
                if len(own) and weights.equal:
                    if len(again := np.repeat(np.arange(len(h)), tf - 1)):  # of a shingle's places each is an element
                        level = np.arange(len(again)) - np.searchsorted(again, again) + 1
                        more = mix64(h[again] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                        element = np.insert(h, again + 1, more)
                        begin = starts + np.searchsorted(again, starts)
                    else:
                        element, begin = h, starts
                    drawn = np.zeros((len(starts), bands * rows), np.uint64)
                    cut = np.searchsorted(begin, np.arange(0, len(element) + 32768, 32768))
                    for a, b in zip(cut[:-1], cut[1:], strict=True):
                        if a < b:
                            s, e = begin[a], begin[b] if b < len(begin) else len(element)
                            drawn[a:b] = minima(element[s:e], begin[a:b] - s, bands * rows)
                elif len(own):
                    drawn = np.zeros((len(starts), bands * rows), np.uint64)
                    weight = weights.told(part)(h, tf)
                    # a few texts at a time: their arrays stay in the cache
                    cut = np.searchsorted(starts, np.arange(0, len(h) + 32768, 32768))
                    for a, b in zip(cut[:-1], cut[1:], strict=True):
                        if a < b:
                            s, e = starts[a], starts[b] if b < len(starts) else len(h)
                            drawn[a:b] = samples(h[s:e], weight[s:e], starts[a:b] - s, bands * rows)
                if len(own):
                    for text, key in zip(own[starts].tolist(), band_keys(drawn, bands, rows), strict=True):
                        keys[text] = key
                size = np.diff(string_buffers(part.column("text"))[0]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(keys, pa.list_(pa.int64())), pa.array(size), pa.array(n_shingles), pa.array(repeats)], ["doc_id", "digest", "bands", "size", "shingles", "repeats"])

    return scan


def connected(edges: DataFrame) -> DataFrame:
    """``node root`` for every node of ``edges`` (a, b): its component's least node.

    Large and small stars in turn (Kiveris et al., 2014): every step is two
    aggregations by min and joins by node, no neighbour list is ever held, and
    the edges are written anew in each step until they stop changing. Centres of
    large stars meet their edges where these lie. Edges that are counted to be
    few, as what is broadcast is, need no steps: one task connects them.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, total = None, now.count()
    if total <= SMALL_LINKS:
        return now.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_connected_here, "node bigint, root bigint")
    for _ in range(MAX_STEPS):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("w"))
        large = join_counted(both, least, ["a"], 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w"))
        small = join_counted(large, low, ["a"], 2 * total).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = saved(small)
        total, *seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if (total, *seen) == state:
            roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        state = (total, *seen)
    raise RuntimeError("components did not settle")


def _connected_here(edges: pa.Table) -> pa.Table:
    nodes, place = np.unique(np.concatenate([edges["a"].to_numpy(), edges["b"].to_numpy()]), return_inverse=True)
    a, b = place[: edges.num_rows], place[edges.num_rows :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(after, end, least)
        after = after[after]
        if (after == root).all():
            return pa.table({"node": nodes, "root": nodes[root]})
        root = after


def join_counted(rows: DataFrame, keys: DataFrame, by: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``keys``, one row for each key; ``w`` says how many of ``rows`` have it.

    Keys that hold over a thousandth of ``total``, the number of all rows, are
    fewer than a thousand: these are named in a filter and their rows meet a
    broadcast, so that no task gets all of one's rows. Keys of several columns
    are told apart by a join instead.
    """
    hot = F.col("w") * 1000 > total
    often = saved(keys.where(hot))
    values = [r[0] for r in often.select(*by).collect()]
    if not values:
        return rows.join(keys, by).drop("w")
    rest = rows.where(~F.col(by[0]).isin(values)) if len(by) == 1 else rows.join(F.broadcast(often.select(*by)), by, "left_anti")
    return rows.join(F.broadcast(often), by).unionByName(rest.join(keys.where(~hot), by)).drop("w")


def compare(texts_a: pa.Array, texts_b: pa.Array | None, weights: Weights, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of weighted Jaccard similarity ``similar`` or more.

    With ``texts_b`` None, pairs inside ``texts_a``. Shingles occurring several
    times count as several features, so that a product of incidence matrices
    sums the minima of weights.
    """
    n = len(texts_a)
    own, h, tf = shingles(Words(pa.chunked_array([texts_a, texts_b]).combine_chunks() if texts_b is not None else texts_a))
    each = weights(h, np.ones(len(h)))
    level = np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf) - tf, tf)
    own, each = np.repeat(own, tf), np.repeat(each, tf)
    feature = mix64(np.repeat(h, tf) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rows = n + (len(texts_b) if texts_b is not None else 0)
    size = np.bincount(own, each, rows)
    # features of one document can't be shared
    _, column, count = np.unique(feature, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    own, each, column = own[shared], each[shared], column[shared]
    order = np.argsort(column, kind="stable")
    own, each, column = own[order], each[order], column[order]
    common = np.zeros((n, rows - n if texts_b is not None else n), np.float64)
    cut = np.r_[np.flatnonzero(np.r_[True, column[1:] != column[:-1]]), len(column)] if len(column) else np.zeros(1, np.int64)
    step = 2048
    for at in range(0, len(cut) - 1, step):
        s, e = cut[at], cut[min(at + step, len(cut) - 1)]
        group = np.cumsum(np.r_[False, column[s + 1 : e] != column[s : e - 1]])
        has = np.zeros((rows, int(group[-1]) + 1), np.float32)
        has[own[s:e], group] = np.sqrt(each[s:e])
        common += has[:n] @ (has[n:] if texts_b is not None else has).T
    a, b = size[:n], size[n:] if texts_b is not None else size
    ratio = common / np.maximum(a[:, None] + b[None] - common, 1e-300)
    i, j = np.nonzero(ratio >= similar - 1e-6)
    return (i, j) if texts_b is not None else (i[i < j], j[i < j])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """As few of the links as connect what they connect."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR, df_floor: float = DF_FLOOR, by_class: bool = False) -> DataFrame:
    """``doc_id class_id class_size digest leads``: one row for each row of ``docs``.

    Documents are linked if their texts are equal, or are candidates whose
    weighted Jaccard similarity is ``similar`` or more; a class is what links
    connect, named by its least non-null doc_id. A null text is alone in its
    class; texts without words are linked to equal texts only. A null doc_id
    gets a class, but names it only if no other member can (then null). Repeated
    rows are members each. ``digest`` is the text's (null for none); ``leads``
    marks one text of each class, the first that has the class's name.

    Copies meet by digest and go on as one text. Texts that share a band are a
    bucket. First all texts of a bucket are compared with its first one; what
    links connect so needs no other comparison. Then those that are in another
    class than most of their bucket are compared with one of these, and those
    that still are with all of the bucket. So no link
    between candidates is lost, and a large group of near copies costs little
    more than its size. Comparisons come in blocks of bounded bytes.

    ``df_floor`` says from which share of the documents on a shingle weighs by
    its own count; 0 gives every shingle its exact idf, for a shuffle of all
    shingles. ``by_class`` does so too (there is no floor then), and counts classes:
    idf is ln(1 + C / df), C the number of classes that equal weights give, df how
    many of them have the shingle. It takes two rounds, one for these classes.
    """
    require_whole_ids(docs)
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = docs.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    held = hashed.where("digest is not null")
    lists = None
    counted = hashed
    if by_class:
        weights = Weights(1, {}, 1.0)
    elif df_floor > 0:
        weights = common_shingles(docs.where("text is not null"), df_floor)
    else:
        weights, lists = Weights(held.count(), {}, 0.0), saved(own_counts(held))
        counted = join_counted(held, lists, ["digest"], weights.docs).unionByName(hashed.where("digest is null"), allowMissingColumns=True)
    drawn = _drawn(counted, weights, bands, rows)
    total = drawn.count()
    texts = saved(drawn.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("lead"), F.count("*").alias("w"), *(F.first(c).alias(c) for c in ("bands", "size", "shingles", "repeats"))).withColumn("n", F.monotonically_increasing_id()))
    classes = _classes(hashed, texts, weights, lists, total * bands, similar)
    if by_class:
        plain, classes = classes, _weighted_classes(hashed, texts, classes, drawn, bands, rows, similar)
        forget(plain)
    member = texts.select("digest", "n", "lead", "w").join(classes.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    named = member.groupBy("root").agg(F.min("lead").alias("class_id"), F.sum("w").alias("class_size"), F.min(F.struct(F.col("lead").isNull().alias("unnamed"), "lead", "digest")).alias("first"), F.count("*").alias("texts"))
    told = join_counted(member.withColumnRenamed("w", "copies"), named.withColumnRenamed("texts", "w"), ["root"], total).select("digest", "class_id", "class_size", (F.col("first.digest") == F.col("digest")).alias("leads"), F.col("copies").alias("w"))
    found = join_counted(drawn.where("digest is not null").select("doc_id", "digest"), saved(told), ["digest"], total).select("doc_id", "class_id", "class_size", "digest", "leads")
    alone = drawn.where("digest is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "digest", F.lit(True).alias("leads"))
    out = saved(found.union(alone))
    for table in (drawn, texts, classes, *([] if lists is None else [lists])):
        forget(table)
    return out


def _weighted_classes(hashed: DataFrame, texts: DataFrame, classes: DataFrame, drawn: DataFrame, bands: int, rows: int, similar: float) -> DataFrame:
    """``node root`` of linked texts by weights that count ``classes``, those of equal weights.

    What texts of two classes share, several classes have. So a text that is
    alone in its class is linked only if such shingles are at least ``similar``
    of its weight. They weigh no more than the others: then they are at least
    that part of its shingles too. All other texts stay alone and need no weights.
    """
    linked, roots, bytes_ = classes.count(), classes.select("root").distinct().count(), drawn.agg(F.sum("size")).first()[0] or 0
    number = texts.count() - linked + roots
    short = lambda *of: F.xxhash64(*of).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
    joined = texts.select("digest", "n").join(classes.withColumnRenamed("node", "n"), "n").select(F.xxhash64("digest").alias("key"), short("root").alias("root"))
    held = hashed.where("digest is not null").select("text", F.xxhash64("digest").alias("key"), short("digest").alias("id"))
    rooted = held.join(broadcast_if_small(joined, SMALL_KEYS), "key", "left").withColumn("root", F.coalesce("root", "id"))
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, bytes_ // 6 // BUCKET_SHINGLES))
    named = texts.select("digest", "lead", "n", "shingles", "repeats", short("digest").alias("id")).join(classes.select(F.col("node").alias("n"), F.lit(True).alias("linked")), "n", "left")
    least = F.when(F.col("linked"), 0).otherwise(F.ceil((similar - 1e-5) * F.col("shingles") - F.col("repeats")))
    found = class_counts(rooted, buckets, named.where("shingles > 0").select("id", least.cast("long").alias("least")))
    none = F.array().cast("array<struct<h:bigint,w:bigint>>")
    lists = named.join(found, "id", "left").where("linked or often is not null").select("digest", "lead", "n", F.coalesce("often", none).alias("often"))
    lists = saved(lists)
    brought = _brought(hashed, lists).join(lists.select("n", "often"), "n")
    whole = saved(brought.withColumn("doc_id", F.lit(None).cast("long")))
    weights = Weights(number, {}, 0.0)
    drawn = _drawn(whole, weights, bands, rows)
    again = saved(texts.drop("bands").join(drawn.select("digest", "bands"), "digest"))
    out = _classes(whole, again, weights, lists, again.count() * bands, similar, whole)
    for table in (lists, whole, drawn, again):
        forget(table)
    return out


def _drawn(rows: DataFrame, weights: Weights, bands: int, each: int) -> DataFrame:
    """Rows with their bands, saved; ``often`` brings the texts' counts of shingles, where they have their own."""
    counts = [c for c in rows.columns if c == "often"]
    schema = "doc_id bigint, digest binary, bands array<bigint>, size int, shingles int, repeats int"
    return saved(rows.select("doc_id", "digest", "text", *counts).mapInArrow(_banded(weights, bands, each), schema))


def _brought(hashed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``n digest text`` of the texts ``wanted`` (digest lead n): the first copy of each brings it.

    Texts that are not wanted are dropped where they lie, be the wanted ones too
    many to travel whole: a number each tells which.
    """
    doc = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")
    rows = hashed.where("text is not null").select(doc, "digest", "text")
    asked = wanted.select(F.coalesce("lead", F.lit(-(1 << 63))).alias("doc"), "digest", "n")
    if is_small(asked):
        asked = F.broadcast(asked)
    else:
        place = F.xxhash64("doc", "digest").alias("place")
        rows = rows.withColumn("place", place).join(broadcast_if_small(asked.select(place), SMALL_KEYS), "place", "left_semi").drop("place")
    return rows.join(asked, ["doc", "digest"]).groupBy("n").agg(F.first("digest").alias("digest"), F.first("text").alias("text"))


def _classes(hashed: DataFrame, texts: DataFrame, weights: Weights, lists: DataFrame | None, total: int, similar: float, whole: DataFrame | None = None) -> DataFrame:
    """``node root`` of linked texts, saved, of ``texts`` (digest lead bands size n); ``total`` is the number of their bands at most.

    ``lists`` (``digest often``) brings the texts' counts of shingles, where they
    have their own; ``whole`` has ``n text often`` of all texts, where that is written.
    """
    # Buckets of several texts; of those with the same texts, one.
    placed = texts.where("bands is not null").select("n", "size", F.explode("bands").alias("key"))
    full = placed.groupBy("key").agg(F.min("n").alias("first"), F.bit_xor(F.xxhash64("n")).alias("mark"), F.count("*").alias("w")).where("w > 1")
    once = saved(full.groupBy("first", "mark", "w").agg(F.min("key").alias("key")).select("key", "first", "w", F.col("w").alias("texts")))
    members = saved(join_counted(placed, once, ["key"], total))
    wanted = members.select("n").distinct().join(texts.select("n", "digest", "lead"), "n")
    written = whole is not None
    if not written:
        whole = _brought(hashed, wanted).drop("digest")
        if lists is not None:
            whole = whole.join(wanted.select("n", "digest").join(lists.select("digest", "often"), "digest").select("n", "often"), "n")
        whole = saved(whole)
    whole = whole.drop("digest", "doc_id")

    stars = members.where("n <> first").select(F.col("first").alias("left"), "n", "size").distinct()
    links = saved(_linked_to_firsts(stars, whole, weights, similar))
    classes = saved(connected(links))
    apart = _apart(members, classes)
    met = (F.col("n") == F.col("first")) | (F.col("lead") == F.col("first"))
    others = apart.where(~met)  # all were compared with the first
    if not others.isEmpty():  # a first text may be unlike the others of its bucket
        links = links.unionByName(saved(_linked_to_firsts(others.select(F.col("lead").alias("left"), "n", "size").distinct(), whole, weights, similar)))
        classes = saved(connected(links))
        apart = _apart(members, classes)
    apart = apart.where("texts > 2")  # two texts were compared
    if not apart.isEmpty():
        links = links.unionByName(_linked_apart(members, apart, whole, weights, similar))
        classes = saved(connected(links))
    for table in (once, members, *([] if written else [whole])):
        forget(table)
    return classes


def _blocks(sizes: DataFrame, by: list[str]) -> DataFrame:
    """``by blocks``: into how many blocks each group's texts go, for groups of more than one."""
    many = F.greatest(F.ceil(F.sum("size") / BLOCK_BYTES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")
    return sizes.groupBy(*by).agg(many.alias("blocks")).where("blocks > 1")


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the ``blocks`` of their group and a ``block``. Groups of several blocks are few; counted to be so, they travel."""
    sized = rows.join(broadcast_if_small(_blocks(rows, by)), by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return sized.withColumn("block", F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int"))


def _linked_to_firsts(stars: DataFrame, whole: DataFrame, weights: Weights, similar: float) -> DataFrame:
    """Links (a, b) of ``stars`` (left, n): each text against the first of its bucket, block by block."""
    dealt = saved(_dealt(stars, ["left"]).select("left", "block", "n"))
    firsts = dealt.select("left", "block").distinct().withColumn("n", F.col("left"))
    rows = dealt.unionByName(firsts).join(whole, "n")

    def verify(_: tuple, table: pa.Table) -> pa.Table:
        left, n, text = table["left"][0].as_py(), table["n"].to_numpy(), table["text"].combine_chunks()
        ours, others = np.flatnonzero(n == left), np.flatnonzero(n != left)
        _, j = compare(text.take(pa.array(ours)), text.take(pa.array(others)), weights.told(table), similar)
        return pa.table({"a": pa.array(n[others[j]]), "b": pa.array(np.full(len(j), left, np.int64))})

    return rows.groupBy("left", "block").applyInArrow(verify, "a bigint, b bigint")


def _apart(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``key n size lead``: texts in another class than most texts of their bucket; ``lead`` is one of these.

    Of two texts of a bucket in different classes one at least is among them.
    What else ``members`` tells of the bucket (its ``first``, ``texts``) is told.
    """
    named = members.join(classes.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("w"), F.min("n").alias("lead"))
    most = sizes.groupBy("key").agg(F.max(F.struct("w", "root", "lead")).alias("most"), F.sum("w").alias("w"))
    met = join_counted(named, most, ["key"], members.count())
    return saved(met.where(F.col("root") != F.col("most.root")).select("key", "n", "size", "most.lead", *(c for c in members.columns if c in ("first", "texts"))))


def _linked_apart(members: DataFrame, apart: DataFrame, whole: DataFrame, weights: Weights, similar: float) -> DataFrame:
    """Links (a, b) between the texts ``apart`` and all texts of their buckets, block by block."""
    rest = members.select("key", "n", "size").join(apart.select("key").distinct(), "key", "left_semi")
    left, right = (saved(_dealt(rows, ["key"]).select("key", "n", "block", "blocks")) for rows in (apart, rest))
    count = lambda rows, name: rows.select("key", F.col("blocks").alias(name)).distinct()
    over = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    ours = left.join(count(right, "turns"), "key").select("key", "n", F.col("block").alias("low"), over("turns").alias("high"), F.lit(True).alias("ours"))
    theirs = right.join(count(left, "turns"), "key").select("key", "n", over("turns").alias("low"), F.col("block").alias("high"), F.lit(False).alias("ours"))
    rows = ours.unionByName(theirs).join(whole, "n")

    def verify(_: tuple, table: pa.Table) -> pa.Table:
        n, text = table["n"].to_numpy(), table["text"].combine_chunks()
        mine = table["ours"].to_numpy()
        x, y = np.flatnonzero(mine), np.flatnonzero(~mine)
        if not len(x) or not len(y):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = compare(text.take(pa.array(x)), text.take(pa.array(y)), weights.told(table), similar)
        kept = [(a, b) for a, b in _forest(n[x[i]].tolist(), n[y[j]].tolist()) if a != b]
        return pa.table({"a": pa.array([a for a, _ in kept], pa.int64()), "b": pa.array([b for _, b in kept], pa.int64())})

    return rows.groupBy("key", "low", "high").applyInArrow(verify, "a bigint, b bigint")


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` with one row of each class; ``classes`` as :func:`near_duplicates` makes them.

    The row of least doc_id stays, a null one only if there is no other; of
    rows that share doc_id and text any one. A doc_id's other texts are judged
    by their own classes. Null texts all stay.
    """
    own = [unused("doc", docs.columns), unused("digest", docs.columns)]
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    first = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    marked = saved(classes.where("digest is not null").select(key.alias(own[0]), F.col("digest").alias(own[1]), first.alias("is_first")).groupBy(*own, "is_first").agg(F.count("*").alias("n")))
    keyed = docs.withColumns({own[0]: key, own[1]: F.unhex(F.md5(F.col("text").cast("binary")))})
    kept = keyed.join(marked.where("not is_first").select(*own), own, "left_anti")
    again = marked.where("is_first and n > 1").select(*own)
    if not again.isEmpty():  # only rows that repeat wholly are dealt by their key
        kept = kept.join(again, own, "left_anti").unionByName(kept.join(again, own, "left_semi").dropDuplicates(own))
    return kept.select(*docs.columns)
