"""Byte-level BPE: ranked merges folded over distinct words, and the way back.

A text is cut into words by the tokenizer's pattern. Each distinct word of a
batch starts as its bytes and folds merges: always the adjacent pair whose
concatenation has the lowest rank, leftmost first. All distinct words fold in
step, as arrays. Decoding concatenates the ids' binary pieces.

``fold_words_native`` states the same fold in Spark's higher-order functions.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_cache

#: A worker forgets its words beyond this many; that costs time, never results.
CACHE_WORDS = 400_000
#: Longer words fold one by one with a heap, in n log n steps.
LONG_WORD = 256

_PLAIN = re.compile(r"[^\t-\r -~\xa1-\xa9\xab-\xae\xb0\xb1\xb4\xb6-\xb8\xbb\xbfÀ-ÖØ-öø-ÿ‐-‧]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
#: The pattern that the fast one stands in for.
_FAST_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int64).max


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class RankedMerges:
    """Encoder and decoder for one rank file and word pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = {rank: token for token, rank in ranks.items()}
        self.fast = pattern == _FAST_FOR
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.pairs = pairs
        self.seen: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if self.fast and _PLAIN.search(text) is None:
            return _FAST.findall(text)
        return self.pattern.findall(text)

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def fold(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(words)
        fold = []
        for n, word in enumerate(words):
            if (whole := self.ranks.get(word)) is not None:
                out[n] = whole.to_bytes(4, "little")
            elif len(word) > LONG_WORD:
                out[n] = self.fold_long(word)
            elif word:
                fold.append(n)
        if not fold:
            return out
        size = np.array([len(words[n]) for n in fold])
        ids = self.byte_ids[np.frombuffer(b"".join(words[n] for n in fold), np.uint8)]
        own = np.repeat(np.arange(len(fold)), size)
        inner = np.r_[own[1:] == own[:-1], False]
        rank = np.full(len(ids), _NONE)
        left = np.flatnonzero(inner)
        rank[left] = self._pair_rank(ids[left], ids[left + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(rank, starts)
            ended = lowest == _NONE
            if ended.any():
                raw = ids.astype("<u4").tobytes()
                for s, k, w in zip(starts[ended].tolist(), size[ended].tolist(), own[starts[ended]].tolist(), strict=True):
                    out[fold[w]] = raw[4 * s : 4 * (s + k)]
                stay = ~np.repeat(ended, size)
                ids, own, rank = ids[stay], own[stay], rank[stay]
                if not len(ids):
                    break
                size, lowest = size[~ended], lowest[~ended]
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            at = at[np.r_[True, own[at[1:]] != own[at[:-1]]]]  # the leftmost in each word
            ids[at] = rank[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))  # where they are once their right halves are gone
            ids, own, rank = ids[stay], own[stay], rank[stay]
            last = len(ids) - 1
            right = np.minimum(at + 1, last)
            rank[at] = np.where((at < last) & (own[right] == own[at]), self._pair_rank(ids[at], ids[right]), _NONE)
            before = np.maximum(at - 1, 0)
            ok = (at > 0) & (own[before] == own[at])
            rank[before[ok]] = self._pair_rank(ids[before[ok]], ids[at[ok]])
        return out

    def fold_long(self, word: bytes) -> bytes:
        """The same fold for one long word, with a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(pairs[k], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in pairs]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        cut = [self.words(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in cut:
            new.update(words)
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen.clear()
        new.difference_update(self.seen)
        distinct = list(new)
        self.seen.update(zip(distinct, self.fold([w.encode("utf-8") for w in distinct]), strict=True))
        ids = self.seen.__getitem__
        return [b"".join(map(ids, words)) for words in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids spell."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def merges(path: str, pattern: str) -> RankedMerges:
    """This worker's encoder for a rank file."""
    return worker_cache(f"merges:{path}:{pattern}", lambda: RankedMerges(read_ranks(path), pattern))


def encode_texts(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (little-endian uint32) of every whole text.

    A null or empty text has no ids. Special tokens do not exist: their strings
    are ordinary text. Every row is encoded where it is read, without a shuffle.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merges(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.encode(part.column(1).to_pylist()), pa.binary())], [key, "ids"])

    return small_batches(docs).select(key, text).mapInArrow(encode, schema)


def decode_ids(ids: Column, ranks: str, pattern: str) -> Column:
    """The binary that little-endian uint32 ``ids`` spell; null stays null."""

    @F.arrow_udf("binary")
    def decode(column: pa.Array) -> pa.Array:
        pieces = merges(ranks, pattern)
        return pa.array([None if x is None else pieces.decode(x) for x in column.to_pylist()], pa.binary())

    return decode(ids)


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id n_tokens ids_sha256 decoded_sha256``: encode, then decode the ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = merges(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return small_batches(docs).select("doc_id", "text").mapInArrow(digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def fold_words_native(words: DataFrame, word: str, ranks: dict[bytes, int], buckets: int = 4096) -> DataFrame:
    """Add ``ids`` to distinct words by higher-order functions alone.

    The rank map is one literal: arrays of small maps, one of which a token's
    hash selects, since a map lookup scans its keys. The fold keeps a word's
    pieces as hex strings and merges the best pair in each step.
    """
    table: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        spelt = token.hex().upper()
        table[int(hashlib.md5(spelt.encode()).hexdigest()[:8], 16) % buckets][spelt] = rank
    literal = F.from_json(F.lit(json.dumps(table)), "array<map<string,int>>")

    def rank_of(spelt: Column) -> Column:
        slot = F.pmod(F.conv(F.substring(F.md5(spelt.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
        return F.try_element_at(F.element_at(literal, slot + 1), spelt)

    def step(pieces: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x, i: F.struct(rank_of(F.concat(x, F.element_at(pieces, i + 2))).alias("r"), i.alias("i")))
        best = F.array_min(F.filter(pairs, lambda p: p.r.isNotNull()))
        i = best.i
        merged = F.concat(F.slice(pieces, 1, i), F.array(F.concat(F.element_at(pieces, i + 1), F.element_at(pieces, i + 2))), F.slice(pieces, i + 3, F.size(pieces)))
        return F.when(best.isNull(), pieces).otherwise(merged)

    spelt = F.hex(F.col(word).cast("binary"))
    size = F.octet_length(word)
    start = F.transform(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.substring(spelt, i * 2 + 1, F.lit(2)))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), start, step)
    whole = rank_of(spelt)
    ids = F.when(size == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, rank_of))
    return words.withColumn("ids", ids)
