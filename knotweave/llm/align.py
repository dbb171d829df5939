"""Alignment of two tokenizers by a sweep over the ends of their tokens.

Each text is encoded by a byte-level tokenizer (A) and a piece tokenizer (B);
every token is an event at the byte where it ends. The events of both sides,
blocks of them to a row, are dealt by document, sorted by offset, and streamed
through a machine that holds what neither side has closed yet. Where both sides
have an end, a group is complete; between two neighbouring ends one A token and
one B token overlap, which is a link, and each link is one such stretch.

The links of all documents are counted by pair of ids, and the counts come back
to the documents.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotweave import storage

from .bpe import _FAST, _PLAIN
from .common import forget, require_whole_ids, saved, small_batches, worker_cache
from .tokens import byte_letters

#: Events in one row, and bytes of results that a task holds before it passes them on.
BLOCK_EVENTS, OUT_BYTES = 4096, 4 << 20
#: A worker forgets its words beyond this many, and words longer than this at once.
CACHE_WORDS, LONG_WORD = 400_000, 256
SPACE = "▁"


class Known(dict):
    """What words are spelt as, told once for each: a token is 4 bytes, 3 of its id and 1 of its length.

    None for words whose tokens' bytes are not theirs.
    """

    def __init__(self, side: Side):
        super().__init__()
        self.side = side

    def __missing__(self, word: str) -> bytes | None:
        side = self.side
        ids = side.ids(word)
        right = ids is not None and b"".join([side.spelt[i] for i in ids]) == word.encode("utf-8")
        told = struct.pack(f"<{len(ids)}I", *[side.codes[i] for i in ids]) if right else None
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = told
        return told


class Side:
    """One tokenizer: texts are cut into words that it encodes independently, each distinct word once.

    ``spelt``: the bytes of each id.
    """

    def __init__(self, spelt: list[bytes]):
        if len(spelt) > 1 << 24 or max(map(len, spelt)) > 255:
            raise ValueError("ids beyond 24 bits or tokens beyond 255 bytes")
        self.spelt, self.codes = spelt, [i | len(s) << 24 for i, s in enumerate(spelt)]
        self.known = Known(self)

    def words(self, text: str) -> list[str]:
        raise NotImplementedError

    def ids(self, word: str) -> list[int] | None:
        """Ids of a word; None for what can't be one."""
        raise NotImplementedError

    def encode(self, text: str) -> np.ndarray | None:
        """The tokens of a space and ``text``; None where the tokens' bytes are not the text's."""
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, self.words(" " + text))), "<u4")
        except TypeError:  # a None among the joined
            return None


class ByteSide(Side):
    """A byte-level ``tokenizers`` file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.normalizer is not None:
            raise ValueError("a tokenizer with a normalizer does not keep the text's bytes")
        self.letters = byte_letters()
        self.bytes_of = {ord(c): b for b, c in self.letters.items()}
        spelt = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            spelt[i] = token.translate(self.bytes_of).encode("latin-1")
        super().__init__(spelt)

    def words(self, text: str) -> list[str]:
        if _PLAIN.search(text) is None:
            return _FAST.findall(text)
        cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [spelt.translate(self.bytes_of).encode("latin-1").decode("utf-8") for spelt, _ in cuts]

    def ids(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))]


class PieceSide(Side):
    """A ``sentencepiece`` file that puts a space before a text.

    If no piece has a space after another character, merges can't pass the place
    between a character and the space after it: texts are cut there. A file with
    such pieces encodes whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        many = range(self.model.get_piece_size())
        pieces = [self.model.id_to_piece(i) for i in many]
        spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode("utf-8") for i, p in zip(many, pieces, strict=True)]
        super().__init__(spelt)
        kept = self.model.encode("  a  b ", out_type=str)
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces) and "".join(kept) == f"{SPACE * 3}a{SPACE * 2}b{SPACE}"
        self.cut = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")

    def words(self, text: str) -> list[str]:
        return self.cut.findall(text) if self.cuts else [text]

    def ids(self, word: str) -> list[int] | None:
        if not word.startswith(" "):
            return None  # it begins with the mark of a space, which is spelt as one: bytes differ
        if word == " ":  # an empty text gets no space: tell it after a letter
            return self.model.encode("a ")[len(self.model.encode("a")) :]
        return self.model.encode(word[1:])


def sides(path_a: str, path_b: str) -> tuple[ByteSide, PieceSide]:
    """This worker's tokenizers."""
    return worker_cache(f"align:{path_a}:{path_b}", lambda: (ByteSide(path_a), PieceSide(path_b)))


class Sweep:
    """The machine for one document: events in, groups and links out.

    Held between two steps: the tokens after the last common end, a running
    hash, and the counts of the document's links.
    """

    #: Texts of all ids so far with what may follow: another of the side, the other side, the next group.
    marks = np.zeros(0, "S1")

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.ids, self.ends, self.sizes = [none, none], [none, none], [0, 0]
        self.n = [0, 0]
        self.groups, self.hash = 0, hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def take(self, side: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        ends = self.sizes[side] + np.cumsum(lengths, dtype=np.int64)
        self.sizes[side] = int(ends[-1])
        held = len(self.ids[side])
        self.ids[side] = np.concatenate([self.ids[side], ids]) if held else ids.astype(np.int64)
        self.ends[side] = np.concatenate([self.ends[side], ends]) if held else ends
        self.n[side] += len(ids)
        if len(self.ids[1 - side]):
            self._close()

    def _close(self) -> None:
        """Emit all groups whose ends both sides have reached."""
        (ids_a, ids_b), (a, b) = self.ids, self.ends
        at_b, at_a = np.searchsorted(b, a), np.searchsorted(a, b)
        shut_a = b[np.minimum(at_b, len(b) - 1)] == a  # tokens that end where one of the other side does
        shut_b = a[np.minimum(at_a, len(a) - 1)] == b
        last_a, last_b = np.flatnonzero(shut_a), np.flatnonzero(shut_b)
        if not len(last_a):
            return
        cut_a, cut_b = last_a[-1] + 1, last_b[-1] + 1
        self.ids, self.ends = [ids_a[cut_a:], ids_b[cut_b:]], [a[cut_a:], b[cut_b:]]
        ids_a, ids_b, shut_a, shut_b, at_a, at_b = ids_a[:cut_a], ids_b[:cut_b], shut_a[:cut_a], shut_b[:cut_b], at_a[:cut_b], at_b[:cut_a]
        # a group's A tokens stand after all B tokens of the groups before, its B tokens after its own A tokens
        order = np.empty(cut_a + cut_b, np.int64)
        order[np.arange(cut_a) + np.r_[0, last_b + 1][np.cumsum(shut_a) - shut_a]] = ids_a * 3 + shut_a
        order[np.arange(cut_b) + last_a[np.cumsum(shut_b) - shut_b] + 1] = ids_b * 3 + 2 * shut_b
        most = int(order.max())
        if most >= len(self.marks):
            Sweep.marks = np.array([f"{n}{mark}" for n in range(most // 3 + 1) for mark in ",|;"], "S")
        text = self.marks[order].tobytes().replace(b"\0", b"")
        self.hash.update((b";" if self.groups else b"") + text[:-1])
        self.groups += len(last_a)
        # each end closes one stretch, in which one token of either side lies
        pair = np.concatenate([ids_a << 32 | ids_b[at_b], (ids_a[at_a] << 32 | ids_b)[~shut_b]])
        self.pairs.append(np.unique(pair, return_counts=True))
        if len(self.pairs) > 8:
            self.pairs = [self.links()]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The different pairs of ids, and how often each is linked."""
        if len(self.pairs) == 1:
            return self.pairs[0]
        pair = np.concatenate([p for p, _ in self.pairs]) if self.pairs else np.zeros(0, np.int64)
        told, own = np.unique(pair, return_inverse=True)
        return told, np.bincount(own, np.concatenate([c for _, c in self.pairs]), len(told)).astype(np.int64) if len(told) else np.zeros(0, np.int64)

    def row(self) -> tuple:
        pair, times = self.links()
        return self.n[0], self.n[1], self.groups, int(times.sum()), self.hash.hexdigest() if self.groups else "", pair, times


def token_events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``rid side start ids lengths doc_id``: blocks of end events of both sides, and one row that opens each document.

    Two rows of one doc_id are two documents. A text that is null or empty, or
    whose tokens' bytes are not a space and the text, has no events.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(path_a, path_b)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for rid, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((rid, -1, -1, None, None, doc))
                coded = [side.encode(text) for side in (side_a, side_b)] if text else [None, None]
                if coded[0] is not None and coded[1] is not None:
                    for side, tokens in enumerate(coded):
                        ids, lengths = tokens & np.uint32((1 << 24) - 1), (tokens >> np.uint32(24)).astype(np.uint8)
                        narrow = "<u2" if ids.max() < 1 << 16 else "<u4"
                        ids = ids.astype(narrow)
                        starts = np.cumsum(lengths, dtype=np.int64)[::BLOCK_EVENTS] - lengths[::BLOCK_EVENTS]
                        for n, start in enumerate(starts.tolist()):
                            part = slice(n * BLOCK_EVENTS, (n + 1) * BLOCK_EVENTS)
                            rows.append((rid, side, start, ids[part].tobytes(), lengths[part].tobytes(), None))
                            held += len(rows[-1][3]) + len(rows[-1][4])
                if held > OUT_BYTES or len(rows) > 4096:
                    yield _events(rows)
                    rows, held = [], 0
        if rows:
            yield _events(rows)

    picked = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return small_batches(picked).mapInArrow(encode, "rid bigint, side int, start bigint, ids binary, lengths binary, doc_id bigint")


def _events(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["rid", "side", "start", "ids", "lengths", "doc_id"])


_SWEPT = "rid bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"


def swept(events: DataFrame) -> DataFrame:
    """One row for each document of ``events``: its counts, its groups' hash, its links by pair of ids."""

    def machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rid, doc = None, None, None
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for own, side, _, ids, lengths, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != rid:
                    if now is not None:
                        out.append((rid, doc, *now.row()))
                        held += 16 * len(out[-1][7]) + 128
                        if held > OUT_BYTES:
                            yield _documents(out)
                            out, held = [], 0
                    now, rid, doc = Sweep(), own, name
                if side >= 0:
                    now.take(side, np.frombuffer(ids, f"<u{len(ids) // len(lengths)}"), np.frombuffer(lengths, np.uint8))
        if now is not None:
            out.append((rid, doc, *now.row()))
        if out:
            yield _documents(out)

    return events.repartition(F.col("rid")).sortWithinPartitions("rid", "start", "side").mapInArrow(machine, _SWEPT)


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    cut = pa.array(np.cumsum([0, *(len(p) for p in columns[7])]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(c).astype(np.int64))) for c in columns[7:]]
    kinds = [pa.int64()] * 6 + [pa.string()]
    names = [part.split(" ")[0] for part in _SWEPT.split(", ")]
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns[:7], kinds, strict=True)), *lists], names)


def pair_counts(documents: DataFrame) -> DataFrame:
    """``pair n``: in how many documents each pair of ids is linked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    return documents.select("pairs").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, rows: int) -> int:
    """The least power of two so that at most ``rows`` pairs have that count or more."""
    level = F.floor(F.log2(F.col("n") + 0.5)).cast("int")
    sizes = {r.level: r.many for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("many")).collect()}
    total, least = 0, max(sizes, default=0) + 1
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > rows:
            break
        least = at
    return 1 << least


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256`` of every row of ``docs``.

    ``path_a`` is a byte-level ``tokenizers`` file, ``path_b`` a
    ``sentencepiece`` file; both read a space and the text. Byte offsets where
    both have an end cut the tokens into groups; a link is a pair of an A and a
    B token whose bytes overlap. A pair of ids counts once for each document
    that has it linked; ``n_best`` are the links whose count is the highest of
    their A id, ``count_sum`` the sum of all links' counts.

    Texts that are null or empty, or that a tokenizer does not give back byte by
    byte, have zeros and an empty hash. Repeated rows and doc_ids, null ones too,
    are documents each; an empty table stays empty. Only ``doc_id`` and ``text``
    are looked at.

    Counts of the commonest pairs are broadcast, at most ``storage.SMALL_ROWS``;
    links of rarer pairs meet theirs in a join, where no pair is common. Highest
    counts by A id are no more than the vocabulary.
    """
    require_whole_ids(docs)
    documents = saved(swept(token_events(docs, path_a, path_b)))
    counts = saved(pair_counts(documents))
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    told = saved(counts.join(F.broadcast(highest), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    least = _frequent(told, storage.SMALL_ROWS)
    links = documents.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("rid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    common = F.broadcast(told.where(F.col("n") >= least))
    met = links.join(common, "pair").unionByName(links.join(common.select("pair"), "pair", "left_anti").join(told.where(F.col("n") < least), "pair"))
    sums = met.groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    out = saved(documents.drop("pairs", "times").join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"))
    for table in (documents, counts, told):
        forget(table)
    return out
