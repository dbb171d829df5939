"""Removal of passages that occur earlier, by level-wise doubling.

Windows that repeat at one length alone are looked at again at twice that
length, until the length asked for is reached or no candidate survives.

Below the last length not every window is listed. Of a long window's short
ones, the one with the least hash stands for it (its minimizer): equal long
windows have equal minimizers, so a long window can only repeat where its
minimizer does. That keeps about 2 / (width + 1) of all places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require_whole_ids, small_batches
from .words import Words, chunks, sliding_argmin

#: Where a null doc_id stands in the order of documents.
NULL_ID = -(1 << 63)
#: Tasks that the copies of one text are dealt to.
SALTS = 32
#: Rows that a task gathers before it tells repeats from first places: a passage
#: that all documents share sends one row for so many, not one for each text.
GATHER_ROWS = 1 << 18


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def minimizers(words: Words, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, place of its minimizer, hash at every place)."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.uint64)
    value = np.full(n, np.iinfo(np.uint64).max)
    start, own = words.grams(length)
    value[start] = own
    least = sliding_argmin(value, window - length + 1)
    windows = np.flatnonzero(words.left >= window)
    return windows, least[windows], value


def survivors(words: Words, part: pa.RecordBatch, window: int, length: int) -> np.ndarray:
    """Starts of the windows whose minimizer of ``length`` words is in ``repeated``."""
    starts, place, value = minimizers(words, window, length)
    lists = part.column("repeated")
    size = np.asarray(lists.value_lengths().fill_null(0))
    own, told = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy().view(np.uint64)
    if not len(told) or not len(starts):
        return starts[:0]
    told_key, key = np.unique(_join(own, told)), _join(words.text[place], value[place])
    return starts[told_key[np.minimum(np.searchsorted(told_key, key), len(told_key) - 1)] == key]


def _gathered(rows: Iterator[tuple], settle) -> Iterator[pa.RecordBatch]:
    """What ``settle`` makes of columns that come in pieces, ``GATHER_ROWS`` rows or more at a time."""
    held: list[tuple] = []
    for piece in rows:
        held.append(piece)
        if sum(len(p[0]) for p in held) >= GATHER_ROWS:
            yield from settle(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield from settle(*map(np.concatenate, zip(*held, strict=True)))


def _anchors(window: int, length: int, before: int | None):
    """Rows (h, row, c, salt): minimizers of each text's windows that still stand.

    At the first length these are all windows, later those whose minimizer of
    the length ``before`` repeats. Of what is gathered, one row of a hash says
    that it repeats; those of its other texts need nobody else, so their salt
    sends them anywhere.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                starts, place, value = minimizers(words, window, length)
                if before:
                    place = place[np.isin(starts, survivors(words, part, window, before))]
                place = np.unique(place)
                if len(place):
                    yield value[place].view(np.int64), part.column("row").to_numpy()[words.text[place]]

    def settle(h: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((row, h))
        h, row = h[order], row[order]
        new = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        once = new | np.r_[True, row[1:] != row[:-1]]  # a text names a hash once
        c = np.where(many, 2, 1).astype(np.int32)
        salt = np.where(new, 0, row)
        yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (h, row, c, salt)], ["h", "row", "c", "salt"])

    return lambda batches: _gathered(read(batches), settle)


def _windows(window: int, length: int):
    """Rows (k1, k2, row, doc, pos, n, known) of windows whose minimizer repeats.

    Of a window that is gathered more than once, only its first place competes
    for the first place of all. The others have lost: they come as runs of ``n``
    windows, known.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                starts = survivors(words, part, window, length)
                if len(starts):
                    k1 = words.runs(starts, starts + window, 0).view(np.int64)
                    k2 = (words.runs(starts, starts + window, 1) >> np.uint64(33)).astype(np.int32)
                    row, doc = (part.column(c).to_numpy()[words.text[starts]] for c in ("row", "doc"))
                    yield k1, k2, row, doc, (starts - words.begin[words.text[starts]]).astype(np.int32)

    def settle(k1: np.ndarray, k2: np.ndarray, row: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((row, pos, doc, k2, k1))
        same = np.r_[False, (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])]
        first = np.maximum.accumulate(np.where(~same, np.arange(len(order)), 0))
        # texts of one doc_id and place share it: neither is earlier, and all compete
        tied = (doc[order] == doc[order][first]) & (pos[order] == pos[order][first])
        again = same & np.r_[False, row[order][1:] == row[order][:-1]]
        keep, lost = np.zeros(len(order), bool), np.zeros(len(order), bool)
        keep[order], lost[order] = ~same | (tied & ~again), same & ~tied
        yield _rows(k1[keep], k2[keep], row[keep], doc[keep], pos[keep], np.ones(int(keep.sum()), np.int32), False)
        if lost.any():
            at = np.flatnonzero(lost)
            cut = np.r_[True, (np.diff(at) != 1) | (np.diff(pos[at]) != 1) | (np.diff(row[at]) != 0)]
            run = np.flatnonzero(cut)
            n = np.diff(np.r_[run, len(at)]).astype(np.int32)
            a = at[run]
            yield _rows(_join(row[a], pos[a].astype(np.uint64)).view(np.int64), n, row[a], doc[a], pos[a], n, True)

    return lambda batches: _gathered(read(batches), settle)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit number for each pair."""
    return (a.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ b


def _rows(k1, k2, row, doc, pos, n, known) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, row, doc, pos, n, np.full(len(k1), known))], ["k1", "k2", "row", "doc", "pos", "n", "known"])


def repeated_windows(docs: DataFrame, window: int, start: int | None = None) -> DataFrame:
    """``row places all``: windows of each text whose words also start earlier.

    ``places`` lists runs ``(pos, n)``: the windows that start at words pos to
    pos + n - 1. ``all`` marks whole copies of an earlier document, whose every
    window is one. ``docs`` has ``row doc text``: ``doc`` is the place in the order, and
    ``row`` stands for a doc and its text, which rows of one doc may not share.
    Lengths double from
    ``start`` (half a window, unless given) to the window; a level without
    survivors leaves the next ones empty.
    """
    # Whole copies: all their windows lie in the first copy. They leave here.
    digest = docs.where("text is not null").select("row", "doc", F.md5(F.col("text").cast("binary")).alias("d"))
    first = digest.groupBy("d").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    # Copies of one text may be a third of all documents: they meet their first
    # one in as many tasks as there are salts.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = digest.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(first.withColumn("salt", salts), ["d", "salt"]).where("doc > first").groupBy("row").agg(F.lit(True).alias("all"))

    # One shuffle of the texts serves every later level: the plans share it.
    by_key = docs.select("row", "doc", "text").repartition("row")
    length, before, standing = start or max(1, window // 2), None, docs
    while True:
        anchors = standing.mapInArrow(_anchors(window, length, before), "h bigint, row bigint, c int, salt bigint")
        repeats = anchors.withColumn("s", F.sum("c").over(Window.partitionBy("h", "salt"))).where("s > 1")
        found = repeats.groupBy("row").agg(F.collect_set("h").alias("repeated"))
        if not before:
            found = found.join(copies, "row", "left_anti")
        standing = by_key.join(found.hint("shuffle_hash"), "row").select("row", "doc", "text", "repeated")
        if length * 2 >= window:
            break
        length, before = length * 2, length

    rows = standing.mapInArrow(_windows(window, length), "k1 bigint, k2 int, row bigint, doc bigint, pos int, n int, known boolean")
    place = F.rank().over(Window.partitionBy("k1", "k2").orderBy("doc", "pos"))
    lost = rows.withColumn("place", place).where("known or place > 1")
    places = lost.groupBy("row").agg(F.collect_list(F.struct("pos", "n")).alias("places"))
    return places.select("row", "places", F.lit(False).alias("all")).unionByName(copies.select("row", F.array().cast("array<struct<pos:int,n:int>>").alias("places"), "all"))


def _uncovered(runs: list[dict], window: int, n: int) -> list[bool]:
    """Which of n words no run of windows covers."""
    cover = np.zeros(n + 1, np.int32)
    for run in runs:
        a, b = run["pos"], run["pos"] + run["n"] - 1 + window
        cover[a] += 1
        cover[b] -= 1
    return (np.cumsum(cover[:n]) == 0).tolist()


def remove_repeats(docs: DataFrame, window: int = 20, start: int | None = None, rejoin: bool = False) -> DataFrame:
    """``docs`` without the words that repeated windows cover.

    A window is ``window`` consecutive words (runs of bytes other than
    0x20 and 0x09 to 0x0D) of one document. A word goes if a window over it has
    words that also start earlier: in a document of smaller ``doc_id``, or in
    the same one before. All windows are judged on the input. Adds ``n_words``
    and ``n_removed`` (replacing such columns); all other columns stay.

    A text that loses words becomes its kept words, joined by one space; others
    stay as they are, unless ``rejoin`` asks for the joined words of all. A
    null text has no words and stays null. A null ``doc_id`` comes before all
    others. Rows of one ``doc_id`` are one place in the order: none of them is
    earlier than another but by its start, and each loses its own words only.
    An empty table stays empty. Ids that are no whole numbers are an error.
    """
    require_whole_ids(docs)
    docs = small_batches(docs).drop("n_words", "n_removed")
    # a caller's columns go by number meanwhile: no name of theirs can be one of the levels'
    names = docs.columns
    inner = [f"own{n}" for n in range(len(names))]
    keyed = docs.select(*(F.col(f"`{n}`").alias(own) for n, own in zip(names, inner, strict=True)), _key("doc_id").alias("doc"), "text", F.xxhash64(_key("doc_id"), "text").alias("row"))
    texts = keyed.select("row", "doc", "text")
    removed = repeated_windows(texts, window, start)
    if docs.columns == ["doc_id", "text"]:  # this shuffle then is the levels' own
        whole = texts.repartition("row").withColumn("doc_id", F.when(F.col("doc") != NULL_ID, F.col("doc")).cast(docs.schema["doc_id"].dataType))
        whole = whole.withColumnsRenamed({"doc_id": inner[0], "text": inner[1]})
    else:
        whole = keyed.select(*inner, "row").repartition("row")
    whole = whole.join(removed.hint("shuffle_hash"), "row", "left")
    kept = [f for f in docs.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_words bigint, n_removed bigint"
    text_at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 512):
                batch = whole_batch.slice(at, 512)
                texts, places, whole_copy = (batch.column(c).to_pylist() for c in (inner[text_at], "places", "all"))
                out, count, gone = [], [], []
                for text, runs, copy in zip(texts, places, whole_copy, strict=True):
                    words = text.encode("utf-8").split() if text else []
                    n = len(words)
                    if copy and n >= window:
                        words = []
                    elif runs:
                        words = [w for w, on in zip(words, _uncovered(runs, window, n), strict=True) if on]
                    out.append(text if text is None or (len(words) == n and not rejoin) else b" ".join(words).decode("utf-8"))
                    count.append(n)
                    gone.append(n - len(words))
                columns = [batch.column(c) for c in inner]
                columns[text_at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_words", "n_removed"])

    return whole.select(*inner, "places", "all").mapInArrow(cut, schema)
