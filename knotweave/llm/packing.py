"""Best-fit packing of documents into fixed-length sequences, certified by bounds.

Partitions pack their pieces best-fit decreasing. Dual feasible functions give
each partition a lower bound on its bins, which certifies counts that meet it,
and the bound of all pieces, from a count of each length, says when no packing
can do with fewer sequences: then the work ends. Until then a certified
partition stays as it is, but for its emptiest bin; the others give back all
bins with gaps. What came back is dealt into new partitions of the same size
and packed again, until nothing comes back, one partition holds the rest, a
round closes nothing, or ``ROUNDS`` end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, require_whole_ids, saved, small_batches, unused
from .tokens import word_ids

#: Pieces in one partition of a packing round.
PART_PIECES = 4096
#: A bin whose gap is at most this share of the capacity is closed.
CLOSED_GAP = 1 / 256
ROUNDS = 8

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those over ``capacity`` ids into pieces.

    Each document is its ids followed by ``end_id`` (a null or empty text: just
    that). Pieces come from 0, all ``capacity`` long but the last. ``with_ids``
    adds each piece's ids as little-endian uint32. Columns of ``docs`` beside
    ``doc_id`` and ``text`` are not carried.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        out.append((doc, n, start, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: 5 + with_ids], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)  # noqa: B905

    require_whole_ids(docs)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``count[n]`` items of each length n needs, by dual feasible functions.

    Three families: the identity; the threshold functions that count items over
    capacity - t as whole bins and ignore those under t; and the rounding
    functions floor((k + 1) x / c) / k.
    """
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # threshold functions, all t at once, by suffix sums
    items, mass = np.cumsum(count[::-1])[::-1], np.cumsum((count * size)[::-1])[::-1]
    t = np.arange(1, capacity // 2 + 1)
    whole = items[capacity - t + 1]
    middle = mass[t] - mass[capacity - t + 1]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 41):
        scaled = (k + 1) * size
        f = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-sum(a * b for a, b in zip(count.tolist(), f.tolist(), strict=True)) // (k * capacity)))
    return best


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """:func:`bound_of_counts` of a list of lengths."""
    return bound_of_counts(np.bincount(lengths.astype(np.int64), minlength=capacity + 1), capacity)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the gap of each bin.

    Longest first, each into the bin with the smallest gap that holds it. Open
    bins are kept by gap, and a bit set tells which gaps exist.
    """
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    gaps: list[int] = []
    by_gap: dict[int, list[int]] = {}
    present = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = present >> size
        if fit:
            gap = size + (fit & -fit).bit_length() - 1
            own = by_gap[gap].pop()
            if not by_gap[gap]:
                present &= ~(1 << gap)
        else:
            gap, own = capacity, len(gaps)
            gaps.append(capacity)
        where[i], offset[i] = own, capacity - gap
        left = gap - size
        gaps[own] = left
        if left:
            by_gap.setdefault(left, []).append(own)
            present |= 1 << left
    return where, offset, np.array(gaps, np.int64)


def pack(pieces: DataFrame, capacity: int, part_pieces: int = PART_PIECES) -> DataFrame:
    """Put pieces (a ``length`` of 1 to ``capacity``) into sequences.

    Adds ``sequence_id`` (unique, not dense), ``offset`` (gapless from 0 in each
    sequence) and ``certified`` (its partition's bin count met the lower bound,
    so that nothing in that partition could have used fewer). All other columns
    stay; those three are replaced. An empty table stays empty. Equal lengths
    keep the order they are read in; repeated rows are packed each for itself.

    A round needs one shuffle of pieces without their texts; the next round
    only takes documents of bins with gaps. No partition grows: all have about
    ``part_pieces`` pieces. The driver holds one count for each length.
    """
    rest = pieces.drop("sequence_id", "offset", "certified")
    kept = rest.columns
    part_at, open_at = (unused(n, kept) for n in ("part", "open"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + f", sequence_id bigint, offset bigint, certified boolean, {open_at} boolean"
    rest = saved(rest)
    count = np.zeros(capacity + 1, np.int64)
    for row in rest.groupBy("length").count().collect():
        count[row[0]] = row[1]
    least, left, closed = bound_of_counts(count, capacity), int(count.sum()), 0
    out: DataFrame | None = None
    for turn in range(ROUNDS):
        parts = max(1, -(-left // part_pieces))
        packed = saved(_round(rest, capacity, parts, turn, schema, part_at, open_at))
        forget(rest)
        first, again = F.col("offset") == 0, F.col(open_at)
        bins, open_bins, opened = (n or 0 for n in packed.agg(F.count_if(first), F.count_if(first & again), F.count_if(again)).first())
        last = closed + bins == least or not opened or parts == 1 or opened == left or turn == ROUNDS - 1
        stays = (packed if last else packed.where(~again)).drop(open_at)
        out = stays if out is None else out.unionByName(stays)
        if last:
            break
        rest, left, closed = saved(packed.where(again).select(*kept)), opened, closed + bins - open_bins
    return out


def _round(rest: DataFrame, capacity: int, parts: int, turn: int, schema: str, part_at: str, open_at: str) -> DataFrame:
    def pack_part(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_numpy().astype(np.int64)
        where, offset, gaps = best_fit_decreasing(lengths, capacity)
        certified = len(gaps) == lower_bound(lengths, capacity)
        open_bin = gaps > capacity * CLOSED_GAP
        if certified:
            open_bin &= np.arange(len(gaps)) == gaps.argmax()
        number = ((turn << 28) + key[0].as_py() << 28) + where
        rows = rows.drop_columns(part_at)
        for name, values in (("sequence_id", number), ("offset", offset), ("certified", np.full(len(where), certified)), (open_at, open_bin[where])):
            rows = rows.append_column(name, pa.array(values))
        return rows

    # The seed mixes each round's partitions anew.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts)).cast("int")
    return rest.withColumn(part_at, part).groupBy(part_at).applyInArrow(pack_part, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row for each piece with its place."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence, its pieces' ids concatenated: needs ``ids``.

    A sequence has ``capacity`` ids at most, which bounds the group.
    """
    pieces = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    out = packed.groupBy("sequence_id").agg(pieces.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x.ids))
    return out.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x.doc_id).alias("doc_ids"))
