"""Product codes of vectors: Lloyd's rounds in whole numbers, spared by Hamerly's bounds.

Hamerly, "Making k-means even faster" (2010): of each part of a vector an upper
bound of the distance to its own entry and a lower bound of that to the second
nearest are kept. After the entries moved, both are loosened by the moves. Only
where the upper bound is not strictly below the lower one is the own distance
computed again, and only if that doesn't help are all entries scanned. Strictly
below means that no other entry is as near, so ties keep the lower index.

Distances are whole numbers, and sums are exact; bounds are floats that are
rounded outwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved, small_batches
from .neardup import join_counted

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Parts that one step of arrays compares with all entries.
STEP = 8192
_MOST = np.finfo(np.float32).max


def _narrow(x: np.ndarray, up: bool) -> np.ndarray:
    """Doubles as floats that are no smaller (``up``) or no larger."""
    x = np.clip(x, -_MOST if up else -np.inf, np.inf if up else _MOST)
    with np.errstate(over="ignore"):
        out = x.astype(np.float32)
        return np.nextafter(out, np.float32(np.inf if up else -np.inf))


def _roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots of whole numbers, as doubles rounded up or down."""
    with np.errstate(over="ignore"):
        x = np.sqrt(np.array([float(v) if v < 1 << 1000 else np.inf for v in squares.ravel().tolist()]).reshape(squares.shape) if squares.dtype == object else squares.astype(np.float64))
    return np.nextafter(x * (1 + 1e-12 if up else 1 - 1e-12), np.inf if up else 0)


@dataclass
class Book:
    """The entries of all part positions for vectors of one length: [part, entry, component]."""

    entries: np.ndarray
    #: How far each entry moved in the last round, rounded up; None before the first.
    moved: np.ndarray | None = None

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """[part, entry]: exact squared distances of parts at one position."""
    if parts.dtype == object:
        return ((parts[:, None] - entries[None]) ** 2).sum(2) if parts.shape[1] else np.zeros((len(parts), len(entries)), object)
    if max(np.abs(parts).max(initial=0), np.abs(entries).max(initial=0)) ** 2 * max(parts.shape[1], 1) < 1 << 50:
        a, b = parts.astype(np.float64), entries.astype(np.float64)  # all sums are whole doubles
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return ((parts[:, None] - entries[None]) ** 2).sum(2)


def own_squared(parts: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distance of each part to its own entry."""
    gap = parts - entries[code]
    return (gap * gap).sum(1) if parts.shape[1] else np.zeros(len(parts), parts.dtype)


class State:
    """What is kept of some vectors' parts: ``code`` (own entry), ``upper`` and ``lower``, each [vector, part]."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.code, self.upper, self.lower = code, upper, lower

    @classmethod
    def unknown(cls, rows: int, parts: int) -> State:
        return cls(np.zeros((rows, parts), np.uint8), np.full((rows, parts), np.inf, np.float32), np.full((rows, parts), -np.inf, np.float32))


def assign(vectors: np.ndarray, book: Book, state: State) -> int:
    """Assign every part of ``vectors`` ([vector, part, component]) to its nearest entry.

    ``state`` is brought up to date; returns how many parts met all entries.
    """
    scanned = 0
    for p in range(vectors.shape[1]):
        entries, code = book.entries[p], state.code[:, p]
        upper, lower = state.upper[:, p], state.lower[:, p]
        if book.moved is not None:
            move = book.moved[p]
            far = np.argsort(move)[::-1]
            others = np.where(code == far[0], move[far[1]] if len(move) > 1 else 0.0, move[far[0]])
            upper = _narrow(upper.astype(np.float64) + move[code], True)
            lower = _narrow(lower.astype(np.float64) - others, False)
            near = np.flatnonzero(~(upper < lower) & np.isfinite(lower))
            upper[near] = _narrow(_roots(own_squared(vectors[near, p], entries, code[near]), True), True)
        failed = np.flatnonzero(~(upper < lower))
        scanned += len(failed)
        for at in range(0, len(failed), STEP):
            rows = failed[at : at + STEP]
            d = squared(vectors[rows, p], entries)
            best = d.argmin(1)
            own = d[np.arange(len(rows)), best]
            code[rows] = best
            upper[rows] = _narrow(_roots(own, True), True)
            if d.shape[1] > 1:
                d[np.arange(len(rows)), best] = d.max(1)
                lower[rows] = _narrow(_roots(d.min(1), False), False)
            else:
                lower[rows] = np.inf
        state.code[:, p], state.upper[:, p], state.lower[:, p] = code, upper, lower
    return scanned


def _parted(raw: list[bytes], dim: int, parts: int, wide: str) -> np.ndarray:
    """[vector, part, component] of stored vectors; a length that isn't a multiple of ``parts`` is filled up with zeros."""
    x = np.frombuffer(b"".join(raw), wide).reshape(len(raw), dim)
    if wide == "<f8":
        x = np.array([[int(c) for c in row] for row in x.tolist()], object).reshape(len(raw), dim)
    else:
        x = x.astype(np.int64)
    short = -dim % parts
    if short:
        x = np.concatenate([x, np.zeros((len(raw), short), x.dtype)], 1)
    return x.reshape(len(raw), parts, (dim + short) // parts)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield batch.filter(pa.array(dims == dim)), dim


def _whole_numbers(rows: DataFrame, scale: int) -> tuple[DataFrame, str]:
    """``key label dim v``: floor(scale * x) of usable vectors, in the narrowest kind that holds all; and that kind."""
    most, longest = rows.agg(F.max(F.array_max(F.transform("x", lambda c: F.abs(c)))), F.max(F.size("x"))).first()
    most = most or 0.0
    if not np.isfinite(most * scale):
        raise OverflowError("a component times the scale is beyond a double")
    top = most * scale + 1
    # where a sum of squares may pass 64 bits: doubles on disk, Python's integers in use
    safe = 4 * top * top * (longest or 1) < 1 << 62
    wide = "<i2" if safe and top < 1 << 15 else "<i4" if safe and top < 1 << 31 else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            x = lists.values.to_numpy(zero_copy_only=False).astype("<f8")[at[0] : at[-1]]
            x = (np.floor(scale * x) + 0.0).astype(wide)
            ends = ((at - at[0]) * x.itemsize).astype(np.int32)
            v = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int32)), v], ["key", "label", "dim", "v"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("key", "label", "x").mapInArrow(pack, f"key bigint, label {label}, dim int, v binary"), wide


def first_books(table: DataFrame, parts: int, entries: int, wide: str) -> dict[int, Book]:
    """For each length of vectors the book that begins with those of the ``entries`` smallest keys.

    Of a key with several vectors the least by its bytes begins; a null key
    comes after all others. Each task tells its own smallest keys first.
    """

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[tuple[bool, int], bytes]] = {}
        for batch, dim in _by_length(batches):
            mine = held.setdefault(dim, {})
            keys = [(k is None, k or 0) for k in batch.column("key").to_pylist()]
            limit = max(mine) if len(mine) >= entries else None
            for key, v in zip(keys, batch.column("v").to_pylist(), strict=True):
                if limit is None or key <= limit:
                    mine[key] = min(v, mine.get(key, v))
                    if len(mine) > 2 * entries:
                        held[dim] = mine = dict(sorted(mine.items())[:entries])
                        limit = max(mine)
            held[dim] = dict(sorted(mine.items())[:entries])
        rows = [(d, None if null else key, v) for d, mine in held.items() for (null, key), v in mine.items()]
        if rows:
            d, key, v = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(key, pa.int64()), pa.array(v, pa.binary())], ["dim", "key", "v"])

    told = table.select("dim", "key", "v").mapInArrow(smallest, "dim int, key bigint, v binary").groupBy("dim", "key").agg(F.min("v").alias("v"))
    order = Window.partitionBy("dim").orderBy(F.col("key").asc_nulls_last())
    first = told.withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries).collect()
    raw: dict[int, list[bytes]] = {}
    for row in sorted(first, key=lambda r: (r.dim, r.place)):
        raw.setdefault(row.dim, []).append(bytes(row.v))
    return {dim: Book(np.ascontiguousarray(_parted(v, dim, parts, wide).transpose(1, 0, 2))) for dim, v in raw.items()}


def assigned(table: DataFrame, books: dict[int, Book], wide: str) -> DataFrame:
    """``table`` with the state of every part after one assignment; it may hold an earlier state."""
    kept = "code" in table.columns
    label = table.schema["label"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, dim in _by_length(batches):
            rows, book = batch.num_rows, books[dim]
            parts = book.entries.shape[0]
            x = _parted(batch.column("v").to_pylist(), dim, parts, wide)
            if kept:
                code, upper, lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(rows, parts).copy() for c, kind in (("code", np.uint8), ("upper", "<f4"), ("lower", "<f4")))
                state = State(code, upper, lower)
            else:
                state = State.unknown(rows, parts)
            assign(x, book, state)
            told = [pa.array([r.tobytes() for r in s], pa.binary()) for s in (state.code, state.upper.astype("<f4"), state.lower.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "label", "dim", "v")), *told], ["key", "label", "dim", "v", "code", "upper", "lower"])

    return table.mapInArrow(step, f"key bigint, label {label}, dim int, v binary, code binary, upper binary, lower binary")


def moved_books(table: DataFrame, books: dict[int, Book], wide: str) -> dict[int, Book]:
    """Every entry at the floor of its parts' mean; unused ones stay.

    Each task adds up its own parts; the sums of all tasks meet by entry.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch, dim in _by_length(batches):
            entries = books[dim].entries
            parts, many, size = entries.shape
            total, count = held.setdefault(dim, (np.zeros((parts * many, size), object), np.zeros(parts * many, np.int64)))
            x = _parted(batch.column("v").to_pylist(), dim, parts, wide)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            place = (code + many * np.arange(parts)).ravel()
            order = np.argsort(place, kind="stable")
            cut = np.flatnonzero(np.r_[True, np.diff(place[order]) != 0])
            if size:
                total[place[order][cut]] += np.add.reduceat(x.reshape(-1, size)[order], cut, axis=0).astype(object)
            count += np.bincount(place, minlength=parts * many)
        for dim, (total, count) in held.items():
            used = np.flatnonzero(count)
            size = total.shape[1]
            values = [Decimal(int(v)) for v in total[used].ravel().tolist()] if size else [Decimal(0)] * len(used)
            wide_rows = max(size, 1)
            columns = [pa.array(np.full(len(values), dim, np.int32)), pa.array(np.repeat(used, wide_rows)), pa.array(np.tile(np.arange(wide_rows), len(used))), pa.array(values, pa.decimal128(38, 0)), pa.array(np.repeat(count[used], wide_rows))]
            yield pa.RecordBatch.from_arrays(columns, ["dim", "entry", "at", "total", "n"])

    schema = "dim int, entry bigint, at bigint, total decimal(38,0), n bigint"
    told = table.select("dim", "v", "code").mapInArrow(sums, schema).groupBy("dim", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = {}
    for dim, book in books.items():
        parts, many, size = book.entries.shape
        flat = book.entries.astype(object).reshape(parts * many, size)
        for row in told:
            if row.dim == dim and size:
                flat[row.entry, row["at"]] = int(row.total) // row.n
        after = flat.astype(book.entries.dtype).reshape(book.entries.shape)
        gap = after - book.entries
        out[dim] = Book(after, _roots((gap * gap).sum(2) if size else np.zeros((parts, many), np.int64), True))
    return out


def vector_codes(rows: DataFrame, vector: str, key: str, label: Column, scale: int = 256, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``key label code error label_error codebooks_sha256`` of every usable vector.

    Rows whose vector is null or holds a null or non-finite component go. Each
    component becomes floor(``scale`` * x). Vectors of one length share a book:
    a position's entries begin as that part of the vectors of the ``entries``
    smallest keys, and ``rounds`` times all parts are assigned and the entries
    moved to the floor of their parts' mean. ``code`` has two hex digits a part,
    ``error`` is the sum of the last squared distances, ``label_error`` that of
    all rows of an equal label, nulls together, whatever the vectors' lengths.

    Repeated rows count each, but a key begins one entry (the least of its
    vectors by bytes; a null key last). Fewer keys make fewer entries. A length
    that ``parts`` doesn't divide is filled up with zeros; empty vectors have the
    code 0. Components of any size are exact; an error beyond 64 bits is one. An
    empty table stays empty. Other columns of ``rows`` are not looked at.

    A round reads and writes the vectors where they lie; only sums by entry are
    shuffled. What every task gets is ``entries`` vectors of each length.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    usable = small_batches(rows).where(x.isNotNull() & finite).select(F.col(key).cast("long").alias("key"), label.alias("label"), x.alias("x"))
    numbers, wide = _whole_numbers(usable, scale)
    table = saved(numbers)
    books = first_books(table, parts, entries, wide)
    for _ in range(rounds):
        after = saved(assigned(table, books, wide))
        forget(table)
        table, books = after, moved_books(after, books, wide)
    digests = {dim: book.digest for dim, book in books.items()}
    kind = table.schema["label"].dataType.simpleString()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, dim in _by_length(batches):
            book, rows = books[dim], batch.num_rows
            x = _parted(batch.column("v").to_pylist(), dim, parts, wide)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(rows, parts)
            error = sum((own_squared(x[:, p], book.entries[p], codes[:, p]) for p in range(parts)), np.zeros(rows, x.dtype))
            if max(error.tolist(), default=0) >= 1 << 63:
                raise OverflowError("an error is beyond 64 bits")
            hexed = [r.tobytes().hex() for r in codes]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(hexed), pa.array(error.astype(np.int64)), pa.array([digests[dim]] * rows)], ["key", "label", "code", "error", "codebooks_sha256"])

    final = assigned(table, books, wide).mapInArrow(last, f"key bigint, label {kind}, code string, error bigint, codebooks_sha256 string")
    told = saved(final)
    forget(table)
    return with_label_error(told)


def with_label_error(told: DataFrame) -> DataFrame:
    """``told`` with ``label_error``: the sum of ``error`` over rows of an equal label; nulls are equal."""
    named = told.withColumns({"unlabelled": F.col("label").isNull(), "group": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = saved(named.groupBy("unlabelled", "group").agg(F.sum("error").alias("label_error"), F.count("*").alias("w")))
    total = sums.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    out = join_counted(named, sums, ["unlabelled", "group"], total)
    return out.select("key", "label", "code", "error", "label_error", "codebooks_sha256")
