"""Exact top-k inner products by vector-approximation files.

Weber, Schek and Blott's VA-file keeps a byte for each component: the cell it
lies in. The cells are scanned for every query and bound every score from both
sides. What can't reach the kth best lower bound over all cells is out. Of the
rest, exact vectors are read in the order of their bounds: first as many as are
asked for, then those whose bound still beats the kth exact score. With that
the result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved, small_batches
from .vectors import BLOCK_BYTES, as_bytes, entries, finite_vectors, matrix, own_rows, rows_of

BLOCK_ROWS, BLOCK_QUERIES = 32768, 1024
CELLS = 256
#: Queries whose bounds against a block are held at once.
TURN = 64
#: Query blocks up to these bytes are broadcast.
SMALL_BYTES = 32 << 20
MOST = (1 << 63) - 1


def integer_vectors(rows: DataFrame, vector: str, scale: int, key: str) -> DataFrame:
    """``key dim v``: each component x as floor(``scale`` * x), x as double.

    Rows with a null key or vector, or with a component that is null or not
    finite, are left out; no other is (an empty vector has length 0). The
    floors are whole doubles, so that any size of component has its exact
    value; one whose product with the scale is beyond all doubles is an error.
    """
    return as_bytes(finite_vectors(rows, vector, key), scale)


def _cell_file(block_rows: int):
    """Rows (dim, n, rids, keys, low, width, half, codes): blocks of one length.

    A component is about ``low + code * width``, and never further from that
    than ``half``, for its place in the vector.
    """

    def write(dim: int, parts: list[tuple]) -> pa.RecordBatch:
        rids, keys = (np.concatenate([p[n] for p in parts]) for n in (0, 1))
        v = np.concatenate([p[2] for p in parts])
        low, high = v.min(0), v.max(0)
        width = np.maximum(1.0, np.ceil(high / CELLS - low / CELLS + 1 / CELLS))
        code = np.clip(np.floor(v / width - low / width), 0, CELLS - 1)
        low = low + (width - 1) / 2
        near = low + code * width
        half = np.abs(v - near).max(0)
        half = np.where(half > 0, half * (1 + 2**-40) + 2**-50 * np.abs(near).max(0), 0.0)
        values = [low.tobytes(), width.tobytes(), half.tobytes(), code.astype(np.uint8).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([dim, len(v), rids.tobytes(), keys.tobytes(), *values], [pa.int32(), pa.int32(), *[pa.binary()] * 6], strict=True)], ["dim", "n", "rids", "keys", "low", "width", "half", "codes"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                most = max(1, min(block_rows, BLOCK_BYTES // max(8 * dim, 1)))
                for at in range(0, part.num_rows, most):
                    own = part.slice(at, most)
                    if rows.get(dim, 0) + own.num_rows > most:
                        rows.pop(dim)
                        yield write(dim, held.pop(dim))
                    held.setdefault(dim, []).append((own.column(1).to_numpy(), own.column(2).to_numpy(), rows_of(own.column(3), dim)))
                    rows[dim] = rows.get(dim, 0) + own.num_rows
            if sum(8 * dim * n for dim, n in rows.items()) > 2 * BLOCK_BYTES:
                for dim in list(held):
                    yield write(dim, held.pop(dim))
                rows.clear()
        for dim in held:
            yield write(dim, held[dim])

    return scan


def _levelled(q: np.ndarray) -> np.ndarray:
    """Queries times powers of two, so that no sum of products overflows."""
    top = np.frexp(np.abs(q).max(1, initial=0.0, keepdims=True))[1]
    return np.ldexp(q, -(top + q.shape[1].bit_length() + 2))


def _bounded(asked: dict, block: dict, k: int) -> Iterator[tuple]:
    """(query row, vector row, lower, upper) of what may be among a query's ``k`` best of one block."""
    dim, n = block["dim"], block["n"]
    keys = np.frombuffer(block["keys"], np.int64)
    low, width, half = (np.frombuffer(block[c], "<f8") for c in ("low", "width", "half"))
    code = np.frombuffer(block["codes"], np.uint8).reshape(n, dim).astype(np.float64)
    q_keys = np.frombuffer(asked["q_keys"], np.int64)
    raw = matrix(asked["q_vectors"], len(q_keys), dim)
    q = _levelled(raw)
    reach = np.maximum(np.abs(low), np.abs(low + (CELLS - 1) * width))
    with np.errstate(over="ignore"):
        whole = (np.abs(raw) @ reach < 2.0**52) & ~half.any()  # whole numbers that add up without rounding
    error = np.where(whole, 0.0, np.abs(q) @ half + dim * 2.0**-50 * (np.abs(q) @ reach))
    for at in range(0, len(q), TURN):
        part, err = q[at : at + TURN], error[at : at + TURN]
        mid = (part * width) @ code.T + (part @ low)[:, None]
        mine = own_rows(keys, q_keys[at : at + TURN])
        mid[mine] = -np.inf
        have = n - np.bincount(mine[0], minlength=len(part))
        out = []
        for m in np.flatnonzero(have):
            row = mid[m]
            kth = np.partition(row, n - k)[n - k] if have[m] > k else -np.inf
            near = np.flatnonzero((row >= kth - 2 * err[m]) & (row > -np.inf))
            if err[m] == 0 and len(near) > k:  # exact already: ties go to the smaller key
                near = near[np.lexsort((keys[near], -row[near]))[:k]]
            out.append((np.full(len(near), at + m), near, row[near] - err[m], row[near] + err[m]))
        if out:
            yield tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _scan(k: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                q, rids = np.frombuffer(row["qs"], np.int64), np.frombuffer(row["rids"], np.int64)
                for a, b, lower, upper in _bounded(row, row, k):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q[a], rids[b], lower, upper)], ["q", "rid", "lower", "upper"])

    return scan


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of (q, query_id, vec_id, dim, qv, v); ``least`` is the score on the scale of the bounds."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            q, v = rows_of(part.column("qv"), dim), rows_of(part.column("v"), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                size = np.abs(q * v).sum(1)
                score = np.where(size < 2.0**52, (q * v).sum(1), 0).astype(np.int64)
            beyond = np.zeros(len(q), np.int8)
            for n in np.flatnonzero(~(size < 2.0**52)):
                total = sum(int(a) * int(b) for a, b in zip(q[n], v[n], strict=True))
                beyond[n] = (total > MOST) - (total < -MOST - 1)
                score[n] = min(max(total, -MOST - 1), MOST)
            level = _levelled(q)
            least = (level * v).sum(1) - dim * 2.0**-50 * np.abs(level * v).sum(1)
            yield pa.RecordBatch.from_arrays([part.column("q"), part.column("query_id"), part.column("vec_id"), pa.array(score), pa.array(beyond), pa.array(least)], ["q", "query_id", "vec_id", "score", "beyond", "least"])


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """``q floor``: each query's ``k``th greatest ``value``, for queries that have so many."""
    best = Window.partitionBy("q").orderBy(F.desc(value))
    top = rows.select("q", value).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return top.groupBy("q").agg(F.min(value).alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("q", "floor")


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id rank vec_id score``: each query's ``k`` best vectors, exactly.

    Both sides are as :func:`integer_vectors` makes them. Scores are integer
    inner products; the query's own key takes no part; ties go to the smaller
    key. Rows of one key and vector count once; rows of one key with different
    vectors rank each, and as queries share one list. Vectors meet queries of
    their own length only (empty ones score 0). With fewer than ``k`` others,
    all are returned; with none, or empty tables, no row. A score of a result
    that no long holds is an error.

    The cells are written once, a byte a component; only they are scanned, in
    blocks of bounded size. Candidates are (query, vector) numbers with bounds,
    ``k`` for each query and block where bounds are tight; vectors are read for
    those alone.
    """
    exact = saved(small_batches(entries(vectors, k + 1)).withColumn("rid", F.monotonically_increasing_id()))
    asked = saved(queries.distinct().withColumn("q", F.monotonically_increasing_id()))
    m, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v") + 16), F.lit(0))).first()
    turns = max(1, -(-m // block_queries))
    cells = saved(exact.select("dim", "rid", "key", "v").mapInArrow(_cell_file(block_rows), "dim int, n int, rids binary, keys binary, low binary, width binary, half binary, codes binary"))

    def pack(_: tuple, table: pa.Table) -> pa.Table:
        numbers = [table[c].to_numpy().astype(np.int64).tobytes() for c in ("q", "key")]
        return pa.table({"dim": table["dim"][:1], "turn": table["turn"][:1], "qs": [numbers[0]], "q_keys": [numbers[1]], "q_vectors": [b"".join(table["v"].to_pylist())]})

    blocks = asked.withColumn("turn", F.pmod(F.xxhash64("q"), F.lit(turns)).cast("int")).groupBy("dim", "turn").applyInArrow(pack, "dim int, turn int, qs binary, q_keys binary, q_vectors binary")
    met = cells.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).join(F.broadcast(blocks) if size <= SMALL_BYTES else blocks, ["dim", "turn"])
    near = saved(met.mapInArrow(_scan(k), "q bigint, rid bigint, lower double, upper double"))
    order = Window.partitionBy("q").orderBy(F.desc("upper"), "rid")
    left = near.join(_kth(near, "lower", k), "q", "left").where("floor is null or upper >= floor").select("q", "rid", "upper")
    left = saved(left.withColumn("place", F.row_number().over(order)))

    def read(chosen: DataFrame) -> DataFrame:
        whole = chosen.select("q", "rid").join(exact.select("rid", "dim", F.col("key").alias("vec_id"), "v"), "rid").join(asked.select("q", F.col("key").alias("query_id"), F.col("v").alias("qv")), "q")
        return whole.select("q", "query_id", "vec_id", "dim", "qv", "v").mapInArrow(_exact, "q bigint, query_id bigint, vec_id bigint, score bigint, beyond tinyint, least double")

    first = saved(read(left.where(F.col("place") <= k)))
    more = read(left.where(F.col("place") > k).join(_kth(first, "least", k), "q").where("upper >= floor"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    won = first.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = saved(won.select("query_id", "rank", "vec_id", F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score is beyond 64 bits"))).alias("score")))
    for table in (exact, asked, cells, near, left, first):
        forget(table)
    return out
