"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table projects unit vectors on a few Gaussian directions and cuts the
projections into cells of one width; a combination of cells is a bucket. A
query does not only visit its own bucket: given the cosine that neighbours are
expected to have, every bucket has a probability to hold one, and buckets are
visited from the most probable on until the table has gathered its share of
the success asked for. The tables' candidates are merged and ranked by exact
cosine.

A first round expects the cosine that a bounded sample of queries tells. A query
whose own kth cosine turns out lower goes on to a second round at that cosine:
its true kth neighbour is as near or nearer, so the success asked for holds for
every query at its own distance. A query that gathers fewer than it asks for, or
would visit too many buckets, is compared with all vectors of its length.

Hashes grow with the logarithm of the number of rows, so that buckets keep
their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotweave.storage import broadcast_if_small

from .common import saved, small_batches
from .vectors import BLOCK_BYTES, as_bytes, entries, finite_vectors, matrix, own_rows, rows_of

TABLES, WIDTH = 4, 2.0
#: A neighbour of the cosine to expect is found with this probability.
AIM_FOUND = 0.95
#: Queries that are compared with all rows to learn that cosine: those whose key
#: hashes lowest. It is this quantile of their kth neighbours' cosines.
SAMPLE_QUERIES, AIM_QUANTILE = 64, 0.25
#: Hashes of a table: as many as leave so many rows in a bucket, a hash being
#: worth so many bits; and so few that a query visits at most ``PROBES`` buckets
#: on average, by the sample.
BUCKET_ROWS, HASH_BITS, LEAST_HASHES, MOST_HASHES, PROBES = 256, 1.5, 4, 15, 2048
#: A second round expects no cosine below this; where a table's buckets pass ``PROBES``, this stands for them.
LEAST_AIM, TOO_MANY = 0.05, -1
#: Vectors in one block of a bucket, queries in one block of a bucket's visitors.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 512
#: Projections beyond this many cells from the origin share the outermost cell.
REACH = 8
SEED = 20240


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no digit: their largest component is near 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(-1, keepdims=True))[1])


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; no size of component overflows."""
    scaled = _scaled(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision, each by the same sequence of sums."""
    q, v = _scaled(query), _scaled(vectors)
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * math.sqrt(float((q * q).sum())))


class Tables:
    """Directions and offsets of all hash tables for one dimension."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.directions = rng.normal(size=(tables, dim, hashes))
        self.offsets = rng.random((tables, hashes)) * width
        self.width, self.hashes, self.tables = width, hashes, tables

    def project(self, units: np.ndarray, table: int) -> np.ndarray:
        return units @ self.directions[table]

    def buckets(self, units: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each row, its cells as digits of one number."""
        cell = np.floor((self.project(units, table) + self.offsets[table]) / self.width)
        return self._number(np.clip(cell, -REACH, REACH - 1).astype(np.int64))

    def _number(self, cell: np.ndarray) -> np.ndarray:
        return (cell + REACH) @ ((2 * REACH) ** np.arange(self.hashes))

    def probes(self, unit: np.ndarray, table: int, cosine: float, enough: float) -> np.ndarray:
        """Buckets in order of estimated success, until they reach ``enough`` together.

        A neighbour's projection, given the query's p, is normal with mean
        cosine * p and variance 1 - cosine ** 2.
        """
        mean, sd = cosine * self.project(unit[None], table)[0], math.sqrt(1 - cosine * cosine)
        chance = []
        for m in range(self.hashes):
            edge = (np.arange(-REACH + 1, REACH) * self.width - self.offsets[table, m] - mean[m]) / sd
            chance.append(np.diff(np.r_[0.0, [0.5 * math.erfc(-e / math.sqrt(2)) for e in edge], 1.0]))
        rest = np.cumprod([1.0, *(p.max() for p in reversed(chance))])[::-1]  # the best that later hashes can do
        digits, least = np.arange(2 * REACH), 1e-4
        while True:  # all buckets of probability ``least`` or more, in order; more if they don't suffice
            total, number = np.ones(1), np.zeros(1, np.int64)
            for m, p in enumerate(chance):
                some = np.nonzero(total[:, None] * p[None] * rest[m + 1] >= least)
                total, number = total[some[0]] * p[some[1]], number[some[0]] + digits[some[1]] * (2 * REACH) ** m
            if total.sum() >= enough or least < 1e-12:
                break
            least /= 8
        order = np.lexsort((number, -total))
        return number[order[: int(np.searchsorted(np.cumsum(total[order]), enough)) + 1]]


def usable_vectors(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """``key dim v``: vectors as bytes of doubles; null, empty, zero and non-finite vectors go."""
    return as_bytes(finite_vectors(rows, vector, key).where(F.exists("x", lambda c: c != 0)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, tables: int = TABLES, hashes: int | None = None, width: float = WIDTH, aim_cosine: float | None = None, aim_found: float = AIM_FOUND, seed: int = SEED) -> DataFrame:
    """``query_id rank vec_id score``: each query's ``k`` nearest found, by cosine.

    Both sides are as :func:`usable_vectors` makes them. The query's own key
    takes no part; ties go to the smaller key. Rows of one key and vector count
    once; rows of one key with different vectors rank each, and as queries share
    one list. Fewer than ``k`` candidates are all returned: queries whose buckets
    hold fewer than ``k`` see all vectors of their length. Vectors meet queries
    of their length only; empty tables give no row. With ``aim_cosine`` given
    there is one round, at that cosine.

    All rows are indexed, but of equal vectors those of the ``k + 1`` smallest
    keys stand for the rest, which can't be in a result. ``hashes`` and
    ``aim_cosine`` follow from the number of rows and a sample of queries unless
    given; nothing else is fitted to the data.

    A bucket is not one group: its rows lie in blocks of bounded size, and the
    queries that visit it meet them block by block, so that a bucket with a
    third of all rows spreads over many tasks and no candidate pair is a row.
    """
    share, given = 1 - (1 - aim_found) ** (1 / tables), aim_cosine is not None
    rows = saved(small_batches(entries(vectors, k + 1)).withColumn("rid", F.monotonically_increasing_id()))
    asked = saved(queries.distinct().withColumn("q", F.monotonically_increasing_id()))
    if aim_cosine is None or hashes is None:
        sample = saved(asked.orderBy(F.xxhash64("key", "v"), "key").limit(SAMPLE_QUERIES))
        if aim_cosine is None:
            aim_cosine = _expected(_against_all(rows, sample, k), k)
        if hashes is None:
            hashes = _hashes(rows.count(), [(r.dim, np.frombuffer(r.v, "<f8")) for r in sample.select("dim", "v").collect()], tables, width, seed, aim_cosine, share)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch, dim in _by_length(batches):
            rids, keys, v = batch.column("rid").to_numpy(), batch.column("key").to_numpy(), rows_of(batch.column("v"), dim)
            hashed = made.setdefault(dim, Tables(dim, tables, hashes, width, seed))
            units = unit_rows(v)
            for t in range(tables):
                bucket = hashed.buckets(units, t)
                order = np.argsort(bucket, kind="stable")
                cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]), len(order)]
                groups = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield _stored(dim, t, [bucket[g[0]] for g in groups], [(rids[g], keys[g], v[g]) for g in groups])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch, dim in _by_length(batches):
            hashed = made.setdefault(dim, Tables(dim, tables, hashes, width, seed))
            own = batch.column("aim").to_pylist() if "aim" in batch.schema.names else [None] * batch.num_rows
            for q, unit, aim in zip(batch.column("q").to_pylist(), unit_rows(rows_of(batch.column("v"), dim)), own, strict=True):
                for t in range(tables):
                    seen = hashed.probes(unit, t, aim_cosine if aim is None else min(max(aim, LEAST_AIM), 0.98), share)
                    if aim is not None and len(seen) > PROBES:
                        seen = np.array([TOO_MANY], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), x), y) for x, y in ((dim, pa.int32()), (t, pa.int32()))] + [pa.array(seen), pa.array(np.full(len(seen), q))], ["dim", "table", "bucket", "q"])

    visits = "dim int, table int, bucket bigint, q bigint"
    found = saved(_best(_meet(rows.mapInArrow(index, _STORED), asked.mapInArrow(probe, visits), asked, k), k))
    kth = found.where(F.col("rank") == k).select("q", F.col("score").alias("aim"))
    # Buckets hold a share of all rows: where a query's hold too few, all rows
    # of its length are one bucket of a table of their own, in blocks as others are.
    short = asked.join(kth, "q", "left_anti")
    if not given:
        loose = saved(asked.join(kth.where(F.col("aim") < aim_cosine), "q"))
        if not loose.isEmpty():
            again = saved(loose.mapInArrow(probe, visits))
            wide = again.where(F.col("bucket") == TOO_MANY).select("q").distinct()
            more = _meet(rows.mapInArrow(index, _STORED), again.join(wide, "q", "left_anti"), asked, k)
            found = saved(_best(found.drop("rank").unionByName(more), k))
            short = short.unionByName(asked.join(wide, "q", "left_semi"))
    short = saved(short)
    out = found if short.isEmpty() else _best(found.drop("rank").unionByName(_against_all(rows, short, k)), k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_STORED = "dim int, table int, bucket bigint, rids binary, keys binary, vectors binary"


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int]]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield batch.filter(pa.array(dims == dim)), dim


def _stored(dim: int, table: int, buckets: list[int], groups: list[tuple]) -> pa.RecordBatch:
    n = len(groups)
    columns = [[dim] * n, [table] * n, buckets, *([g[i].tobytes() for g in groups] for i in range(3))]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(columns, kinds, strict=True)], ["dim", "table", "bucket", "rids", "keys", "vectors"])


def _against_all(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """As :func:`_meet`, but every query sees all rows of its length."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, dim in _by_length(batches):
            yield _stored(dim, -1, [0], [(batch.column("rid").to_numpy(), batch.column("key").to_numpy(), rows_of(batch.column("v"), dim))])

    same = rows.join(broadcast_if_small(asked.select("dim").distinct()), "dim", "left_semi")
    probed = asked.select("dim", F.lit(-1).alias("table"), F.lit(0).cast("bigint").alias("bucket"), "q")
    return _meet(same.mapInArrow(whole, _STORED), probed, asked, k)


def _expected(found: DataFrame, k: int) -> float:
    """The cosine to expect of a ``k``th neighbour: a low quantile over the sample's."""
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    ranked = found.dropDuplicates(["q", "rid"]).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    last = [r.s for r in ranked.groupBy("q").agg(F.min("score").alias("s")).collect()]
    return float(np.clip(np.quantile(last, AIM_QUANTILE), 0.05, 0.98)) if last else 0.05


def _hashes(rows: int, sample: list[tuple], tables: int, width: float, seed: int, cosine: float, share: float) -> int:
    """Hashes of a table for so many rows; fewer where the sample would visit too many buckets."""
    wanted = math.ceil(math.log2(max(rows / BUCKET_ROWS, 1)) / HASH_BITS)
    for hashes in range(min(max(wanted, LEAST_HASHES), MOST_HASHES), LEAST_HASHES, -1):
        made: dict[int, Tables] = {}
        visits = [len(made.setdefault(dim, Tables(dim, tables, hashes, width, seed)).probes(unit_rows(v[None])[0], 0, cosine, share)) for dim, v in sample]
        if np.mean(visits or [0]) <= PROBES:
            return hashes
    return LEAST_HASHES


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query. One candidate may come from several tables, each time with the same score."""
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    once = found.select("q", "query_id", "rid", "vec_id", "score").distinct()
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _meet(indexed: DataFrame, probed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``q query_id rid vec_id score``: the ``k`` best of every block for the queries that visit it."""
    place = ["dim", "table", "bucket"]
    # How many blocks a bucket needs, on either side, from its counts.
    sizes = indexed.groupBy(*place).agg(F.greatest(F.ceil(F.sum(F.octet_length("rids")) / (8 * BLOCK_ROWS)), F.ceil(F.sum(F.octet_length("vectors")) / BLOCK_BYTES)).cast("int").alias("parts"))
    visits = probed.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns"))
    plan = sizes.join(visits, place)

    def pack(_: tuple, table: pa.Table) -> pa.Table:
        numbers = [table[c].to_numpy().astype(np.int64).tobytes() for c in ("q", "key")]
        return pa.table({c: table[c][:1] for c in (*place, "turn")} | {"qs": [numbers[0]], "q_keys": [numbers[1]], "q_vectors": [b"".join(table["v"].to_pylist())]})

    # Vectors travel to the buckets that exist only.
    visited = probed.join(plan, place).withColumn("turn", F.pmod(F.xxhash64("q"), "turns").cast("int")).select("q", "table", "bucket", "turn")
    met = visited.join(asked, "q").groupBy(*place, "turn").applyInArrow(pack, "dim int, table int, bucket bigint, turn int, qs binary, q_keys binary, q_vectors binary")

    def gather(_: tuple, table: pa.Table) -> pa.Table:
        return pa.table({c: table[c][:1] for c in (*place, "turns")} | {c: [b"".join(table[c].to_pylist())] for c in ("rids", "keys", "vectors")})

    kept = indexed.join(plan, place).withColumn("part", F.pmod(F.xxhash64("rids"), "parts").cast("int")).groupBy(*place, "part").applyInArrow(gather, _STORED.replace("rids", "turns int, rids"))
    pairs = kept.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).join(met, [*place, "turn"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                rids, keys, qs, q_keys = (np.frombuffer(row[c], np.int64) for c in ("rids", "keys", "qs", "q_keys"))
                v, q = matrix(row["vectors"], len(keys), row["dim"]), matrix(row["q_vectors"], len(qs), row["dim"])
                rough = unit_rows(q) @ unit_rows(v).T
                rough[own_rows(keys, q_keys)] = -np.inf
                out: list[list] = [[], [], []]
                for n in range(len(q)):
                    # rounding can't hide a winner: the rough kth less a margin
                    r = rough[n]
                    floor = np.partition(r, len(r) - k)[len(r) - k] - 1e-9 if len(r) > k else -2.0
                    near = np.flatnonzero(r >= max(floor, -2.0))
                    score = cosines(q[n], v[near])
                    best = np.lexsort((keys[near], -score))[:k]
                    for own, value in zip(out, (np.full(len(best), n), near[best], score[best]), strict=True):
                        own.append(value)
                a, b, score = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qs[a], q_keys[a], rids[b], keys[b], score)], ["q", "query_id", "rid", "vec_id", "score"])

    return pairs.select("dim", "rids", "keys", "vectors", "qs", "q_keys", "q_vectors").mapInArrow(rank, "q bigint, query_id bigint, rid bigint, vec_id bigint, score double")
