"""The engine's own tables: a folder for each, its versions numbered.

A version is a base, which holds all rows, or a delta: rows that came, and
places of rows that went (a file and a position in it), both in proportion to
what was changed. A read merges a base and the deltas after it. Deltas that grow
too many, or too large for their base, are compacted into the next base.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotweave import storage

#: Deltas on one base, the share of the base's rows that they may come to, and the rows they may have anyway.
MAX_DELTAS, MAX_SHARE, FREE_ROWS = 6, 0.25, 1000
#: Bytes of a base up to which a change writes the next base instead: one small file, and a plain scan to read.
WHOLE_BYTES = 1 << 20
#: Values of a partition column up to which a change names each.
MAX_PARTS = 200
#: Where a row lies.
PLACE = ("__version", "__file", "__pos")
GONE = "__version int, __file string, __pos bigint"

#: Tables and what partitions them.
TABLES = {
    "notes": ("project", "store"),
    "chunks": ("project", "store"),
    "vectors": ("project",),
    "enrichment": ("label",),
    "symbols": ("project",),
    "learnings": ("project",),
    "nodes": ("project",),
    "deps": ("project",),
    "sources": ("project",),
    "versions": ("project",),
    "postings": ("bucket",),
    "terms": ("bucket",),
    "forward": ("bucket",),
}
#: Tables whose bases lie in ranges of these columns, sorted by them: few files, and scans that skip.
ORDER = {"postings": ("bucket", "term", "level"), "terms": ("bucket", "term"), "forward": ("bucket",)}



class Tables:
    """Named tables under a root that Spark reads and writes. One writer at a time, any number of readers.

    A version exists once its last file does: Spark's mark of a base, the commit
    of a delta, which is renamed into place. A reader sees the old or the new
    one; a write that fails leaves the old, and the next one writes over its rest.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._schemas: dict[tuple[str, int], object] = {}

    # files

    def _path(self, *parts: object):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, name: str, number: int) -> dict | None:
        """What a delta says of itself; None for a base."""
        fs, path = self._fs(), self._path(name, number, "commit.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return json.loads(text)

    def _settle(self, name: str, number: int, told: dict) -> None:
        fs, part, whole = self._fs(), self._path(name, number, "_commit.part"), self._path(name, number, "commit.json")
        stream = fs.create(part, True)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        if not fs.rename(part, whole):
            raise RuntimeError(f"version {number} of {name} exists already")

    # versions

    def versions(self, name: str) -> list[int]:
        """Complete versions, oldest first."""
        fs, folder = self._fs(), self._path(name)
        if not fs.exists(folder):
            return []
        found = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
        return sorted(n for n in found if any(fs.exists(self._path(name, n, mark)) for mark in ("_SUCCESS", "commit.json")))

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def _chain(self, name: str, version: int | None = None) -> tuple[int, dict[int, dict]]:
        """The base of a version, and the deltas on it up to that version."""
        known = self.versions(name)
        if not known or (version is not None and version not in known):
            raise ValueError(f"no table {name!r} under {self.root}" if not known else f"no version {version} of {name!r}")
        last = known[-1] if version is None else version
        told = self._commit(name, last)
        base = last if told is None else told["base"]
        return base, {n: self._commit(name, n) for n in known if base < n <= last}

    def _placed(self, name: str, version: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows of a version and their ``PLACE``."""
        base, deltas = self._chain(name, version)
        parts = []
        for n in (base, *(n for n, told in deltas.items() if told["rows"])):
            folder = f"{name}/{n}" if n == base else f"{name}/{n}/rows"
            file = F.element_at(F.split(F.col("_metadata.file_path"), f"/{folder}/"), -1)
            rows = self._scan(name, base, folder).select("*", F.lit(n).alias(PLACE[0]), file.alias(PLACE[1]), F.col("_metadata.row_index").alias(PLACE[2]))
            rows = rows if where is None else rows.where(where)
            later = {m: told["gone"].get(str(n), 0) for m, told in deltas.items() if m > n}
            if any(later.values()):
                gone = self.spark.read.schema(GONE).parquet(*(f"{self.root}/{name}/{m}/gone" for m, many in later.items() if many)).where(F.col(PLACE[0]) == n).select(*PLACE[1:])
                few = sum(later.values()) <= storage.SMALL_ROWS  # as the commits count them
                rows = rows.join(F.broadcast(gone) if few else gone, [*PLACE[1:]], "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _scan(self, name: str, base: int, folder: str) -> DataFrame:
        """A folder's rows under the base's schema, which is looked up once."""
        if (name, base) not in self._schemas:
            self._schemas[name, base] = self.spark.read.parquet(f"{self.root}/{name}/{base}").schema
        return self.spark.read.schema(self._schemas[name, base]).parquet(f"{self.root}/{folder}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one by default."""
        base, deltas = self._chain(name, version)
        if not deltas:
            return self._scan(name, base, f"{name}/{base}")
        return self._placed(name, version).drop(*PLACE)

    def write(self, name: str, rows: DataFrame) -> None:
        """A base of ``rows`` as the next version."""
        number = (self.versions(name) or [0])[-1] + 1
        by = [c for c in TABLES.get(name, ()) if c in rows.columns]
        fs = self._fs()
        if fs.exists(self._path(name, number)):  # what a write left that didn't end
            fs.delete(self._path(name, number), True)
        if order := ORDER.get(name):  # rows of one value, if they are many, go to several files
            rows = rows.repartitionByRange(*order, F.xxhash64(*rows.columns)).sortWithinPartitions(*order)
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/{number}")
        if by and all(f.isFile() for f in fs.listStatus(self._path(name, number))):  # no rows, so no folder holds the schema
            self.spark.createDataFrame([], rows.schema).write.mode("overwrite").parquet(f"{self.root}/{name}/{number}")

    def change(self, name: str, key: Sequence[str], rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Rows of the keys in ``rows`` or ``gone`` go, then ``rows`` come, in one step.

        Both may be computed from the table itself. All rows of a key go, and all
        of ``rows`` come, repeated ones too; a null in a key equals nothing, so
        such rows come and never go. Only key columns of the table are read, of
        the keys' partitions (of those from the least to the greatest, where they
        are over ``MAX_PARTS``); what is written is ``rows`` and the places of what went.
        """
        if not self.exists(name):
            if rows is not None:
                self.write(name, rows)
            return
        if self._tiny(name):
            keys = reduce(DataFrame.unionByName, [df.select(*key) for df in (rows, gone) if df is not None])
            kept = self.read(name).join(keys.distinct(), [*key], "left_anti")
            return self.write(name, kept if rows is None else kept.unionByName(rows))
        last = self.versions(name)[-1]
        number, by = last + 1, [c for c in TABLES.get(name, ()) if rows is not None and c in rows.columns]
        fresh = self._fresh(name, number)
        keys = [gone.select(*key)] if gone is not None else []
        if rows is not None:
            rows.write.partitionBy(*by).parquet(f"{fresh}/rows")
            keys.append(self._scan(name, self._chain(name)[0], f"{name}/{number}/rows").select(*key))
        wanted = storage.saved(reduce(DataFrame.unionByName, keys).distinct())
        parts = [c for c in key if c in TABLES.get(name, ())]
        size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 32 for c in key), F.lit(0))
        n, total, *ends = wanted.agg(F.count("*"), F.sum(size), *(end(c) for c in parts for end in (F.min, F.max))).first()
        where = None
        for column, low, high in zip(parts, ends[::2], ends[1::2], strict=True):
            named = F.col(column).between(low, high) if low is not None else F.lit(False)
            values = [r[0] for r in wanted.select(column).distinct().limit(MAX_PARTS + 1).collect()]
            if low is not None and len(values) <= MAX_PARTS:
                named = F.col(column).isin([v for v in values if v is not None])
            where = named if where is None else where & named
        few = n <= storage.SMALL_ROWS and (total or 0) <= storage.SMALL_BYTES
        went = self._placed(name, last, where).select(*PLACE, *key).join(F.broadcast(wanted) if few else wanted, [*key], "left_semi")
        self._delta(name, number, went, rows is not None)
        storage.forget(wanted)

    def replace(self, name: str, rows: DataFrame) -> None:
        """The next version has just ``rows``; what equal rows the table has stays where it is."""
        if not self.exists(name) or self._tiny(name):
            return self.write(name, rows)
        last = self.versions(name)[-1]
        number, by = last + 1, [c for c in TABLES.get(name, ()) if c in rows.columns]
        old, columns = self._placed(name, last), rows.columns
        mark = lambda seed: F.xxhash64(F.lit(seed), *columns)
        count = lambda df, n: df.groupBy(mark(1).alias("h1"), mark(2).alias("h2")).agg(F.count("*").alias(n))
        stay = storage.saved(count(old, "a").join(count(rows, "b"), ["h1", "h2"]).where("a = b").select("h1", "h2"))
        fresh = self._fresh(name, number)
        new = rows.withColumns({"h1": mark(1), "h2": mark(2)}).join(stay, ["h1", "h2"], "left_anti").select(*columns)
        new.write.partitionBy(*by).parquet(f"{fresh}/rows")
        went = old.withColumns({"h1": mark(1), "h2": mark(2)}).join(stay, ["h1", "h2"], "left_anti").select(*PLACE)
        self._delta(name, number, went, True)
        storage.forget(stay)

    def _tiny(self, name: str) -> bool:
        """Whether the last base has at most ``WHOLE_BYTES`` of files."""
        return self._fs().getContentSummary(self._path(name, self._chain(name)[0])).getLength() <= WHOLE_BYTES

    def _fresh(self, name: str, number: int) -> str:
        """The folder of a version to come, without what a failed write left in it."""
        self._fs().delete(self._path(name, number), True)
        return f"{self.root}/{name}/{number}"

    def _delta(self, name: str, number: int, went: DataFrame, came: bool) -> None:
        folder = f"{self.root}/{name}/{number}"
        went.select(*PLACE).write.parquet(f"{folder}/gone")
        base, deltas = self._chain(name)
        counts = self.spark.read.schema(GONE).parquet(f"{folder}/gone").groupBy(PLACE[0]).agg(F.count("*").alias("n"))
        if came:
            counts = counts.unionByName(self._scan(name, base, f"{name}/{number}/rows").agg(F.lit(0).alias(PLACE[0]), F.count("*").alias("n")))
        gone = {str(r[0]): r.n for r in counts.collect()}
        rows = gone.pop("0", 0)  # versions begin with 1
        whole = next((told["base_rows"] for told in deltas.values()), None)
        told = {"base": base, "rows": rows, "gone": gone, "base_rows": whole if whole is not None else self._scan(name, base, f"{name}/{base}").count()}
        self._settle(name, number, told)
        changed = sum(t["rows"] + sum(t["gone"].values()) for t in (*deltas.values(), told))
        if len(deltas) + 1 >= MAX_DELTAS or changed > max(MAX_SHARE * told["base_rows"], FREE_ROWS):
            self.compact(name)

    def compact(self, name: str) -> None:
        """The last version's rows as a base."""
        if self._chain(name)[1]:
            self.write(name, self.read(name))

    def expire(self, name: str, keep: int = 2) -> None:
        """At most ``keep`` versions stay; those of the last base always do."""
        known = self.versions(name)
        base = self._chain(name)[0]
        bases = [n for n in known if n == base or self._commit(name, n) is None]
        first = min((b for b in bases if len([n for n in known if n >= b]) <= keep), default=base)
        for number in known:
            if number < min(first, base):
                self._fs().delete(self._path(name, number), True)

    def rollback(self, name: str, version: int) -> None:
        """Versions after ``version`` go."""
        for number in self.versions(name):
            if number > version:
                self._fs().delete(self._path(name, number), True)

    def count(self, name: str) -> int:
        return self.read(name).agg(F.count("*")).first()[0] if self.exists(name) else 0
