"""A stored inverted index: postings in blocks by term and impact, bounds for each, edits in proportion.

Four tables under one root. ``postings`` has a row for each document and term, in
the bucket of its term, sorted by term and level; a block is a term's rows of
one level. ``terms`` has each block's size and best impact. ``forward`` has each
document's length and terms: an edit finds there what it takes back, and a
document's whole score is told from it. ``head`` names the versions that belong
together; it is written last, so a reader sees an edit whole or not at all.

The impact of a posting is its BM25 factor, tf / (tf + k1 (1 - b + b len / ref)),
at the mean length of the first build (``ref``). For any other mean a the factor is
at most 1 / (1 + (1 / impact - 1) min(1, ref / a)), so bounds hold as lengths drift.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave import storage
from knotweave.functions import text as T
from knotweave.operators import batch, lexical
from knotweave.operators.lexical import B, K1

from .tables import Tables

#: Postings of a bucket at the first build, the least and the most buckets, and levels of impact.
BUCKET_ROWS, MIN_BUCKETS, MAX_BUCKETS, LEVELS = 20_000_000, 8, 4096, 16
#: Rows for each of ``k`` that the best blocks give before a threshold is known.
SEED_ROWS = 4
#: What unread blocks may add to a score, as a share of the threshold.
UNREAD_SHARE = 0.5
#: Postings of a batch's blocks, each as often as queries ask for it, from which documents are read instead (if they are fewer).
SCAN_ROWS = 1_000_000
#: Different terms, or buckets, up to which they are filters of a scan.
MAX_LISTED = 1000


def bucket_of(buckets: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("bucket")


def _listed(rows: DataFrame, keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with the values of ``keys`` as filters of the scan, column by column, where they are few."""
    for column in columns:
        values = [r[0] for r in keys.select(column).distinct().limit(MAX_LISTED + 1).collect()]
        if len(values) <= MAX_LISTED:
            rows = rows.where(F.col(column).isin(values))
    return rows


class PostingIndex:
    """BM25 over stored postings of documents named by ``key``.

    ``corpus`` names columns of the key that separate corpora: each has its own
    counts. All rows of a key are one document. A row with a null in its key is
    not indexed; a null or empty text has no terms but counts as a document.
    ``text`` is a column over the rows that :meth:`build` and :meth:`update` get; ``code`` adds
    the parts of compound names. One writer at a time.
    """

    def __init__(self, tables: Tables, key: Sequence[str], text: Column, corpus: Sequence[str] = (), code: bool = False):
        self.tables, self.key, self.corpus, self.text, self.code = tables, [*key], [*corpus], text, code

    # tables

    def _head(self):
        return self.tables.read("head").first()

    def _read(self, name: str, head) -> DataFrame:
        return self.tables.read(name, head[name])

    def _commit(self, ref: float, buckets: int) -> None:
        last = {name: self.tables.versions(name)[-1] for name in ("postings", "terms", "forward")}
        row = [(*last.values(), ref, buckets)]
        self.tables.write("head", self.tables.spark.createDataFrame(row, "postings int, terms int, forward int, ref double, buckets int").coalesce(1))
        for name in (*last, "head"):
            self.tables.expire(name, 8)

    def _forward(self, docs: DataFrame) -> DataFrame:
        """``key... len terms``: one row a document, texts shuffled once."""
        words = F.concat(T.tokenize(self.text), T.subtokens(self.text)) if self.code else T.tokenize(self.text)
        named = docs.where(" and ".join(f"`{c}` is not null" for c in self.key))
        each = named.repartition(*self.key).select(*self.key, F.explode_outer(words).alias("term"))
        counted = each.groupBy(*self.key, "term").agg(F.count("term").cast("double").alias("tf"))
        entry = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
        return counted.groupBy(*self.key).agg(F.sum("tf").alias("len"), F.collect_list(entry).alias("terms"))

    def _postings(self, forward: DataFrame, ref: float, buckets: int) -> DataFrame:
        """``bucket term level key... tf len impact`` of forward rows."""
        each = forward.select(*self.key, "len", F.explode("terms").alias("t")).select(*self.key, "len", "t.term", "t.tf")
        impact = F.col("tf") / (F.col("tf") + F.lit(K1) * (1 - B + B * F.col("len") / F.lit(ref)))
        level = F.least(F.floor(F.col("impact") * LEVELS), F.lit(LEVELS - 1)).cast("int").alias("level")
        return each.withColumn("impact", impact).select(bucket_of(buckets, "term"), "term", level, *self.key, "tf", "len", "impact")

    def _blocks_of(self, post: DataFrame) -> DataFrame:
        return post.groupBy("bucket", *self.corpus, "term", "level").agg(F.count("*").alias("n"), F.max("impact").alias("best"))

    def _laid(self, post: DataFrame) -> DataFrame:
        """Postings in ranges of bucket, term and level; a frequent term's rows go to several."""
        order = ["bucket", "term", "level"]
        return post.repartitionByRange(*order, F.xxhash64(*self.key)).sortWithinPartitions(*order).drop("impact")

    # writes

    def build(self, docs: DataFrame) -> None:
        """Index ``docs`` alone; what the index held before is gone."""
        forward = storage.saved(self._forward(docs))
        mean, rows = forward.agg(F.avg("len"), F.sum(F.size("terms"))).first()
        ref, buckets = mean or 1.0, min(MAX_BUCKETS, max(MIN_BUCKETS, (rows or 0) // BUCKET_ROWS))
        post = storage.saved(self._postings(forward, ref, buckets))
        self.tables.write("forward", forward.withColumn("bucket", bucket_of(buckets, *self.key)))
        self.tables.write("postings", post.drop("impact"))
        self.tables.write("terms", storage.saved(self._blocks_of(post)))
        for rows in (forward, post):
            storage.forget(rows)
        self._commit(ref, buckets)

    def update(self, docs: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Index ``docs`` anew and take back the documents whose keys are in ``gone``.

        A key in both stays, with the text of ``docs``. Only buckets of the terms that
        these documents had or have are looked at, and what is written is their
        postings, the sizes of their terms' blocks, and themselves.
        """
        head = self._head()
        for name in ("postings", "terms", "forward"):
            self.tables.rollback(name, head[name])  # what an update left that didn't end
        place = ["bucket", *self.key]
        forward = self._read("forward", head)
        named = bucket_of(head.buckets, *self.key)
        new = storage.saved(self._forward(docs).withColumn("bucket", named) if docs is not None else forward.limit(0))
        keys = new.select(*place)
        if gone is not None:
            keys = keys.unionByName(gone.select(named, *self.key))
        keys = storage.saved(keys.distinct())
        small = storage.is_small(keys)
        old = storage.saved(_listed(forward, keys, ["bucket"]).join(F.broadcast(keys) if small else keys, place, "left_semi"))
        was, now = self._postings(old, head.ref, head.buckets), self._postings(new, head.ref, head.buckets)
        same = ["bucket", "term", "level", *self.key, "tf", "len"]
        came = storage.saved(now.join(was, same, "left_anti"))
        went = storage.saved(was.join(now, same, "left_anti"))
        self.tables.change("postings", ["bucket", "term", *self.key], self._laid(came), went)

        block = ["bucket", *self.corpus, "term", "level"]
        moved = came.select(*block, F.lit(1).alias("d"), "impact").unionByName(went.select(*block, F.lit(-1).alias("d"), F.lit(0.0).alias("impact")))
        moved = storage.saved(moved.groupBy(*block).agg(F.sum("d").alias("d"), F.max("impact").alias("more")))
        stored = _listed(self._read("terms", head), moved, ["bucket"])
        kept = moved.join(stored, block, "left").select(*block, (F.coalesce("n", F.lit(0)) + F.col("d")).alias("n"), F.greatest(F.coalesce("best", F.lit(0.0)), "more").alias("best"))
        self.tables.change("terms", block, storage.saved(kept.where("n > 0")), moved)
        self.tables.change("forward", place, new, keys)
        self._commit(head.ref, head.buckets)
        for rows in (new, keys, old, came, went, moved):
            storage.forget(rows)

    # reads

    def blocks(self, queries: DataFrame, query_key: Sequence[str] = ("query_id",), text: str = "query") -> DataFrame:
        """``query_key... corpus... bucket term level n weight avgdl most``: each query's blocks.

        ``weight`` is idf times the term's number in the query, ``most`` what the
        block can add to a score.
        """
        head, by = self._head(), self.corpus
        asked = storage.saved(lexical.query_terms(queries, [*query_key, *by], text, self.code).withColumn("bucket", bucket_of(head.buckets, "term")))
        stored = _listed(self._read("terms", head), asked, ["bucket", "term"])
        found = storage.saved(stored.join(storage.broadcast_if_small(asked.select("bucket", *by, "term").distinct()), ["bucket", *by, "term"], "left_semi"))
        totals = lexical.corpus_totals(self._read("forward", head).select(*by, "len"), by)
        counts = found.groupBy(*by, "term").agg(F.sum("n").alias("df"))
        counts = counts.join(totals, by) if by else counts.crossJoin(totals)  # one row of totals
        idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = counts.withColumnRenamed("n", "total").select(*by, "term", idf.alias("idf"), "avgdl")
        reach = 1 / (1 + (1 / F.col("best") - 1) * F.least(F.lit(1.0), F.lit(head.ref) / F.col("avgdl")))
        each = found.join(weighed, [*by, "term"]).join(asked, ["bucket", *by, "term"]).withColumn("weight", F.col("idf") * F.col("qtf"))
        return each.select(*query_key, *by, "bucket", "term", "level", "n", "weight", "avgdl", (F.col("weight") * (K1 + 1) * reach).alias("most"))

    def _part(self) -> Column:
        return F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))

    def _partial(self, blocks: DataFrame, query_key: Sequence[str]) -> DataFrame:
        """``query_key... key... score`` from the blocks given alone: no other is read."""
        block = ["bucket", *self.corpus, "term", "level"]
        stored = _listed(self._read("postings", self._head()), blocks, ["bucket", "term"])
        met = stored.join(storage.broadcast_if_small(blocks.select(*query_key, *block, "weight", "avgdl")), block)
        return met.groupBy(*query_key, *self.key).agg(F.sum(self._part()).alias("score"))

    def _whole(self, pairs: DataFrame, blocks: DataFrame, query_key: Sequence[str]) -> DataFrame:
        """The pairs' exact scores, from the documents' own terms."""
        head = self._head()
        forward = _listed(self._read("forward", head), pairs.select(bucket_of(head.buckets, *self.key)), ["bucket"])
        terms = blocks.select(*query_key, *self.corpus, "term", "weight", "avgdl").distinct()
        rows = forward.join(storage.broadcast_if_small(pairs.select(*query_key, *self.key)), self.key)
        each = rows.select(*query_key, *self.key, "len", F.explode("terms").alias("t")).select(*query_key, *self.key, "len", "t.term", "t.tf")
        met = each.join(storage.broadcast_if_small(terms), [*query_key, *self.corpus, "term"])
        return met.groupBy(*query_key, *self.key).agg(F.sum(self._part()).alias("score"))

    def split(self, blocks: DataFrame, k: int, query_key: Sequence[str] = ("query_id",)) -> DataFrame:
        """``blocks`` with ``floor`` (a score that ``k`` documents reach), ``rest`` and ``read``.

        The best blocks name ``k`` documents, whose exact scores set the floor. Blocks are
        left unread from the least upwards while what they can add to one score
        together, ``rest``, stays within a share of the floor: a document in
        none of the others can't reach it.
        """
        falling = Window.partitionBy(*query_key).orderBy(F.desc("most"), "term", "level")
        before = F.coalesce(F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seed = self._partial(storage.saved(blocks.withColumn("before", before).where(F.col("before") < SEED_ROWS * k)), query_key)
        named = storage.saved(lexical.top(seed, k, query_key, ties=self.key).select(*query_key, *self.key))
        floor = self._whole(named, blocks, query_key).groupBy(*query_key).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("floor"))
        told = blocks.join(storage.broadcast_if_small(floor), [*query_key], "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        own = Window.partitionBy(*query_key, "term").orderBy("most", "level")
        rising = Window.partitionBy(*query_key).orderBy("most", "term", "level").rowsBetween(Window.unboundedPreceding, 0)
        told = told.withColumn("rise", F.col("most") - F.coalesce(F.lag("most").over(own), F.lit(0.0)))
        told = told.withColumn("reach", F.sum("rise").over(rising)).withColumn("read", F.col("reach") >= F.col("floor") * UNREAD_SHARE)
        rest = F.coalesce(F.max(F.when(~F.col("read"), F.col("reach"))).over(Window.partitionBy(*query_key)), F.lit(0.0))
        return told.withColumn("rest", rest).drop("rise", "reach")

    def top(self, queries: DataFrame, k: int, query_key: Sequence[str] = ("query_id",), text: str = "query") -> DataFrame:
        """``query_key... key... score rank``: each query's ``k`` best documents, exactly.

        Equal to :func:`lexical.bm25` over all postings; ties by key. Queries without known
        terms have no rows. ``queries`` has the corpus columns, if there are any.

        A batch whose blocks hold more postings than there are documents makes pairs of
        most queries and documents: these are scored where the documents' own terms
        lie, and a task lets go all but the best. Otherwise blocks stay unread.
        """
        blocks = storage.saved(self.blocks(queries, query_key, text))
        if not self.corpus:
            met, *_ = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()
            if met > SCAN_ROWS and met > self._read("forward", self._head()).count() and storage.is_small(blocks):
                return self._scanned(blocks, k, query_key)
        told = storage.saved(self.split(blocks, k, query_key))
        limits = told.groupBy(*query_key).agg(F.max("floor").alias("floor"), F.max("rest").alias("rest"))
        partial = self._partial(told.where("read"), query_key).join(storage.broadcast_if_small(limits), [*query_key])
        near = F.col("floor") * (1 - 1e-9) - 1e-8  # sums may run in any order
        can = storage.saved(partial.where(F.col("score") + F.col("rest") >= near))
        done = can.where("rest = 0").select(*query_key, *self.key, "score")
        other = can.where("rest > 0").select(*query_key, *self.key)
        return lexical.top(done.unionByName(self._whole(other, blocks, query_key)), k, query_key, ties=self.key)

    def _scanned(self, blocks: DataFrame, k: int, query_key: Sequence[str]) -> DataFrame:
        """``query_key... key... score rank`` from all documents' own terms; nothing but each task's best is shuffled."""
        number = "__query"
        named = storage.saved(blocks.select(*query_key).distinct().coalesce(1).withColumn(number, F.monotonically_increasing_id()))
        same = [blocks[c].eqNullSafe(named[c]) for c in query_key]
        asked = blocks.join(F.broadcast(named), same).select(number, "term", "weight").distinct()
        mean = blocks.agg(F.max("avgdl")).first()[0]  # one for all, without corpora
        best = batch.Terms.weighed(asked, self._read("forward", self._head()), self.key, mean, number).best(k)
        return best.join(F.broadcast(named), number).select(*query_key, *self.key, "score", "rank")
