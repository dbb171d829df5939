"""Sparse scoring: postings, statistics, BM25, coverage, for batches of queries.

Nothing is collected: statistics are one-row tables that join by corpus, query
terms meet postings by term, and scores are sums. A term that is in most
documents makes one long key; its postings come pre-aggregated per document,
and Spark splits the key at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.functions import text as T
from knotweave.storage import broadcast_if_small, is_small, saved

K1, B = 1.5, 0.75
#: Rows that one range of :func:`numbered` holds on average, and the least number of ranges.
RANGE_ROWS, MIN_RANGES = 20_000, 16


def postings(docs: DataFrame, key: Sequence[str], text: Column, code: bool = False, terms: DataFrame | None = None) -> DataFrame:
    """``key... term tf``: how often each document has each term.

    ``code`` adds the parts of compound names. With ``terms`` (``term``, and
    columns of the key if they differ by corpus), only those are counted: where
    they are few, as a batch's are, they travel to the texts, and next to
    nothing is shuffled. Without, all postings are grouped by document.
    """
    read = text
    own = F.concat(T.tokenize(read), T.subtokens(read)) if code else T.tokenize(read)
    each = docs.select(*key, F.explode(own).alias("term"))
    if terms is not None:
        by = [c for c in terms.columns if c == "term" or c in key]
        each = each.join(broadcast_if_small(terms.select(*by).distinct()), by, "left_semi")
    return each.groupBy(*key, "term").agg(F.count("*").cast("double").alias("tf"))


def enrich(base: DataFrame, key: Sequence[str], terms: DataFrame, weight: float) -> DataFrame:
    """Add ``weight`` to a term's tf for each time it is in a document's enrichment.

    ``terms`` has the key and ``terms ARRAY<STRING>`` (phrases, tokenised here).
    """
    if weight <= 0:
        return base
    more = terms.select(*key, F.explode("terms").alias("phrase")).select(*key, F.explode(T.tokenize(F.col("phrase"))).alias("term"), F.lit(float(weight)).alias("tf"))
    return base.unionByName(more).groupBy(*key, "term").agg(F.sum("tf").alias("tf"))


def enriched_lengths(lengths: DataFrame, key: Sequence[str], terms: DataFrame, weight: float) -> DataFrame:
    """``key... len``: lengths with what :func:`enrich` adds to them."""
    words = F.aggregate("terms", F.lit(0), lambda n, phrase: n + F.coalesce(F.size(T.tokenize(phrase)), F.lit(0)))
    more = terms.groupBy(*key).agg(F.sum(words * F.lit(float(weight))).alias("__more"))
    return lengths.join(more, [*key], "left").select(*key, (F.col("len") + F.coalesce("__more", F.lit(0.0))).alias("len"))


def document_lengths(post: DataFrame, key: Sequence[str], docs: DataFrame | None = None) -> DataFrame:
    """``key... len``: each document's sum of tf; ``docs`` (their keys) adds those without terms."""
    lengths = post.groupBy(*key).agg(F.sum("tf").alias("len"))
    if docs is None:
        return lengths
    return docs.select(*key).join(lengths, [*key], "left").withColumn("len", F.coalesce("len", F.lit(0.0)))


def corpus_totals(lengths: DataFrame, corpus: Sequence[str] = ()) -> DataFrame:
    """``corpus... n avgdl``, separate for each value of ``corpus``, columns of the key."""
    return lengths.groupBy(*corpus).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


def term_idf(post: DataFrame, totals: DataFrame, corpus: Sequence[str] = ()) -> DataFrame:
    """``corpus... term df idf``."""
    df = post.groupBy(*corpus, "term").agg(F.count("*").alias("df"))
    joined = df.join(totals, [*corpus]) if corpus else df.crossJoin(totals)  # one row of totals
    return joined.withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).select(*corpus, "term", "df", "idf")


def query_terms(queries: DataFrame, key: Sequence[str] = ("query_id",), text: str = "query", code: bool = False) -> DataFrame:
    """``key... term qtf``: the terms of each query, repeated ones counted."""
    terms = F.concat(T.tokenize(F.col(text)), T.subtokens(F.col(text))) if code else T.tokenize(F.col(text))
    return queries.select(*key, F.explode(terms).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("qtf"))


def bm25(queries: DataFrame, post: DataFrame, key: Sequence[str], docs: DataFrame | None = None, corpus: Sequence[str] = (), query_key: Sequence[str] = ("query_id",), k1: float = K1, b: float = B, code: bool = False, lengths: DataFrame | None = None) -> DataFrame:
    """``query_key... key... score`` of every document that shares a term with a query.

    ``lengths`` (``key... len``) saves counting them from the postings.
    """
    by = [*corpus]
    asked = query_terms(queries, [*query_key, *(c for c in by if c in queries.columns and c not in query_key)], code=code)
    own = [c for c in by if c in asked.columns]
    # Only postings of terms that are asked for go on; lengths need them all. They
    # are read twice, for the terms' counts and for the scores, and made once.
    sent = F.broadcast if is_small(asked) else (lambda rows: rows)
    wanted = saved(post.join(sent(asked.select(*own, "term").distinct()), [*own, "term"], "left_semi"))
    lengths = document_lengths(post, key, docs) if lengths is None else lengths
    totals = corpus_totals(lengths, by)
    terms = term_idf(wanted, totals, by)
    # The postings stream; what travels is the batch of queries and the statistics
    # of its terms, which are no more than the batch's rows, while those are few.
    weighted = wanted.join(sent(terms), [*by, "term"]).join(lengths, [*key])
    weighted = weighted.join(totals, by) if by else weighted.crossJoin(totals)  # one row of totals
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    met = weighted.select(*key, "term", part.alias("part")).join(sent(asked), [*own, "term"])
    return met.groupBy(*query_key, *key).agg(F.sum(F.col("qtf") * F.col("part")).alias("score"))


def coverage(queries: DataFrame, post: DataFrame, key: Sequence[str], query_key: Sequence[str] = ("query_id",), text: str = "query", code: bool = False) -> DataFrame:
    """``query_key... key... coverage``: the share of a query's informative terms in a document."""
    terms = F.concat(T.tokenize(F.col(text)), T.subtokens(F.col(text))) if code else T.tokenize(F.col(text))
    asked = queries.select(*query_key, T.informative(terms).alias("q"))
    each = asked.select(*query_key, F.greatest(F.size("q"), F.lit(1)).alias("n"), F.explode("q").alias("term"))
    met = each.join(post.select(*key, "term"), "term")
    return met.groupBy(*query_key, *key).agg((F.count("*") / F.first("n")).alias("coverage"))


def top(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",), score: str = "score", ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best rows of each group, with ``rank`` from 1; ties by the columns given.

    Scores that agree to nine digits are ties: sums may run in any order.
    """
    order = Window.partitionBy(*by).orderBy(F.round(score, 9).desc(), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """All rows, with ``rank`` from 1 in each group, however many rows a group has.

    No task sorts a group: rows fall into ranges of group and order, are
    numbered in their range, and start where their group's ranges before end.
    The ranges are saved, since a second look would draw other borders.
    """
    part, first = "__part", "__first"
    ranges = max(MIN_RANGES, -(-rows.count() // RANGE_ROWS))
    dealt = saved(rows.repartitionByRange(ranges, *by, *order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(*by, part).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [part, *by]
    starts = counts.select(*(F.col(c).alias(f"__{c}") for c in keys), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    placed = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]  # a null group is a group
    return placed.join(starts, same).withColumn("rank", (F.col("rank") + F.col(first)).cast("int")).drop(part, first, *(f"__{c}" for c in keys))


def bm25f(queries: DataFrame, fields: Sequence[tuple[DataFrame, float]], key: Sequence[str], query_key: Sequence[str] = ("query_id",)) -> DataFrame:
    """Weighted sum of the BM25 scores of several fields' postings."""
    parts = [bm25(queries, post, key, query_key=query_key).withColumn("score", F.col("score") * weight) for post, weight in fields]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy(*query_key, *key).agg(F.sum("score").alias("score"))
