"""Lookups: filters, dense neighbours, fused hits, dedupe, spans, taint marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.functions import symbols as S
from knotweave.functions import text as T
from knotweave.functions import vectors as V
from knotweave.storage import SMALL_BYTES, SMALL_ROWS, broadcast_if_small, is_small, saved

from . import batch, fusion, lexical

MAX_K, DEFAULT_K, MAX_DEPTH = 200, 8, 25
SNIPPET = 280
#: Queries up to which a batch meets the rows as one matrix; more meet them by joins.
BATCH = 20_000
#: Tasks at least among which one (project, store) is dealt where its queries are too many to travel.
SALTS = 64


def check_arguments(k: int, query: str | None = None, depth: int = 0) -> None:
    """Reject what no lookup can answer."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}")
    if query is not None and not query.strip():
        raise ValueError("the query is blank")
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be 0 to {MAX_DEPTH}")


def where_equal(rows: DataFrame, **meta: object) -> DataFrame:
    """Rows whose columns all equal the values given."""
    out = rows
    for column, value in meta.items():
        out = out.where(F.col(column) == F.lit(value))
    return out


def in_store(rows: DataFrame, store: str) -> DataFrame:
    """Rows of one pillar; those without a store are notes."""
    return rows.where(F.coalesce("store", F.lit("notes")) == store)


def with_tags(hits: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Hits that carry any of the tags, as a tag or as their type; no tags keep all."""
    if not tags:
        return hits
    own = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array("type"))
    return hits.where(F.arrays_overlap(own, F.array(*map(F.lit, tags))))


def above(hits: DataFrame, floor: float = 0.0) -> DataFrame:
    """Hits whose score is strictly above the floor."""
    return hits.where(F.col("score") > floor)


def narrow(entries: DataFrame, path: str = "", scope: str = "", lang: str = "") -> DataFrame:
    """Symbols of a language, path tail or scope tail; every field given is a constraint."""
    out = entries.where(F.col("lang") == lang) if lang else entries
    if path:
        out = out.where(S.path_matches(F.coalesce("file", F.lit("")), F.lit(path)))
    return out.where(S.scope_matches(F.col("scope"), F.lit(scope))) if scope else out


def _travel(asked: DataFrame) -> bool:
    """Whether a batch of queries may be broadcast.

    All vectors of a batch have one length, which its first row tells, so rows
    are counted without computing their vectors.
    """
    first = asked.where("__q is not null").select(F.size("__q").alias("n")).first()
    wide = 8 * first.n + 64 if first else 64
    return is_small(asked.drop("__q"), min(SMALL_ROWS, SMALL_BYTES // wide))


def knn(queries: DataFrame, corpus: DataFrame, k: int, key: Sequence[str], query_key: Sequence[str] = ("query_id",), on: Sequence[str] = (), vector: str = "v", exclude_self: Column | None = None) -> DataFrame:
    """``query_key... key... cosine rank``: exact nearest unit vectors.

    ``on`` names columns that both sides share and must agree in (project,
    store). ``exclude_self`` is a condition for pairs to leave out. Each task
    keeps its ``k`` best of a query before anything is shuffled. Few queries
    travel to the rows where they lie. Many are sent to each of ``SALTS`` shares
    of the rows, so that no task gets all rows of one project and store.
    """
    asked = queries.select(*query_key, *(c for c in on if c not in query_key), F.col(vector).alias("__q"))
    rows = corpus.select(*key, *(c for c in on if c not in key), F.col(vector).alias("__v"))
    if _travel(asked):
        sent = F.broadcast(asked)
        met = rows.join(sent, [*on]) if on else rows.crossJoin(sent)
    else:
        shares = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        dealt = rows.withColumn("__share", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int"))
        met = dealt.join(asked.withColumn("__share", shares), [*on, "__share"])
    if exclude_self is not None:
        met = met.where(~exclude_self)
    scored = met.select(*query_key, *key, V.dot(F.col("__q"), F.col("__v")).alias("cosine"))
    return lexical.top(scored, k, query_key, "cosine", key)


def firsts(hits: DataFrame, mode: str = "section", by: Sequence[str] = ("query_id",), order: Sequence[str | Column] = ("rank",)) -> DataFrame:
    """First hit of each section (occurrences count as one) or file; ``none`` keeps all."""
    keys = {"section": ["store", "relpath", "heading_path"], "file": ["store", "relpath"], "none": None}[mode]
    if not keys:
        return hits
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(*by, *keys).orderBy(*order))).where("__n = 1").drop("__n")


def dedupe(hits: DataFrame, mode: str = "section", by: Sequence[str] = ("query_id",)) -> DataFrame:
    """First hit of each section (occurrences count as one) or file, ranks renewed.

    A query's hits meet in one task: for pools of lookups, not for whole tables.
    """
    return firsts(hits, mode, by).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("rank")))


def with_spans(hits: DataFrame, line_map: DataFrame) -> DataFrame:
    """Lines of each hit's section in the current file; null where it is gone."""
    key = T.section_key(F.split("heading_path", "/"), F.coalesce("occurrence", F.lit(1)))
    spans = line_map.select("project", "store", "relpath", F.col("section_key").alias("__key"), "start_line", "end_line")
    return hits.withColumn("__key", key).join(spans, ["project", "store", "relpath", "__key"], "left").drop("__key")


def with_taint(hits: DataFrame, tainted: DataFrame) -> DataFrame:
    """Mark design hits whose note is tainted (``tainted``: project, relpath)."""
    marks = tainted.select("project", "relpath", F.lit("design").alias("store"), F.lit(True).alias("tainted")).distinct()
    return hits.join(marks, ["project", "relpath", "store"], "left").withColumn("tainted", F.coalesce("tainted", F.lit(False)))


def snippet(text: Column) -> Column:
    return F.substring(text, 1, SNIPPET)


def lookup(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = DEFAULT_K, terms: DataFrame | None = None, term_weight: float = 0.3, aliases: DataFrame | None = None, alias_weight: float = 1.0, scorer: Column | None = None, tags: Sequence[str] = (), floor: float = 0.0, mode: str = "section", hybrid: bool = True, embed=V.hash_embedding, beta: float = fusion.NOTES_BETA) -> DataFrame:
    """The retrieval pipeline for a batch of queries.

    ``queries``: query_id project store query. ``chunks``: chunk_id project
    store relpath heading_path (joined by ``/``) occurrence section_hash
    document tags type. ``vectors``: chunk_id v, of the index text. ``terms``
    (section_hash, terms) weigh in sparsely; ``aliases`` (section_hash, v) meet
    queries by cosine and credit the section's first chunk. ``scorer`` re-ranks
    the head from the columns ``query`` and ``document``.

    Dense pool, sparse pool, fusion, re-ranking, floor and tags (both after the
    ranking), dedupe, then the first ``k``. A batch of at most ``BATCH`` queries
    meets vectors and texts where they lie (:mod:`.batch`), but for the sparse
    side of one with ``terms``.
    """
    check_arguments(k)
    n = fusion.pool_size(k, hybrid, mode)
    scope = ["project", "store"]
    asked = saved(queries.withColumn("v", embed(F.col("query"))))
    rows = chunks.select("chunk_id", *scope).join(vectors.select("chunk_id", "v"), "chunk_id")
    pair, few = ["query_id", "chunk_id"], is_small(asked, BATCH)
    if few:
        dense = batch.nearest(asked.withColumnRenamed("v", "q"), rows, ["chunk_id"], n, corpus=scope)
    else:
        dense = knn(asked, rows, n, ["chunk_id"], on=scope)
    dense = saved(dense.select(*pair, "cosine"))
    if hybrid:
        own, text = [*scope, "chunk_id"], T.lexical_text(F.col("heading_path"), F.col("document"))
        alias = None
        if aliases is not None:
            by_section = aliases.join(chunks.select(*scope, "section_hash").distinct(), "section_hash")
            near = asked.select("query_id", *scope, F.col("v").alias("q")).join(by_section, scope).select("query_id", F.col("section_hash").alias("section"), V.dot(F.col("q"), F.col("v")).alias("cosine"))
            alias = saved(fusion.alias_merge(near, chunks.select(F.col("section_hash").alias("section"), "chunk_id", "window_idx"), alias_weight))
        if few and (terms is None or term_weight <= 0):
            met = batch.Terms(queries, chunks, ["chunk_id"], text, corpus=scope)
            best = saved(met.best(n, score="sparse").drop("rank"))
            # Of other pairs only those that the pool holds besides have to know their score.
            others = (dense if alias is None else dense.unionByName(alias)).select(*pair).distinct()
            others = others.join(broadcast_if_small(best.select(*pair)), pair, "left_anti")
            sparse = saved(best.unionByName(met.scores(others, score="sparse")))
        else:
            # Only postings of the batch's terms leave the texts; lengths are counted where the texts lie.
            post = lexical.postings(chunks, own, text, terms=lexical.query_terms(queries, ["query_id", *scope]))
            lengths = chunks.select(*own, F.size(T.tokenize(text)).cast("double").alias("len"))
            if terms is not None and term_weight > 0:
                more = chunks.select(*own, "section_hash").join(terms, "section_hash")
                post = lexical.enrich(post, own, more, term_weight)
                lengths = lexical.enriched_lengths(lengths, own, more, term_weight)
            sparse = saved(lexical.bm25(queries, post, own, corpus=scope, lengths=lengths).select(*pair, F.col("score").alias("sparse")))
        # Only members of the pool that have no cosine yet take it from their body: no other text is embedded.
        members = lexical.top(sparse.where("sparse > 0"), n, score="sparse", ties=["chunk_id"]).select(*pair)
        members = saved(members.join(dense.where("cosine is not null").select(*pair), pair, "left_anti"))
        found = chunks.select("chunk_id", "document").join(broadcast_if_small(members.select("chunk_id").distinct()), "chunk_id", "left_semi")
        body = saved(found.select("chunk_id", embed(F.col("document")).alias("b")))
        back = members.join(asked.select("query_id", "v"), "query_id").join(body, "chunk_id").select(*pair, V.dot(F.col("v"), F.col("b")).alias("cosine"))
        hits = fusion.fuse(dense, sparse, ["chunk_id"], n, beta, back, alias=alias)
    else:
        hits = dense.withColumns({"score": F.round("cosine", 4), "rank": F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "chunk_id"))})
    hits = chunks.join(broadcast_if_small(saved(hits)), "chunk_id").join(asked.select("query_id", "query"), "query_id")
    if scorer is not None:
        hits = fusion.rerank(hits, scorer, ties=["chunk_id"])
    hits = dedupe(with_tags(above(hits, floor), tags), mode)
    return hits.where(F.col("rank") <= k).withColumn("snippet", snippet(F.col("document")))


def code_lookup(queries: DataFrame, symbols: DataFrame, vectors: DataFrame, k: int = DEFAULT_K, scorer: Column | None = None, embed=V.hash_embedding) -> DataFrame:
    """Symbols for a batch of queries: dense descriptions, gated names and keywords.

    ``symbols``: symbol_ref project name fqn name_terms keywords description;
    ``vectors``: symbol_ref v for the described ones.
    """
    check_arguments(k)
    key = ["symbol_ref"]
    asked = queries.withColumn("v", embed(F.col("query")))
    dense = knn(asked, symbols.join(vectors, "symbol_ref"), fusion.CODE_POOL, key, on=["project"]).select("query_id", *key, "cosine")
    field = F.concat_ws(" ", "name", "fqn", F.array_join(F.coalesce("name_terms", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "))
    own = ["project", *key]
    post = saved(lexical.postings(symbols, own, field, code=True, terms=lexical.query_terms(queries, ["query_id", "project"], code=True)))
    lengths = symbols.select(*own, (F.size(T.tokenize(field)) + F.size(T.subtokens(field))).cast("double").alias("len"))
    sparse = lexical.bm25(queries, post, own, corpus=["project"], code=True, lengths=lengths).select("query_id", *key, F.col("score").alias("sparse"))
    share = lexical.coverage(queries, post, key, code=True)
    hits = fusion.fuse_code(dense, sparse, share, vectors, key).join(symbols, key).join(queries.select("query_id", "query"), "query_id")
    if scorer is not None:
        hits = fusion.rerank(hits.withColumn("document", F.concat_ws(": ", "fqn", "description")), scorer, ties=key)
    return hits.where(F.col("rank") <= k)


def inventory(chunks: DataFrame, prefix: str = "") -> DataFrame:
    """Indexed projects and paths, under a prefix."""
    return chunks.where(F.col("relpath").startswith(prefix)).select("project", "store", "relpath").distinct()
