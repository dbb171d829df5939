"""Staleness over a graph of decisions and plans: causes, spread, explanations.

Tables: ``nodes`` (project id kind relpath title status body_hash updated),
``deps`` (project id dep checked: the dep's hash when last verified, null if
never), ``sources`` (project id ref heading hash) and ``sections`` (project ref
heading hash: what the cited sections are now).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotweave.functions import text as T
from knotweave.storage import saved

from . import graph

SOURCE_KINDS = ("source-changed", "source-missing")
FINISHED = ("done", "verified")


def load(notes: DataFrame) -> DataFrame:
    """Design and plan notes with an id as nodes; a missing status is active or todo."""
    kind = F.when(F.col("store") == "plans", "plan").when(F.col("store") == "design", "design")
    default = F.when(F.col("store") == "plans", "todo").otherwise("active")
    return notes.where(F.col("id").isNotNull()).withColumn("kind", kind).where("kind is not null").withColumn("status", F.coalesce("status", default)).withColumn("body_hash", T.body_hash(F.col("body")))


def source_label(ref: Column, heading: Column) -> Column:
    return F.when(F.coalesce(heading, F.lit("")) == "", ref).otherwise(F.concat(ref, F.lit("#"), heading))


def direct_causes(nodes: DataFrame, deps: DataFrame, sources: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """``project id cause dep label``: why a node's own edges are out of date.

    Six causes: dep-deleted, new-unverified-edge, dep-superseded, dep-edited,
    source-missing, source-changed. A proposed dep gives none, and neither does
    a citation without a recorded hash whose section exists. Without
    ``sources`` this is the gating view.
    """
    target = nodes.select("project", F.col("id").alias("dep"), F.col("title").alias("__title"), F.col("status").alias("__status"), F.col("body_hash").alias("__hash"))
    met = nodes.select("project", "id").join(deps, ["project", "id"]).join(target, ["project", "dep"], "left")
    gone = F.col("__hash").isNull() & F.col("__status").isNull()
    cause = (
        F.when(gone, "dep-deleted")
        .when(F.col("__status") == "proposed", None)
        .when(F.col("checked").isNull(), "new-unverified-edge")
        .when(F.col("checked") != F.col("__hash"), F.when(F.col("__status") == "superseded", "dep-superseded").otherwise("dep-edited"))
    )
    out = met.select("project", "id", cause.alias("cause"), "dep", F.coalesce("__title", "dep").alias("label")).where("cause is not null")
    if sources is not None:
        now = sections.select("project", "ref", F.coalesce("heading", F.lit("")).alias("__h"), F.col("hash").alias("__now"))
        cited = nodes.select("project", "id").join(sources, ["project", "id"]).withColumn("__h", F.coalesce("heading", F.lit(""))).join(now, ["project", "ref", "__h"], "left")
        why = F.when(F.col("__now").isNull(), "source-missing").when((F.coalesce("hash", F.lit("")) != "") & (F.col("hash") != F.col("__now")), "source-changed")
        out = out.unionByName(cited.select("project", "id", why.alias("cause"), F.lit(None).cast(out.schema["dep"].dataType).alias("dep"), source_label(F.col("ref"), F.col("heading")).alias("label")).where("cause is not null"))
    return out


def tainted(nodes: DataFrame, deps: DataFrame, causes: DataFrame) -> DataFrame:
    """``project id``: nodes with a cause, or with a dep that is tainted and not proposed.

    A fixpoint of semi-joins along reversed edges; it stops when nothing is new.
    Edges to what is tainted already have nothing to tell and are dropped after
    each step, so that all steps together write little more than the edges.
    """
    spreads = nodes.where("status <> 'proposed'").select("project", F.col("id").alias("from"))
    known = nodes.select("project", F.col("id").alias("to"))
    seen = frontier = saved(causes.select("project", "id").distinct())
    edges = deps.select("project", F.col("dep").alias("from"), F.col("id").alias("to")).distinct()
    edges = edges.join(spreads, ["project", "from"], "left_semi").join(known, ["project", "to"], "left_semi")
    while True:
        edges = saved(edges.join(frontier.withColumnRenamed("id", "to"), ["project", "to"], "left_anti").select("project", "from", "to"))
        live = edges.join(frontier.withColumnRenamed("id", "from"), ["project", "from"], "left_semi")
        frontier = saved(live.select("project", F.col("to").alias("id")).distinct())
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def chains(nodes: DataFrame, deps: DataFrame, causes: DataFrame, marked: DataFrame, depth: int | None = None) -> DataFrame:
    """``project id chain cause dep label``: every path from a tainted node to a direct cause.

    Paths follow tainted deps that are not proposed and visit no node twice; a
    citation ends its chain with its own label. Chains may be of any length: a
    step lengthens all of them by one, until none grows, or after ``depth`` steps
    if only chains of so many deps are asked for.
    """
    titles = nodes.select("project", "id", "title", "status")
    onto = titles.where("status <> 'proposed'").join(marked, ["project", "id"], "left_semi").select("project", F.col("id").alias("dep"), "title")
    # each dep brings its title: a path is shuffled once for each step
    through = saved(deps.select("project", F.col("id").alias("__at"), "dep").distinct().join(onto, ["project", "dep"]))
    level = marked.join(titles, ["project", "id"]).select("project", "id", F.col("id").alias("__at"), F.array("id").alias("__path"), F.array("title").alias("chain"))
    paths = level
    while depth is None or depth > 0:
        depth = depth and depth - 1
        grown = level.join(through, ["project", "__at"]).where(~F.array_contains("__path", F.col("dep")))
        level = saved(grown.select("project", "id", F.col("dep").alias("__at"), F.concat("__path", F.array("dep")).alias("__path"), F.concat("chain", F.array("title")).alias("chain")))
        if level.isEmpty():
            break
        paths = paths.unionByName(level)
    ends = causes.select("project", F.col("id").alias("__at"), "cause", "dep", "label")
    cited = F.col("cause").isin(*SOURCE_KINDS)
    return paths.join(ends, ["project", "__at"]).select("project", "id", F.when(cited, F.concat("chain", F.array("label"))).otherwise(F.col("chain")).alias("chain"), "cause", "dep", "label")


def missing_deps(nodes: DataFrame, deps: DataFrame, notes: DataFrame) -> DataFrame:
    """``project id dep note``: deps that are no node; ``note`` where a plain note has the id."""
    lost = deps.join(nodes.select("project", F.col("id").alias("dep")), ["project", "dep"], "left_anti")
    named = notes.select("project", F.col("id").alias("dep"), F.lit(True).alias("note")).distinct()
    return lost.join(named, ["project", "dep"], "left").select("project", "id", "dep", F.coalesce("note", F.lit(False)).alias("note"))


def check(nodes: DataFrame, causes: DataFrame, marked: DataFrame) -> DataFrame:
    """Tainted designs and proposed entries with what to do next, by title."""
    own = causes.groupBy("project", "id").agg(F.array_sort(F.collect_set("cause")).alias("causes"), F.min(F.col("cause").isin(*SOURCE_KINDS)).alias("only_sources"))
    joined = nodes.where("kind = 'design'").join(marked.withColumn("tainted", F.lit(True)), ["project", "id"], "left").join(own, ["project", "id"], "left")
    verb = F.when(F.col("status") == "proposed", "promote").when(F.col("only_sources"), "re-read the source, then reaffirm").otherwise("reconsider, then reaffirm or supersede")
    return joined.where("tainted or status = 'proposed'").select("project", "id", "title", "status", F.coalesce("tainted", F.lit(False)).alias("tainted"), F.coalesce("causes", F.array().cast("array<string>")).alias("causes"), verb.alias("next")).orderBy("project", "title", "id")


def listing(nodes: DataFrame, deps: DataFrame, marked: DataFrame, kind: str = "design") -> DataFrame:
    """A facet's nodes with taint flag and edge counts."""
    own = nodes.where(F.col("kind") == kind)
    counts = graph.degrees(own.select(F.col("id").alias("node")), deps.select(F.col("id").alias("src"), F.col("dep").alias("dst")))
    flagged = own.join(marked.withColumn("tainted", F.lit(True)), ["project", "id"], "left").withColumn("tainted", F.coalesce("tainted", F.lit(False)))
    return flagged.join(counts.withColumnRenamed("node", "id"), "id").select("project", "id", "title", "status", "tainted", F.col("deps").alias("n_deps"), F.col("dependents").alias("n_dependents"))


def dossier(nodes: DataFrame, deps: DataFrame, marked: DataFrame, refs: DataFrame) -> DataFrame:
    """Decisions (``refs``: project id) with annotated deps and dependents."""
    about = nodes.join(marked.withColumn("tainted", F.lit(True)), ["project", "id"], "left").select("project", F.col("id").alias("other"), "title", "relpath", "status", F.coalesce("tainted", F.lit(False)).alias("tainted"))
    both = deps.select("project", "id", F.col("dep").alias("other"), F.lit("dep").alias("edge")).union(deps.select("project", F.col("dep").alias("id"), F.col("id").alias("other"), F.lit("dependent").alias("edge")))
    found = refs.join(both, ["project", "id"]).join(about, ["project", "other"], "left")
    return found.select("project", "id", "edge", "other", F.coalesce("title", F.concat("other", F.lit(" (missing)"))).alias("title"), "relpath", "status", F.coalesce("tainted", F.lit(True)).alias("tainted"))


def newly_tainted(before: DataFrame, after: DataFrame) -> DataFrame:
    return after.join(before, ["project", "id"], "left_anti")


def reaffirm(deps: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Deps with the checked hashes of the given nodes (project id) recorded anew."""
    now = nodes.select("project", F.col("id").alias("dep"), F.col("body_hash").alias("__now"))
    asked = ids.select("project", "id", F.lit(True).alias("__asked")).distinct()
    out = deps.join(asked, ["project", "id"], "left").join(now, ["project", "dep"], "left")
    return out.withColumn("checked", F.when(F.col("__asked") & F.col("__now").isNotNull(), F.col("__now")).otherwise(F.col("checked"))).select(*deps.columns)


def reaffirm_sources(sources: DataFrame, sections: DataFrame, ids: DataFrame) -> DataFrame:
    """Citations of the given nodes with the hashes that their sections have now."""
    now = sections.select("project", "ref", F.coalesce("heading", F.lit("")).alias("__h"), F.col("hash").alias("__now"))
    asked = ids.select("project", "id", F.lit(True).alias("__asked")).distinct()
    out = sources.withColumn("__h", F.coalesce("heading", F.lit(""))).join(asked, ["project", "id"], "left").join(now, ["project", "ref", "__h"], "left")
    return out.withColumn("hash", F.when(F.col("__asked") & F.col("__now").isNotNull(), F.col("__now")).otherwise(F.col("hash"))).select(*sources.columns)


def set_status(nodes: DataFrame, ids: DataFrame, status: str, only_from: str | None = None) -> DataFrame:
    """Nodes (project id) given a status, if they have the one to start from."""
    asked = ids.select("project", "id", F.lit(True).alias("__asked")).distinct()
    may = F.coalesce("__asked", F.lit(False)) & (F.lit(only_from is None) | (F.col("status") == F.lit(only_from or "")))
    return nodes.join(asked, ["project", "id"], "left").withColumn("status", F.when(may, status).otherwise(F.col("status"))).select(*nodes.columns)


def promote(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return set_status(nodes, ids, "active", "proposed")


def supersede(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mark ``id`` superseded by ``by`` (null: by nothing in particular)."""
    out = nodes.join(pairs.select("project", "id", F.col("by").alias("__by"), F.lit(True).alias("__asked")), ["project", "id"], "left")
    was = F.col("superseded_by") if "superseded_by" in nodes.columns else F.lit(None).cast("string")
    return out.withColumn("superseded_by", F.when(F.col("__asked"), F.col("__by")).otherwise(was)).withColumn("status", F.when(F.col("__asked"), "superseded").otherwise(F.col("status"))).drop("__by", "__asked")


def add_deps(deps: DataFrame, new: DataFrame, nodes: DataFrame, verified: bool) -> DataFrame:
    """Deps with new edges (project id dep): verified at birth, or unverified later.

    An edge that would close a cycle is an error.
    """
    now = nodes.select("project", F.col("id").alias("dep"), F.col("body_hash").alias("checked"))
    fresh = new.join(deps.select("project", "id", "dep"), ["project", "id", "dep"], "left_anti").join(now, ["project", "dep"], "left")
    out = deps.unionByName(fresh.select("project", "id", "dep", (F.col("checked") if verified else F.lit(None).cast("string")).alias("checked")))
    loops = graph.cycles(out.select(F.concat_ws("\x00", "project", "id").alias("src"), F.concat_ws("\x00", "project", "dep").alias("dst")))
    if not loops.isEmpty():
        raise ValueError("a dep would close a cycle")
    return out


def remove_deps(deps: DataFrame, gone: DataFrame) -> DataFrame:
    return deps.join(gone.select("project", "id", "dep"), ["project", "id", "dep"], "left_anti")


def forget(nodes: DataFrame, deps: DataFrame, ids: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(remaining nodes, refused ones): nodes that others depend on stay unless forced."""
    needed = deps.select("project", F.col("dep").alias("id")).distinct()
    refused = ids.join(needed, ["project", "id"], "left_semi") if not force else ids.limit(0)
    gone = ids.join(needed, ["project", "id"], "left_anti") if not force else ids
    return nodes.join(gone, ["project", "id"], "left_anti"), refused


def resolve(refs: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """``project ref id status``: nodes by id, path, title or slug, else by id prefix.

    Several of the best kind of match are ambiguous; a match in the other facet
    only is ``wrong-facet``; nothing is ``unknown``.
    """
    name = F.regexp_replace("relpath", r"^.*/|\.md$", "")
    spelt = nodes.select("project", "id", "kind", F.explode(F.array(F.struct(F.lit(0).alias("p"), F.col("id").alias("s")), F.struct(F.lit(0).alias("p"), F.col("relpath").alias("s")), F.struct(F.lit(0).alias("p"), F.lower("title").alias("s")), F.struct(F.lit(0).alias("p"), name.alias("s")))).alias("x")).select("project", "id", "kind", "x.p", "x.s")
    typed = refs.select("project", "ref", F.explode(F.array_distinct(F.array(F.col("ref"), F.lower("ref"), T.slug(F.col("ref"))))).alias("s"))
    exact = typed.join(spelt, ["project", "s"]).select("project", "ref", "id", "kind", "p").distinct()
    prefix = refs.join(nodes, "project").where((F.length("ref") >= 4) & F.col("id").startswith(F.col("ref"))).select("project", "ref", "id", "kind", F.lit(1).alias("p"))
    own = exact.union(prefix).withColumn("__own", F.col("kind") == kind)
    best = own.groupBy("project", "ref").agg(F.min(F.when(F.col("__own"), F.col("p"))).alias("__p"))
    hits = own.join(best, ["project", "ref"]).groupBy("project", "ref").agg(F.collect_set(F.when(F.col("__own") & (F.col("p") == F.col("__p")), F.col("id"))).alias("ids"), F.count("*").alias("any"))
    status = F.when(F.size("ids") == 1, "ok").when(F.size("ids") > 1, "ambiguous").when(F.coalesce("any", F.lit(0)) > 0, "wrong-facet").otherwise("unknown")
    return refs.join(hits, ["project", "ref"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>"))).select("project", "ref", F.when(F.size("ids") == 1, F.col("ids")[0]).alias("id"), status.alias("status"))


def resolve_sections(cited: DataFrame, sections: DataFrame) -> DataFrame:
    """``project ref heading section status``: exact, else the only suffix, else the only part.

    ``sections``: project ref heading (path). Documents join by ref; headings
    are compared in any case.
    """
    met = cited.join(sections.select("project", "ref", F.col("heading").alias("__path")), ["project", "ref"], "left")
    last = F.lower(F.element_at(F.split("__path", "/"), -1))
    tier = F.when(F.col("__path") == F.col("heading"), 0).when(T.heading_suffix(F.col("__path"), F.col("heading")), 1).when(F.contains(last, F.lower("heading")), 2)
    tiered = met.withColumn("__t", tier)
    best = tiered.groupBy("project", "ref", "heading").agg(F.min("__t").alias("__b"))
    hits = tiered.join(best, ["project", "ref", "heading"]).groupBy("project", "ref", "heading").agg(F.collect_set(F.when(F.col("__t") == F.col("__b"), F.col("__path"))).alias("s"), F.max(F.col("__path").isNotNull()).alias("doc"))
    status = F.when(~F.col("doc"), "no-document").when(F.size("s") == 0, "no-section").when(F.size("s") > 1, "ambiguous").otherwise("ok")
    return hits.select("project", "ref", "heading", F.when(F.size("s") == 1, F.col("s")[0]).alias("section"), status.alias("status"))


def resolve_docs(refs: DataFrame, docs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``project ref relpath status``: exact, else a legacy alias, else the only path suffix."""
    names = docs.select("project", "relpath", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("relpath", "/"))), lambda n: F.array_join(F.slice(F.split("relpath", "/"), -n, n), "/"))).alias("ref")).withColumn("p", F.when(F.col("ref") == F.col("relpath"), 0).otherwise(2))
    if aliases is not None:
        names = names.unionByName(aliases.select("project", "relpath", F.col("alias").alias("ref"), F.lit(1).alias("p")))
    met = refs.join(names, ["project", "ref"], "left")
    best = met.groupBy("project", "ref").agg(F.min("p").alias("__b"))
    hits = met.join(best, ["project", "ref"]).groupBy("project", "ref").agg(F.collect_set(F.when(F.col("p") == F.col("__b"), F.col("relpath"))).alias("r"))
    return hits.select("project", "ref", F.when(F.size("r") == 1, F.col("r")[0]).alias("relpath"), F.when(F.size("r") == 1, "ok").when(F.size("r") > 1, "ambiguous").otherwise("unknown").alias("status"))


def prepare_import(sections: DataFrame, sources: DataFrame) -> DataFrame:
    """A document's sections with hash, word count, preview and who cites them already."""
    citing = sources.groupBy("project", "ref", "heading").agg(F.array_sort(F.collect_set("id")).alias("cited_by"))
    words = T.py_words(F.col("text"))
    out = sections.join(citing, ["project", "ref", "heading"], "left")
    return out.select("project", "ref", "heading", "hash", F.size(words).alias("words"), F.array_join(F.slice(words, 1, 24), " ").alias("preview"), F.coalesce("cited_by", F.array().cast("array<string>")).alias("cited_by"))


def capture(specs: DataFrame) -> DataFrame:
    """Resolved citations, one for each label, in the order given (``position``)."""
    first = specs.withColumn("label", source_label(F.col("ref"), F.col("heading"))).groupBy("project", "id", "label").agg(F.min_by(F.struct("ref", "heading", "hash", "position"), "position").alias("s"))
    return first.select("project", "id", "label", "s.ref", "s.heading", "s.hash", "s.position")


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Citations with new ones; those there keep the hashes they were captured with."""
    key = ["project", "id", "ref", "heading"]
    same = [sources[c].eqNullSafe(new[c]) for c in key]
    return sources.unionByName(new.join(sources, same, "left_anti").select(*sources.columns))
