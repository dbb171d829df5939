"""Incremental maintenance of the index: diffs, upserts, pruning, carry-forward."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BULK_SECTIONS = 10
DUPLICATE_SCORE = 0.85
DIRTY = ""


def plan(fresh: DataFrame, stored: DataFrame, key: str = "chunk_id", meta: Sequence[str] = ()) -> DataFrame:
    """What each chunk needs: ``embed`` (new or changed), ``delete`` (gone), ``meta`` or ``noop``.

    Both sides have the key and ``content_hash``; ``meta`` lists metadata
    columns that are patched when only they differ (``file_mtime`` is none).
    """
    new = fresh.select(key, F.col("content_hash").alias("__new"), F.struct(*meta, F.lit(1)).alias("__m"))
    old = stored.select(key, F.col("content_hash").alias("__old"), F.struct(*meta, F.lit(1)).alias("__o"))
    both = new.join(old, key, "full")
    action = (
        F.when(F.col("__new").isNull(), "delete")
        .when(F.col("__old").isNull() | (F.col("__old") != F.col("__new")), "embed")
        .when(~F.col("__m").eqNullSafe(F.col("__o")), "meta")
        .otherwise("noop")
    )
    return both.select(key, action.alias("action"))


def apply(stored: DataFrame, fresh: DataFrame, actions: DataFrame, key: str = "chunk_id", keep: Sequence[str] = ("v",)) -> DataFrame:
    """The next snapshot. Unchanged chunks keep the ``keep`` columns they stored."""
    live = actions.where("action <> 'delete'")
    old = stored.select(key, *(F.col(c).alias(f"__{c}") for c in keep))
    joined = fresh.join(live, key).join(old, key, "left")
    for c in keep:
        joined = joined.withColumn(c, F.when(F.col("action") != "embed", F.col(f"__{c}")).otherwise(F.col(c)) if c in fresh.columns else F.when(F.col("action") != "embed", F.col(f"__{c}")))
    return joined.drop(*(f"__{c}" for c in keep))


def targets(on_disk: DataFrame, indexed: DataFrame, exclude_prefix: str = "sources/") -> DataFrame:
    """Paths that a full reconcile looks at: on disk or indexed, source-owned ones aside."""
    paths = on_disk.select("project", "store", "relpath").union(indexed.select("project", "store", "relpath")).distinct()
    return paths.where(~F.col("relpath").startswith(exclude_prefix))


def missing_files(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Chunks whose file is gone."""
    return indexed.join(on_disk.select("project", "store", "relpath").distinct(), ["project", "store", "relpath"], "left_anti")


def forget(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """The snapshot without the paths given, whatever is on disk."""
    return stored.join(gone.select("project", "store", "relpath").distinct(), ["project", "store", "relpath"], "left_anti")


def rebuilds(stored: DataFrame, dim: int) -> DataFrame:
    """Projects whose vectors have another dimension and must be embedded anew."""
    return stored.groupBy("project").agg(F.max(F.size("v") != dim).alias("index_rebuilding"))


def schema_sweep(markers: DataFrame, current: int) -> DataFrame:
    """Projects whose stored chunk schema is not the current one."""
    return markers.where(~F.col("schema").eqNullSafe(F.lit(current))).select("project")


def duplicate_ids(notes: DataFrame) -> DataFrame:
    """Note ids that several paths own: ``id paths``, sorted."""
    owners = notes.where(F.col("id").isNotNull()).groupBy("id").agg(F.array_sort(F.collect_set("relpath")).alias("paths"))
    return owners.where(F.size("paths") > 1)


def split_readable(rows: DataFrame, error: str = "_error") -> tuple[DataFrame, DataFrame]:
    """(rows that parsed, a report of those that did not): a bad file stops nothing."""
    return rows.where(F.col(error).isNull()), rows.where(F.col(error).isNotNull())


def code_index(prior: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """The next symbols of re-extracted files, by (file, container, name).

    ``files``: file, file_hash, code_lines. A file of more than three lines of
    code that extracts to nothing keeps its prior symbols. A fresh symbol takes
    the prior description when its content is unchanged. A vanished symbol is
    deleted only if its file's bytes changed (or either hash is unknown); else
    it stays, dirty: its content_hash is blank.
    """
    on = ["file", "container", "name"]
    new = fresh.select(*on, F.col("content_hash").alias("__new"), F.lit(True).alias("__fresh"))
    old = prior.select(*on, F.col("content_hash").alias("__old"), F.col("description").alias("description"), F.col("file_hash").alias("__was"))
    seen = fresh.groupBy("file").agg(F.count("*").alias("__n"))
    both = new.join(old, on, "full").join(files, "file").join(seen, "file", "left")
    empty = F.coalesce("__n", F.lit(0)) == 0
    gone = F.col("__fresh").isNull()
    held = gone & empty & (F.col("code_lines") > 3)
    unchanged_bytes = (F.coalesce("__was", F.lit("")) != "") & (F.coalesce("file_hash", F.lit("")) != "") & (F.col("__was") == F.col("file_hash"))
    state = F.when(held, "kept").when(gone & unchanged_bytes, "dirty").when(gone, "deleted").when(F.col("__old").isNull(), "added").when(F.col("__old") == F.col("__new"), "same").otherwise("changed")
    out = both.withColumn("state", state).where("state <> 'deleted'")
    content = F.when(F.col("state") == "dirty", DIRTY).when(F.col("state") == "kept", F.col("__old")).otherwise(F.col("__new"))
    described = F.when(F.col("state").isin("same", "kept", "dirty"), F.col("description"))
    return out.select(*on, content.alias("content_hash"), described.alias("description"), "file_hash", "state")


def reverse_edges(calls: DataFrame) -> DataFrame:
    """``called_by`` derived from ``calls`` (caller, callee): never patched, always whole."""
    return calls.groupBy(F.col("callee").alias("symbol_ref")).agg(F.array_sort(F.collect_set("caller")).alias("called_by"))


def drop_file(symbols: DataFrame, file: str) -> DataFrame:
    """Without a file's symbols and without the edges that come from it."""
    from_file = f"[{file}]"
    cleaned = {c: F.filter(c, lambda e: ~e.endswith(from_file)) for c in ("called_by", "references") if c in symbols.columns}
    return symbols.where(F.col("file") != file).withColumns(cleaned)


def stale_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose source is newer than their oldest record, or that are dirty or gone."""
    state = symbols.groupBy("file").agg(F.min("mtime").alias("indexed"), F.max(F.col("content_hash") == DIRTY).alias("dirty"))
    joined = state.join(files.select("file", F.col("mtime").alias("source")), "file", "full")
    why = F.when(F.col("source").isNull(), "gone").when(F.col("indexed").isNull(), "new").when(F.col("source") > F.col("indexed"), "newer").when(F.col("dirty"), "dirty")
    return joined.select("file", why.alias("why")).where("why is not null")


def freshness(rows: DataFrame, mtime: str = "mtime") -> DataFrame:
    """A token that changes with the store: count and latest time."""
    return rows.agg(F.count("*").alias("n"), F.max(mtime).alias("latest"))


def undescribed(symbols: DataFrame) -> DataFrame:
    """Files with clean symbols that lack a description."""
    return symbols.where((F.col("content_hash") != DIRTY) & (F.coalesce("description", F.lit("")) == "")).select("project", "file").distinct()


def dirty_files(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("content_hash") == DIRTY).select("project", "file").distinct()


def budgeted(files: DataFrame, cost: str, budget: float, order: Sequence[str]) -> DataFrame:
    """Files that fit a budget in the given order, and the others as ``deferred``."""
    spent = F.sum(cost).over(Window.partitionBy("project").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("deferred", F.coalesce(spent, F.lit(0.0)) >= budget)


def orphan_terms(assets: DataFrame, live: DataFrame, started: Column) -> DataFrame:
    """Enrichment assets of no live section that are older than the pass."""
    return assets.join(live.select("section_hash").distinct(), "section_hash", "left_anti").where(F.col("mtime") < started)


def enrichment_targets(sections: DataFrame, labels: Sequence[str], assets: DataFrame) -> DataFrame:
    """One row for each different section and label that has no asset yet."""
    wanted = sections.dropDuplicates(["section_hash"]).withColumn("label", F.explode(F.array(*map(F.lit, labels))))
    return wanted.join(assets.select("section_hash", "label").distinct(), ["section_hash", "label"], "left_anti")


def batches(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: int = BULK_SECTIONS) -> DataFrame:
    """Number each document's rows into slices of ``size``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def convert_records(records: DataFrame, derived: dict[str, Column], target: Column, audit: Sequence[str]) -> DataFrame:
    """Re-key records: derived fields set, the others audited, collisions refused.

    ``status``: noop (nothing changes), convert, or collision (a record whose
    file name sorts earlier has the target).
    """
    before = F.struct(*derived, *audit)
    out = records.withColumn("__before", before).withColumns(derived).withColumn("target", target)
    first = F.row_number().over(Window.partitionBy("target").orderBy("filename"))
    same = F.struct(*derived, *audit).eqNullSafe(F.col("__before"))
    status = F.when(first > 1, "collision").when(same & (F.col("target") == F.col("filename")), "noop").otherwise("convert")
    return out.withColumn("status", status).drop("__before")


def migrate_layout(rows: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """Move paths and the citations of them from one prefix to another."""
    move = lambda c: F.when(c.startswith(old_prefix), F.concat(F.lit(new_prefix), F.substring(c, F.lit(len(old_prefix) + 1), F.length(c)))).otherwise(c)
    out = rows.withColumn("relpath", move(F.col("relpath")))
    return out.withColumn("sources", F.transform("sources", move)) if "sources" in rows.columns else out


def forget_project(rows: DataFrame, project: str, keep_stores: Sequence[str] = ()) -> DataFrame:
    """Without a project's rows, but for the stores to keep."""
    own = (F.col("project") == project) & ~F.coalesce(F.col("store").isin(*keep_stores) if keep_stores else F.lit(False), F.lit(False))
    return rows.where(~own)


def near_duplicate_probe(hits: DataFrame, score: float = DUPLICATE_SCORE) -> DataFrame:
    """Hits of a new note's first line that look like it: other paths, fused score high."""
    return hits.where((F.col("relpath") != F.col("own_relpath")) & (F.col("score") >= score))


def probe_query(body: Column) -> Column:
    """A note's first line with text, at most 200 characters."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.substring(F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")), 1, 200)


def append_note(body: Column, content: Column, heading: Column) -> Column:
    """A body with a block added, under a heading if one is given."""
    block = F.when(F.coalesce(heading, F.lit("")) == "", content).otherwise(F.concat(F.lit("## "), heading, F.lit("\n\n"), content))
    return F.concat(F.rtrim(F.coalesce(body, F.lit(""))), F.lit("\n\n"), block, F.lit("\n"))


def edit_note(old_front: Column, new_front: Column) -> Column:
    """Front matter after an edit: the old one stays if the input brings none."""
    return F.when(F.size(new_front) > 0, new_front).otherwise(old_front)


def free_paths(new: DataFrame, taken: DataFrame, order: Sequence[str], suffix: str = ".md") -> DataFrame:
    """Add ``relpath`` to new notes (``project store slug``): their slug, or ``slug-2`` and so on where that is taken.

    ``taken`` has project, store and relpath. New notes of one slug are numbered
    in the order given; each takes the least number that is still free.
    """
    by = ["project", "store", "slug"]
    stem = F.regexp_replace("relpath", f"{suffix.replace('.', '[.]')}$", "")
    tail = F.regexp_extract(stem, r"^(.+)-([0-9]{1,9})$", 2)
    named = taken.select("project", "store", F.explode(F.array(F.struct(stem.alias("slug"), F.lit(1).alias("n")), F.when(tail != "", F.struct(F.regexp_extract(stem, r"^(.+)-([0-9]{1,9})$", 1).alias("slug"), tail.cast("int").alias("n"))))).alias("t")).where("t is not null")
    used = named.select("project", "store", "t.slug", "t.n").join(new.select(*by).distinct(), by, "left_semi").groupBy(*by).agg(F.collect_set("n").alias("__used"))
    numbered = new.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).join(used, by, "left")
    own = F.coalesce("__used", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(1), F.size(own) + F.col("__k")), own)
    return numbered.withColumn("__n", F.element_at(free, F.col("__k"))).withColumn("relpath", F.concat("slug", F.when(F.col("__n") > 1, F.concat(F.lit("-"), F.col("__n").cast("string"))).otherwise(""), F.lit(suffix))).drop("__k", "__used", "__n")


def move_notes(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Re-key notes by ``moves`` (project relpath to_project to_relpath).

    A move onto itself or onto an existing note is refused: ``refused`` says so
    and the note stays where it is. Ids are preserved.
    """
    taken = notes.select(F.col("project").alias("to_project"), F.col("relpath").alias("to_relpath"), F.lit(True).alias("__taken"))
    wanted = moves.join(taken, ["to_project", "to_relpath"], "left")
    joined = notes.join(wanted, ["project", "relpath"], "left")
    refused = F.col("to_relpath").isNotNull() & F.coalesce("__taken", F.lit(False))
    go = F.col("to_relpath").isNotNull() & ~refused
    return joined.select(*(F.when(go, F.col(f"to_{c}")).otherwise(F.col(c)).alias(c) if c in ("project", "relpath") else F.col(c) for c in notes.columns), refused.alias("refused"))


def stash_id(front_id: Column, salvaged: Column, incoming: Column, derived: Column) -> Column:
    """Whose version a write replaces: the first id that is known."""
    return F.coalesce(*(F.when(c != "", c) for c in (front_id, salvaged, incoming)), derived)


def writable(relpath: Column, reserved: Sequence[str] = ("design/", "plans/", "learnings/", "sources/")) -> Column:
    """Whether notes may be written there: no other pillar's prefix, not owned by a source."""
    out = F.lit(True)
    for prefix in reserved:
        out = out & ~relpath.startswith(prefix)
    return out


def latest_records(records: DataFrame, key: str = "symbol_ref", order: str = "mtime") -> DataFrame:
    """One record for each key: the latest written."""
    return records.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), "filename"))).where("__n = 1").drop("__n")


def portable_mtime(status: Column, commit: Column, disk: Column) -> Column:
    """The commit's time for a clean committed file, else the disk's."""
    return F.coalesce(F.when(status == "clean", commit), disk)


def not_indexed(asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """Asked projects that have no index, each with the projects that do."""
    known = indexed.agg(F.array_sort(F.collect_set("project")).alias("indexed"))
    return asked.join(indexed.select("project").distinct(), "project", "left_anti").crossJoin(known)  # one row


def reindex_totals(per_store: Sequence[DataFrame]) -> DataFrame:
    """Counts of all pillars' actions, summed by project."""
    out = per_store[0]
    for more in per_store[1:]:
        out = out.unionByName(more)
    return out.groupBy("project").agg(*(F.sum(F.when(F.col("action") == a, F.col("n")).otherwise(0)).alias(a) for a in ("embed", "delete", "meta", "noop")))
