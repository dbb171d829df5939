"""One object over the engine's tables: what a caller does, as methods.

Reads take batches and return DataFrames. Writes compute the next snapshot of a
table and store it; nothing is changed in place.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import symbols as S
from .functions import text as T
from .functions.vectors import Embedders
from .operators import chunking, decisions, evaluate, graph, index, learnings, merge, planning, resolve, retrieve
from .sources import config
from .sources import notes as notes_source
from .sources.tables import Tables
from .storage import saved

NOTE = "project string, store string, relpath string, id string, title string, tags array<string>, type string, body string, mtime timestamp"
CHUNK = "project string, store string, relpath string, note_id string, tags array<string>, type string, heading_path string, occurrence int, window_idx int, section_key string, chunk_id string, section_hash string, content_hash string, document string, index_text string"
VERSION = "project string, id string, relpath string, seq int, body string, at timestamp"
NODE = "project string, id string, kind string, relpath string, title string, status string, body_hash string, rank string, superseded_by string, updated string"
DEP = "project string, id string, dep string, checked string"
SOURCE = "project string, id string, ref string, heading string, hash string"
LEARNING = "project string, relpath string, symbol_ref string, symbol_was array<string>, file string, content_hash string, signature string, body string"
SYMBOL = "project string, symbol_ref string, fqn string, name string, kind string, lang string, file string, file_hash string, content_hash string, signature string, description string, keywords array<string>, name_terms array<string>, container array<string>, scope array<string>, symbol_was array<string>, calls array<string>, called_by array<string>, references array<string>, mtime bigint"
SCHEMAS = {"notes": NOTE, "chunks": CHUNK, "versions": VERSION, "nodes": NODE, "deps": DEP, "sources": SOURCE, "learnings": LEARNING, "symbols": SYMBOL, "vectors": "project string, chunk_id string, v array<double>", "symbol_vectors": "project string, symbol_ref string, v array<double>", "enrichment": "label string, section_hash string, terms array<string>, mtime timestamp"}
#: Versions of a table that stay readable at most; older ones are deleted after a write.
KEEP = 8


class Engine:
    """Notes, code symbols, learnings, decisions and plans under one root."""

    def __init__(self, spark: SparkSession, root: str, embedder: str = "hash", scorer: Column | None = None, window: int = chunking.WINDOW_WORDS, overlap: int = chunking.WINDOW_OVERLAP):
        self.spark, self.tables, self.scorer = spark, Tables(spark, root), scorer
        self.embed, self.embed_query = Embedders().get(embedder)
        self.window, self.overlap = window, overlap
        self.project = ""

    def table(self, name: str) -> DataFrame:
        """A table's last snapshot; an empty one before its first write."""
        return self.tables.read(name) if self.tables.exists(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def _put(self, name: str, rows: DataFrame) -> None:
        """The next version of a table has just ``rows``; only what differs is written."""
        self.tables.replace(name, rows.select(*self._columns(name)))
        self.tables.expire(name, KEEP)

    def _change(self, name: str, key: Sequence[str], rows: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Rows come in place of those of their keys, and the keys of ``gone`` go: nothing else is written."""
        self.tables.change(name, key, rows if rows is None else rows.select(*self._columns(name)), gone)
        if self.tables.exists(name):
            self.tables.expire(name, KEEP)

    def _columns(self, name: str) -> list[str]:
        return [c.split()[0] for c in SCHEMAS[name].split(", ")]

    # notes

    def note_store(self, notes: DataFrame) -> DataFrame:
        """Write notes (``project store relpath body`` and optional fields); returns near duplicates."""
        given = set(notes.columns)
        wanted = [f.split(" ", 1) for f in NOTE.split(", ")]
        new = notes.select(*(F.col(c) if c in given else F.lit(None).cast(kind).alias(c) for c, kind in wanted))
        new = new.withColumns({"id": F.coalesce("id", F.substring(T.sha1_parts(F.col("project"), F.col("store"), F.col("relpath")), 1, 26)), "mtime": F.coalesce("mtime", F.current_timestamp())})
        probe = self.near_duplicates(new) if self.tables.exists("chunks") else None
        old = self.table("notes")
        key = ["project", "store", "relpath"]
        self._stash(old.join(new.select(*key), key, "left_semi"))
        self._change("notes", key, new)
        self.note_reindex()
        return probe if probe is not None else self.spark.createDataFrame([], "project string, own_relpath string, relpath string, score double")

    def near_duplicates(self, notes: DataFrame) -> DataFrame:
        """Stored notes that a note's first line finds with a high fused score."""
        asked = notes.select(F.concat_ws("\x00", "project", "store", "relpath").alias("query_id"), "project", "store", F.col("relpath").alias("own_relpath"), index.probe_query(F.col("body")).alias("query")).where("query <> ''")
        hits = retrieve.lookup(asked.drop("own_relpath"), self.table("chunks"), self.table("vectors").drop("project"), 4, mode="file", embed=self.embed_query)
        return index.near_duplicate_probe(hits.join(asked.select("query_id", "own_relpath"), "query_id")).select("project", "own_relpath", "relpath", "score")

    def note_append(self, edits: DataFrame) -> DataFrame:
        """Append ``content`` (under ``heading``, if any) to notes by key."""
        key = ["project", "store", "relpath"]
        rows = self.table("notes").join(edits.select(*key, "content", "heading"), key)
        return self.note_store(rows.withColumn("body", index.append_note(F.col("body"), F.col("content"), F.col("heading"))).drop("content", "heading", "mtime"))

    def note_edit(self, edits: DataFrame) -> DataFrame:
        """Replace bodies of notes by key."""
        key = ["project", "store", "relpath"]
        rows = self.table("notes").drop("body", "mtime").join(edits.select(*key, F.col("new_content").alias("body")), key)
        return self.note_store(rows)

    def note_forget(self, keys: DataFrame) -> None:
        """Drop notes; their last bodies become versions."""
        key = ["project", "store", "relpath"]
        self._stash(self.table("notes").join(keys.select(*key), key, "left_semi"))
        self._change("notes", key, gone=keys)
        self.note_reindex()

    def note_move(self, moves: DataFrame) -> DataFrame:
        """Move notes; returns the moves that were refused."""
        moved = index.move_notes(self.table("notes"), moves)
        self._put("notes", moved)
        self.note_reindex()
        return moves.join(moved.where("refused").select("project", "relpath"), ["project", "relpath"], "left_semi")

    def note_create(self, notes: DataFrame) -> DataFrame:
        """Write new notes (``project store title body``) under paths made of their titles; returns the paths."""
        named = index.free_paths(notes.withColumn("slug", T.slug(F.col("title"))), self.table("notes"), ["title", "body"])
        self.note_store(named.drop("slug"))
        return named.select("project", "store", "relpath", "title")

    def note_import(self, files: DataFrame, today: str) -> DataFrame:
        """Copy files (``project name text``) to ``imported/``; a file imported before keeps its id and date. Returns their keys."""
        kept = self.table("notes").where(F.col("store") == "notes").select("project", "relpath", F.col("body").alias("text"), "id", F.regexp_extract("type", r"^imported:(.*)$", 1).alias("imported"))
        new = files.select("project", F.concat(F.lit("imported/"), "name").alias("relpath"))
        merged = notes_source.import_files(kept.withColumn("imported", F.when(F.col("imported") != "", F.col("imported"))), files, F.lit(today)).join(new, ["project", "relpath"], "left_semi")
        self.note_store(merged.select("project", F.lit("notes").alias("store"), "relpath", "id", F.concat(F.lit("imported:"), "imported").alias("type"), F.col("text").alias("body")))
        return new

    def note_import_memory(self, memory: DataFrame, host: str) -> None:
        """Mirror a host's memory files (``project name text``): gone ones go, other hosts' stay."""
        notes = self.table("notes")
        own = F.col("relpath").startswith(f"memory/{host}/")
        mirrored = notes_source.mirror_memory(notes.where(own).select("project", F.lit(host).alias("host"), "relpath", F.col("body").alias("text")), memory, host)
        gone = notes.where(own).join(mirrored.select("project", "relpath"), ["project", "relpath"], "left_anti")
        if not gone.isEmpty():
            self.note_forget(gone.select("project", "store", "relpath"))
        self.note_store(mirrored.select("project", F.lit("notes").alias("store"), "relpath", F.col("text").alias("body")))

    def note_locate(self, keys: DataFrame, root: str) -> DataFrame:
        """Add ``path`` under a root to stored notes' keys (``project store relpath``); unknown notes are left out."""
        own = ["project", "store", "relpath"]
        return self.table("notes").select(*own).join(keys.select(*own), own, "left_semi").withColumn("path", F.concat_ws("/", F.lit(root.rstrip("/")), *own))

    def note_read(self, keys: DataFrame) -> DataFrame:
        return self.table("notes").join(keys, [c for c in ("project", "store", "relpath") if c in keys.columns], "left_semi")

    def _chunks(self, notes: DataFrame) -> DataFrame:
        rows = chunking.chunk_notes(notes.withColumnRenamed("id", "note_id"), self.window, self.overlap)
        return rows.withColumns({"document": F.col("window_text"), "heading_path": F.array_join("heading_path", "/"), "window_idx": F.col("window_idx").cast("int")}).withColumn("type", F.coalesce("type", F.lit("note")))

    def note_reindex(self) -> DataFrame:
        """Bring chunks and vectors up to the notes; only changed chunks are embedded. Returns counts by action."""
        fresh, stored = self._chunks(self.table("notes")), self.table("chunks")
        actions = saved(index.plan(fresh, stored, meta=["tags", "type", "note_id", "section_hash"]))
        counts = actions.groupBy("action").agg(F.count("*").alias("n")).collect()
        gone = stored.join(actions.where("action = 'delete'"), "chunk_id", "left_semi").select("project", "chunk_id")
        changed = saved(fresh.join(actions.where("action in ('embed', 'meta')"), "chunk_id").select("action", *self._columns("chunks")))
        new = changed.where("action = 'embed'").select("project", "chunk_id", self.embed(F.col("index_text")).alias("v"))
        if not self.tables.exists("chunks") or any(r.action != "noop" for r in counts):
            self._change("vectors", ["project", "chunk_id"], new, gone)
            self._change("chunks", ["project", "chunk_id"], changed, gone)
        return self.spark.createDataFrame([(r.action, r.n) for r in counts], "action string, n bigint")

    def note_lookup(self, queries: DataFrame, k: int = retrieve.DEFAULT_K, tags: Sequence[str] = (), labels: Sequence[str] = (), weight: float = 0.3, alias_labels: Sequence[str] = ("summary", "asks"), alias_weight: float = 1.0, mode: str = "section") -> DataFrame:
        """Ranked chunks for queries (``query_id project store query``)."""
        assets = self.table("enrichment")
        terms = aliases = None
        if self.tables.exists("enrichment"):
            terms = assets.where(F.col("label").isin(*labels)) if labels else None
            named = assets.where(F.col("label").isin(*alias_labels)) if alias_labels else None
            aliases = named.select("section_hash", F.explode("terms").alias("t")).select("section_hash", self.embed(F.col("t")).alias("v")) if named is not None else None
        return retrieve.lookup(queries, self.table("chunks"), self.table("vectors").drop("project"), k, terms, weight, aliases, alias_weight, self.scorer, tags, mode=mode, embed=self.embed_query)

    def note_apropos(self, queries: DataFrame, k: int = retrieve.DEFAULT_K, tags: Sequence[str] = ()) -> DataFrame:
        """Hits with the lines and text of their whole sections."""
        notes = self.table("notes")
        hits = retrieve.with_spans(self.note_lookup(queries, k, tags), chunking.line_map(notes.select("project", "store", "relpath", "body")))
        return chunking.slices(hits, notes.withColumnRenamed("body", "text"))

    def _stash(self, rows: DataFrame) -> None:
        new = rows.where("id is not null").select("project", "id", "relpath", "body", F.coalesce("mtime", F.current_timestamp()).alias("at"))
        if not new.isEmpty():
            self._put("versions", merge.stash(self.table("versions"), new))

    def note_versions(self, ids: DataFrame) -> DataFrame:
        return self.table("versions").join(ids, "id", "left_semi").orderBy("id", F.desc("seq"))

    def note_restore(self, asked: DataFrame) -> DataFrame:
        """Write versions (``id seq``) back to where they were."""
        rows = merge.restore(self.table("versions"), asked).select("id", F.col("body").alias("__body"))
        notes = self.table("notes").join(rows, "id").withColumn("body", F.col("__body")).drop("__body", "mtime")
        return self.note_store(notes)

    # code

    def code_index(self, symbols: DataFrame) -> None:
        """Take in symbols; each project, file they hold replaces what was there."""
        old = self.table("symbols")
        files = symbols.select("project", "file").distinct()
        given = set(symbols.columns)
        wanted = [f.split(" ", 1) for f in SYMBOL.split(", ")]
        new = symbols.select(*(F.col(c) if c in given else F.lit(None).cast(kind).alias(c) for c, kind in wanted))
        args = F.col("file"), F.coalesce("container", F.array().cast("array<string>")), F.col("name"), F.col("lang")
        scope = S.scope_of(args[3], args[0], args[1])
        new = new.withColumns({"symbol_ref": S.key(F.col("symbol_ref"), *args), "scope": F.coalesce("scope", scope)})
        new = new.withColumn("fqn", F.coalesce("fqn", S.fqn(F.col("scope"), F.col("name"), F.col("lang"), F.col("file"), args[1])))
        new = new.withColumn("name_terms", F.coalesce("name_terms", T.name_terms(F.col("name"), F.col("fqn"))))
        described = old.select("project", "symbol_ref", F.col("content_hash").alias("__hash"), F.col("description").alias("__d"))
        new = new.join(described, ["project", "symbol_ref"], "left").withColumn("description", F.coalesce("description", F.when(F.col("__hash") == F.col("content_hash"), F.col("__d")))).drop("__hash", "__d")
        new = saved(new.select(*self._columns("symbols")))
        gone = saved(old.join(files, ["project", "file"], "left_semi").select("project", "symbol_ref"))
        self._change("symbols", ["project", "file"], new)
        live = new.where(F.coalesce("description", F.lit("")) != "")
        self._change("symbol_vectors", ["project", "symbol_ref"], live.select("project", "symbol_ref", self.embed(F.concat_ws("\n", "fqn", "description")).alias("v")), gone)

    def code_convert(self, apply: bool = False) -> DataFrame:
        """Re-key symbols by what their file, nesting and name say: ``filename target status``; written only if asked."""
        args = F.col("file"), F.coalesce("container", F.array().cast("array<string>")), F.col("name"), F.col("lang")
        symbols = self.table("symbols").withColumn("filename", F.concat("project", F.lit("/"), S.ref_slug(F.col("symbol_ref"))))
        fresh = S.key(F.lit(None).cast("string"), *args)
        found = index.convert_records(symbols, {"symbol_ref": fresh}, F.concat("project", F.lit("/"), S.ref_slug(fresh)), ["symbol_ref"])
        if apply:
            before = symbols.select("filename", F.col("symbol_ref").alias("__was"))
            moved = found.where("status <> 'collision'").join(before, "filename")
            was = F.array_distinct(F.concat(F.coalesce("symbol_was", F.array().cast("array<string>")), F.when(F.col("__was") != F.col("symbol_ref"), F.array("__was")).otherwise(F.array().cast("array<string>"))))
            stay = found.where("status = 'collision'").join(before, "filename").withColumn("symbol_ref", F.col("__was"))
            self._put("symbols", moved.withColumn("symbol_was", was).unionByName(stay))
        return found.select("filename", "target", "status")

    def code_lookup(self, queries: DataFrame, k: int = retrieve.DEFAULT_K) -> DataFrame:
        hits = retrieve.code_lookup(queries, self.table("symbols"), self.table("symbol_vectors").drop("project"), k, self.scorer, self.embed_query)
        return learnings.attach(hits, self.table("learnings")) if self.tables.exists("learnings") else hits

    def code_xref(self, queries: DataFrame) -> DataFrame:
        return resolve.xref(queries, self.table("symbols"))

    def _callers(self) -> DataFrame:
        return self.table("symbols").select("symbol_ref", F.size(F.coalesce("called_by", F.array().cast("array<string>"))).alias("callers"))

    def code_dossier(self, queries: DataFrame) -> DataFrame:
        found = resolve.unique_or_refuse(resolve.matches(queries, self.table("symbols")), self._callers())
        return resolve.dossier(found, self.table("symbols"))

    def code_graph(self, queries: DataFrame | None = None, project: str | None = None, direction: str = "callees", depth: int = 6, group_by: str | None = None, group_depth: int = 0, under: str = "", exclude: str = "") -> tuple[DataFrame, DataFrame]:
        """Nodes and edges around resolved symbols, or of a whole project; grouped if asked for."""
        symbols = self.table("symbols") if project is None else self.table("symbols").where(F.col("project") == project)
        edges = resolve.resolve_edges(symbols, "references" if direction == "references" else "calls")
        nodes, links = graph.project_graph(symbols, edges, rolled_up=queries is not None or group_by is not None)
        if queries is not None:
            found = resolve.unique_or_refuse(resolve.matches(queries, symbols), self._callers()).where("status = 'unique'")
            seeds = found.select(F.col("symbol_ref").alias("root"), F.col("symbol_ref").alias("node"))
            reached, links = graph.bfs(seeds, links, depth, direction)
            links = links.select("src", "dst").distinct()
            nodes = nodes.drop("truncated").join(reached.groupBy("node").agg(F.min("depth").alias("depth"), F.min("truncated").alias("truncated")), "node")
        if under or exclude:
            nodes, links = graph.scoped(nodes, links, under, exclude)
        return graph.roll_up(nodes, links, group_by, group_depth) if group_by else (nodes, links)

    def code_tree(self, queries: DataFrame, depth: int = 6) -> DataFrame:
        """Pre-order listing under each resolved symbol."""
        symbols = self.table("symbols")
        found = resolve.unique_or_refuse(resolve.matches(queries, symbols), self._callers()).where("status = 'unique'")
        _, links = graph.project_graph(symbols, resolve.resolve_edges(symbols), rolled_up=True)
        return graph.process_tree(found.select(F.col("symbol_ref").alias("root"), F.col("symbol_ref").alias("node")), links, depth)

    # learnings

    def learning_add(self, rows: DataFrame, today: str | None = None) -> None:
        """Add dated entries (``project symbol_ref text``) to symbols' notes, with a snapshot of the symbol."""
        day = F.lit(today or datetime.date.today().isoformat())
        notes, symbols = self.table("learnings"), self.table("symbols")
        old = notes.select("project", "symbol_ref", F.col("relpath").alias("__rel"), F.col("body").alias("__body"), F.col("symbol_was").alias("__was"))
        new = rows.join(symbols.select("project", "symbol_ref", "file", "content_hash", "signature"), ["project", "symbol_ref"]).join(old, ["project", "symbol_ref"], "left")
        new = new.select("project", F.coalesce("__rel", F.concat(S.ref_slug(F.col("symbol_ref")), F.lit(".md"))).alias("relpath"), "symbol_ref", F.coalesce("__was", F.array().cast("array<string>")).alias("symbol_was"), "file", "content_hash", "signature", learnings.dated_entry(F.col("__body"), day, F.col("text")).alias("body"))
        self._change("learnings", ["project", "relpath"], new)

    def learning_edit(self, rows: DataFrame) -> None:
        """Replace bodies (``project symbol_ref new_content``)."""
        out = self.table("learnings").join(rows.select("project", "symbol_ref", F.col("new_content").alias("__new")), ["project", "symbol_ref"], "left")
        self._put("learnings", out.withColumn("body", F.coalesce("__new", "body")))

    def learning_forget(self, rows: DataFrame) -> None:
        self._change("learnings", ["project", "symbol_ref"], gone=rows)

    def learning_read(self, rows: DataFrame) -> DataFrame:
        return self.table("learnings").join(rows.select("project", "symbol_ref"), ["project", "symbol_ref"], "left_semi")

    def learning_reaffirm(self, today: str | None = None) -> None:
        day = F.lit(today or datetime.date.today().isoformat())
        self._put("learnings", learnings.reaffirm(self.table("learnings"), self.table("symbols"), day))

    def learning_report(self, orphans_only: bool = False) -> DataFrame:
        return learnings.report(self.table("learnings"), self.table("symbols"), orphans_only)

    def learning_migrate(self) -> DataFrame:
        return learnings.convert(self.table("learnings"), self.table("symbols"))

    def learning_rehome(self, moves: DataFrame | None = None) -> DataFrame:
        """Candidates for orphans, or, with moves (``symbol_ref to_ref``), what was refused."""
        notes, symbols = self.table("learnings"), self.table("symbols")
        if moves is None:
            orphans = learnings.report(notes, symbols, True).where("status = 'orphan'").select("relpath")
            return learnings.candidates(notes.join(orphans, "relpath"), symbols)
        out = learnings.rehome(notes, moves, symbols)
        refused = [tuple(r) for r in out.where("refused").select("relpath", "symbol_ref").collect()]
        self._put("learnings", out)
        return self.spark.createDataFrame(refused, "relpath string, symbol_ref string")

    # decisions and plans

    def _sections(self) -> DataFrame:
        """Current hashes of all sections of notes, as citations name them."""
        chunks = self.table("chunks").where("window_idx = 0")
        return chunks.select("project", T.to_docref(F.col("store"), F.col("relpath")).alias("ref"), F.col("section_key").alias("heading"), F.col("section_hash").alias("hash"))

    def facet_add(self, nodes: DataFrame, deps: DataFrame | None = None, sources: DataFrame | None = None) -> None:
        """Add decisions or plan items (with ``body``), their deps verified at birth, and citations."""
        columns = [f.split(" ", 1) for f in NODE.split(", ")]
        new = nodes.withColumn("body_hash", T.body_hash(F.col("body")))
        status = F.coalesce("status", F.when(F.col("kind") == "plan", "todo").otherwise("active")) if "status" in new.columns else F.when(F.col("kind") == "plan", "todo").otherwise("active")
        new = new.withColumn("status", status)
        new = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns))
        all_nodes = self.table("nodes").join(new.select("project", "id"), ["project", "id"], "left_anti").unionByName(new)
        self._put("nodes", all_nodes)
        if deps is not None:
            self._put("deps", decisions.add_deps(self.table("deps"), deps, self.table("nodes"), True))
        if sources is not None:
            now = self._sections().withColumnRenamed("hash", "__now")
            cited = sources.join(now, ["project", "ref", "heading"], "left").withColumn("hash", F.col("__now"))
            self._put("sources", decisions.add_sources(self.table("sources"), cited.select("project", "id", "ref", "heading", "hash")))

    def facet_edit(self, rows: DataFrame) -> DataFrame:
        """Replace bodies (``project id new_content``); returns the newly tainted."""
        before = self.tainted()
        out = self.table("nodes").join(rows.select("project", "id", T.body_hash(F.col("new_content")).alias("__h")), ["project", "id"], "left")
        self._put("nodes", out.withColumn("body_hash", F.coalesce("__h", "body_hash")))
        return decisions.newly_tainted(before, self.tainted())

    def dep_add(self, deps: DataFrame) -> None:
        self._put("deps", decisions.add_deps(self.table("deps"), deps, self.table("nodes"), False))

    def dep_remove(self, deps: DataFrame) -> None:
        self._put("deps", decisions.remove_deps(self.table("deps"), deps))

    def facet_forget(self, ids: DataFrame, force: bool = False) -> DataFrame:
        kept, refused = decisions.forget(self.table("nodes"), self.table("deps"), ids, force)
        self._put("nodes", kept)
        return refused

    def causes(self, sources: bool = True) -> DataFrame:
        return decisions.direct_causes(self.table("nodes"), self.table("deps"), *((self.table("sources"), self._sections()) if sources else ()))

    def tainted(self, sources: bool = True) -> DataFrame:
        return decisions.tainted(self.table("nodes"), self.table("deps"), self.causes(sources))

    def design_check(self) -> DataFrame:
        return decisions.check(self.table("nodes"), self.causes(), self.tainted())

    def design_chains(self) -> DataFrame:
        return decisions.chains(self.table("nodes"), self.table("deps"), self.causes(), self.tainted())

    def design_list(self, kind: str = "design") -> DataFrame:
        return decisions.listing(self.table("nodes"), self.table("deps"), self.tainted(), kind)

    def design_read(self, refs: DataFrame) -> DataFrame:
        return decisions.dossier(self.table("nodes"), self.table("deps"), self.tainted(), refs)

    def design_reaffirm(self, ids: DataFrame) -> None:
        self._put("deps", decisions.reaffirm(self.table("deps"), self.table("nodes"), ids))
        if self.tables.exists("sources"):
            self._put("sources", decisions.reaffirm_sources(self.table("sources"), self._sections(), ids))

    def design_promote(self, ids: DataFrame) -> None:
        self._put("nodes", decisions.promote(self.table("nodes"), ids))

    def design_supersede(self, pairs: DataFrame) -> None:
        self._put("nodes", decisions.supersede(self.table("nodes"), pairs))

    def design_tree(self, roots: DataFrame | None = None, depth: int = 6, direction: str = "deps") -> DataFrame:
        d = self.table("deps")
        a, b = ("id", "dep") if direction == "deps" else ("dep", "id")
        return graph.tree(d.select(F.col(a).alias("src"), F.col(b).alias("dst")), depth, roots)

    def facet_graph(self, kind: str = "design", sources: bool = False) -> tuple[DataFrame, DataFrame]:
        edges = self.table("deps").select(F.col("id").alias("src"), F.col("dep").alias("dst"))
        cited = self.table("sources").select(F.col("id").alias("src"), "ref", "heading") if sources else None
        return graph.facet_graph(self.table("nodes"), edges, cited, kind)

    def design_lookup(self, queries: DataFrame, k: int = retrieve.DEFAULT_K, store: str = "design") -> DataFrame:
        hits = self.note_lookup(queries.withColumn("store", F.lit(store)), k)
        marked = self.tainted().join(self.table("nodes"), ["project", "id"]).select("project", "relpath")
        return retrieve.with_taint(hits, marked)

    def facet_import(self, ref: DataFrame) -> DataFrame:
        """Sections of documents (``project ref``) with hashes, previews and who cites them."""
        chunks = self.table("chunks").where("window_idx = 0").select("project", T.to_docref(F.col("store"), F.col("relpath")).alias("ref"), F.col("section_key").alias("heading"), F.col("section_hash").alias("hash"), F.col("document").alias("text"))
        return decisions.prepare_import(chunks.join(ref.select("project", "ref"), ["project", "ref"], "left_semi"), self.table("sources"))

    def _blocking(self) -> DataFrame:
        notes = self.table("notes").select("project", "id")
        return planning.blocking(self.table("nodes"), self.table("deps"), self.tainted(False), notes)

    def plan_list(self, everything: bool = False) -> DataFrame:
        return planning.working_set(self._blocking(), self.table("deps"), everything)

    def plan_next(self, k: int = 5) -> DataFrame:
        return planning.next_items(self._blocking(), self.table("deps"), k)

    def plan_status(self, ids: DataFrame, status: str) -> DataFrame:
        """Set a status; returns the items that it frees."""
        before = self._blocking()
        self._put("nodes", decisions.set_status(self.table("nodes"), ids, status))
        return planning.freed(before, self._blocking())

    def plan_revisit(self) -> DataFrame:
        return planning.revisit(self.table("nodes"), self.causes())

    def plan_move(self, project: str, item: str, after: str | None = None, before: str | None = None) -> str:
        """Re-rank an item between two others; returns its new rank."""
        ranks = {r.id: r["rank"] for r in self.table("nodes").where((F.col("project") == project) & F.col("id").isin(*[x for x in (after, before) if x])).select("id", "rank").collect()} if after or before else {}
        rank = planning.rank_between(ranks.get(after), ranks.get(before))
        nodes = self.table("nodes")
        mine = (F.col("project") == project) & (F.col("id") == item)
        self._put("nodes", nodes.withColumn("rank", F.when(mine, rank).otherwise(F.col("rank"))))
        return rank

    # projects

    def status(self) -> DataFrame:
        """Counts of everything, by project."""
        nodes = self.table("nodes")
        return evaluate.inventory({"notes": self.table("notes"), "designs": nodes.where("kind = 'design'"), "plans": nodes.where("kind = 'plan'"), "learnings": self.table("learnings"), "symbols": self.table("symbols"), "doc_chunks": self.table("chunks"), "tainted": self.tainted()})

    def project_status(self) -> DataFrame:
        return evaluate.project_status(self.table("symbols"))

    def project_list(self) -> DataFrame:
        return self.table("notes").select("project").union(self.table("symbols").select("project")).distinct()

    def project_forget(self, project: str, with_learnings: bool = False) -> None:
        for name in ("symbols", "symbol_vectors", *(["learnings"] if with_learnings else [])):
            if self.tables.exists(name):
                self._put(name, self.table(name).where(F.col("project") != project))

    def project_setup(self, project: str, files: DataFrame, docs: Sequence[str] = ("**/*.md",)) -> DataFrame:
        """Index a repository's files (``file text``): Python symbols, and documents that fit a glob, in place. Returns counts."""
        from .sources import code

        mine = files.select(F.lit(project).alias("project"), "file", "text")
        symbols = code.extract(mine.where(F.col("file").endswith(".py"))).withColumn("lang", F.lit("python"))
        self.code_index(symbols.select("project", "file", "file_hash", "name", "kind", "lang", "container", "content_hash", "signature"))
        found = notes_source.in_situ(mine.withColumnRenamed("file", "relpath"), project, list(docs))
        self.note_store(found.select("project", F.lit("notes").alias("store"), "relpath", F.col("source").alias("type"), F.col("text").alias("body")))
        return self.status().where(F.col("project") == project)

    def project_migrate(self, old_prefix: str, new_prefix: str) -> DataFrame:
        """Move notes and the citations of them from one prefix to another; returns the notes that moved."""
        notes = self.table("notes")
        moving = notes.where(F.col("relpath").startswith(old_prefix)).select("project", "store", "relpath")
        self._put("notes", index.migrate_layout(notes, old_prefix, new_prefix))
        if self.tables.exists("sources"):
            self._put("sources", index.migrate_layout(self.table("sources").withColumnRenamed("ref", "relpath"), old_prefix, new_prefix).withColumnRenamed("relpath", "ref"))
        self.note_reindex()
        return moving

    def project_reconcile(self) -> tuple[DataFrame, DataFrame]:
        """Bring all projects' chunks up to their notes: (counts by action, code files to extract anew)."""
        return self.note_reindex(), index.dirty_files(self.table("symbols"))

    def project_use(self, project: str) -> None:
        """The project that later calls without one mean."""
        self.project = project

    def project_current(self, explicit: str = "", path: str = "", markers: DataFrame | None = None, default: str = "") -> str:
        """The project that a call means: named, else in use, else of the nearest marker above a path, else the default."""
        row = self.spark.createDataFrame([(explicit, self.project, path)], "explicit string, session string, path string")
        seed = F.lit(None).cast("string")
        if markers is not None:
            row, seed = config.nearest_marker(row, markers), F.col("project")
        return row.select(config.project_of(F.col("explicit"), F.col("session"), seed, F.lit(default)).alias("p")).first().p

    def project_relocate(self, project: str, to: Engine) -> None:
        """Move a project's rows of all tables to another root."""
        for name in SCHEMAS:
            if name != "enrichment" and self.tables.exists(name):
                mine = self.table(name)
                to._put(name, to.table(name).where(F.col("project") != project).unionByName(mine.where(F.col("project") == project)))
                self._put(name, mine.where(F.col("project") != project))
