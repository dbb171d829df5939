"""Markdown notes: scan, front matter, healing, imports."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:
    yaml = None

FENCE = "---"
_KEY = re.compile(r"^([A-Za-z_][\w-]*):")


def _scalar(text: str) -> object:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def read_header(text: str) -> dict:
    """A header's mapping; one that is no mapping is empty. ValueError if it can't be read."""
    if yaml is not None:
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ValueError(str(e).splitlines()[0]) from e
        return found if isinstance(found, dict) else {}
    out: dict = {}
    key = None
    for line in text.splitlines():
        if (m := _KEY.match(line)) is not None:
            key = m[1]
            out[key] = _scalar(line[m.end() :])
        elif key is not None and line.strip().startswith("- "):
            out[key] = [*(out[key] or []), _scalar(line.strip()[2:])] if not isinstance(out[key], str) else out[key]
        elif line.strip():
            raise ValueError(f"can't read header line {line!r}")
    return out


def split_note(text: str) -> tuple[str | None, str]:
    """(header text or None, body); the body loses its leading newlines."""
    if text.startswith((FENCE + "\n", FENCE + "\r\n")):
        lines = text.splitlines(keepends=True)
        for n in range(1, len(lines)):
            if lines[n].strip() == FENCE:
                return "".join(lines[1:n]), "".join(lines[n + 1 :]).lstrip("\n")
    return None, text


def heal_header(header: str) -> tuple[str, bool]:
    """(header with one entry for each top-level key, whether that changed it).

    A repeated one-line entry keeps the least line, a structured one its first;
    a header without repeats is left as it is.
    """
    entries: list[tuple[str, list[str]]] = []
    for line in header.splitlines():
        if (m := _KEY.match(line)) is not None:
            entries.append((m[1], [line]))
        elif entries:
            entries[-1][1].append(line)
    by_key: dict[str, list[list[str]]] = {}
    for key, lines in entries:
        by_key.setdefault(key, []).append(lines)
    if all(len(same) == 1 for same in by_key.values()):
        return header, False
    kept = [same[0] if len(same) == 1 or any(len(e) > 1 for e in same) else min(same) for same in by_key.values()]
    return "\n".join(line for lines in kept for line in lines) + "\n", True


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """``path text mtime`` of all markdown files under a folder, read whole."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("mtime"))


def parse(rows: DataFrame, text: str = "text") -> DataFrame:
    """Add ``front`` (JSON), ``body``, ``id``, ``title``, ``tags``, ``_error`` to notes.

    A header that can't be read is reported in ``_error``, with the id that a
    pattern still finds in it; nothing stops the scan.
    """
    schema = rows.schema.simpleString()[len("struct<") : -1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    del schema

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for note in batch[text]:
                header, body = split_note(note or "")
                front, error = {}, None
                try:
                    front = read_header(header) if header else {}
                except ValueError as e:
                    error = str(e)
                    found = re.search(r"(?m)^id:\s*(\S+)", header or "")
                    front = {"id": found[1]} if found else {}
                tags = front.get("tags") or []
                tags = [str(t) for t in tags] if isinstance(tags, list) else [t.strip() for t in str(tags).split(",")]
                one = lambda k, f=front: None if f.get(k) is None else str(f[k])
                out.append((json.dumps(front, default=str, sort_keys=True), body, one("id"), one("title"), tags, error))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=["front", "body", "id", "title", "tags", "_error"])], axis=1)

    return rows.mapInPandas(read, kinds + ", front string, body string, id string, title string, tags array<string>, _error string")


def duplicate_keys(headers: DataFrame, by: str, header: str = "header") -> DataFrame:
    """``by key n``: top-level keys that a header repeats."""
    lines = headers.select(by, F.explode(F.split(header, "\r?\n")).alias("line"))
    keyed = lines.withColumn("key", F.regexp_extract("line", r"^([A-Za-z_][\w-]*):", 1)).where("key <> ''")
    return keyed.groupBy(by, "key").agg(F.count("*").alias("n")).where("n > 1")


def salvaged_id(header: Column) -> Column:
    """The id that a broken header still shows."""
    found = F.regexp_extract(F.coalesce(header, F.lit("")), r"(?m)^id:\s*(\S+)", 1)
    return F.when(found != "", found)


def located(rows: DataFrame, root: str) -> DataFrame:
    """Add ``project store relpath`` from ``<root>/<project>/<store>/...`` paths."""
    rest = F.split(F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", ""), "/")
    return rows.withColumns({"project": rest[0], "store": rest[1], "relpath": F.array_join(F.slice(rest, F.lit(3), F.greatest(F.size(rest) - 2, F.lit(0))), "/")})


def import_files(notes: DataFrame, files: DataFrame, today: Column) -> DataFrame:
    """Notes with files copied to ``imported/<name>``: the source wins, an id and its date stay.

    ``files``: project name text. ``notes``: project relpath text id imported.
    """
    new = files.select("project", F.concat(F.lit("imported/"), "name").alias("relpath"), F.col("text").alias("__text"), F.lit(True).alias("__new"))
    both = notes.join(new, ["project", "relpath"], "full")
    return both.select("project", "relpath", F.when(F.col("__new"), F.col("__text")).otherwise(F.col("text")).alias("text"), "id", F.coalesce("imported", F.when(F.col("__new"), today.cast("string"))).alias("imported"))


def mirror_memory(notes: DataFrame, memory: DataFrame, host: str, index_name: str = "MEMORY.md") -> DataFrame:
    """Notes with a host's memory files mirrored: gone files go, for this host only.

    ``memory``: project name text; ``notes``: project host relpath text.
    """
    own = memory.where(F.col("name") != index_name).select("project", F.lit(host).alias("host"), F.concat(F.lit(f"memory/{host}/"), "name").alias("relpath"), "text")
    return notes.where(~F.col("host").eqNullSafe(F.lit(host))).unionByName(own.select(*notes.columns))


def in_globs(relpath: Column, globs: list[str]) -> Column:
    """Whether a path fits any glob (``**`` crosses folders, ``*`` and ``?`` do not)."""
    out = F.lit(False)
    for glob in globs:
        pattern = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, re.escape(t)) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob))
        out = out | relpath.rlike(f"^{pattern}$")
    return out


def in_situ(rows: DataFrame, repo: str, globs: list[str]) -> DataFrame:
    """Documents that stay in their repository, keyed ``sources/<repo>/<path>``; other files are pruned."""
    return rows.where(in_globs(F.col("relpath"), globs)).withColumns({"relpath": F.concat(F.lit(f"sources/{repo}/"), "relpath"), "source": F.lit("doc-insitu")})
