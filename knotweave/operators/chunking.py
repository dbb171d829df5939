"""Markdown to sections, windows and chunks; line maps; identities."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.functions import text as T

WINDOW_WORDS, WINDOW_OVERLAP = 320, 64
#: Each size of the blocks that spans are cut into is 2 to this power times the one before.
BLOCK_BITS = 3

_FENCE_OR_HEADING = re.compile(r"^[^\S\n]*(?P<fence>```|~~~).*(?:\n(?![^\S\n]*(?P=fence)).*)*(?:\n.*)?|^(?P<level>#{1,6})[^\S\n]+(?P<title>.*)$", re.MULTILINE)
_FRONT = re.compile(r"[^\S\n]*---[^\S\n]*\n(?:.*\n)*?[^\S\n]*---[^\S\n]*(?:\n|\Z)")


def overlap_words(window: int, ratio: float) -> int:
    """A ratio of the window (at most 0.9) as words, below the window itself."""
    return max(0, min(window - 1, int(window * min(max(ratio, 0.0), 0.9))))


def scan_sections(body: str | None, skip_front_matter: bool = False) -> list[dict]:
    """Sections of one markdown text, in order.

    A heading is one to six ``#``, white space and a title, outside of code
    fences. Its path holds the titles it is nested in. ``occurrence`` counts
    equal paths. ``start`` and ``end`` are lines from 1, the heading's included;
    ``text`` is what stands under the heading.

    One pattern finds headings and whole fenced blocks, whichever comes first:
    what looks like a heading inside a block is part of the block.
    """
    lines = (body or "").splitlines()
    whole = "\n".join(lines)
    ahead = _FRONT.match(whole) if skip_front_matter else None
    top = ahead.end() if ahead else 0
    heads = [m for m in _FENCE_OR_HEADING.finditer(whole, top) if m["level"]]
    starts = [top, *(m.end() + 1 for m in heads)]
    ends = [*(m.start() for m in heads), len(whole) + 1]
    at = [whole.count("\n", 0, top), *(whole.count("\n", 0, m.start()) for m in heads), len(lines)]
    titles: list[str | None] = [None] * 7
    met: Counter = Counter()
    out = []
    for n, (a, b) in enumerate(zip(starts, ends, strict=True)):
        level = len(heads[n - 1]["level"]) if n else 0
        if n:
            titles[level:] = [heads[n - 1]["title"].strip(), *[None] * (6 - level)]
        path = [t for t in titles if t is not None]
        met[tuple(path)] += n > 0
        out.append({"path": path, "occurrence": max(1, met[tuple(path)]), "level": level, "start": at[n] + 1, "end": at[n + 1], "text": whole[a:b].strip()})
    return out


def sections(notes: DataFrame, body: str = "body", front_matter: bool = False) -> DataFrame:
    """One row for each section with text: ``section_no heading_path occurrence level start_line end_line section_text``.

    The columns of ``notes`` stay, but for the body. A text without any section
    text keeps one empty-path section of its whole body if that has text, and
    none otherwise. A null body has no section. Each note is cut where it is
    read; nothing is shuffled.
    """
    kept = [f for f in notes.schema if f.name != body]
    added = "section_no int, heading_path array<string>, occurrence int, level int, start_line int, end_line int, section_text string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added])
    names = [f.name for f in kept]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values, text in zip(batch[names].itertuples(index=False, name=None), batch[body], strict=True):
                with_text = [s for s in scan_sections(text, front_matter) if s["text"]]
                rows += [(*values, n, s["path"], s["occurrence"], s["level"], s["start"], s["end"], s["text"]) for n, s in enumerate(with_text)]
            yield pd.DataFrame(rows, columns=[*names, *(c.split()[0] for c in added.split(", "))])

    return notes.select(*names, body).mapInPandas(cut, schema)


def line_map(notes: DataFrame, body: str = "body") -> DataFrame:
    """``section_key start_line end_line`` of every section, in lines of the whole file.

    Sections count with their heading even if nothing else stands in them; the
    part before the first heading counts if it has text. The first span of a
    key wins.
    """
    kept = [f for f in notes.schema if f.name != body]
    names = [f.name for f in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "section_key string, start_line int, end_line int"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values, text in zip(batch[names].itertuples(index=False, name=None), batch[body], strict=True):
                spans: dict[str, tuple[int, int]] = {}
                for s in scan_sections(text, True):
                    if s["path"] or s["text"]:
                        key = "/".join(s["path"]) + (f"#{s['occurrence']}" if s["occurrence"] > 1 else "")
                        spans.setdefault(key, (s["start"], s["end"]))
                rows += [(*values, key, a, b) for key, (a, b) in spans.items()]
            yield pd.DataFrame(rows, columns=[*names, "section_key", "start_line", "end_line"])

    return notes.select(*names, body).mapInPandas(cut, schema)


def windows(rows: DataFrame, text: str = "section_text", window: int = WINDOW_WORDS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Explode texts into windows: ``window_idx`` and ``window_text``.

    A text of at most ``window`` words stays as it is. A longer one gives a
    window every ``window - overlap`` words, joined by single spaces, as long as
    any word is left; the last may lie inside the one before.
    """
    words = T.py_words(F.col(text))
    step = max(1, window - overlap)
    cut = rows.withColumn("__words", words)
    starts = F.when(F.size("__words") <= window, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("__words") - 1, F.lit(step)))
    out = cut.select("*", F.posexplode(starts).alias("window_idx", "__at"))
    joined = F.array_join(F.slice("__words", F.col("__at") + 1, F.lit(window)), " ")
    return out.withColumn("window_text", F.when(F.size("__words") <= window, F.col(text)).otherwise(joined)).drop("__words", "__at")


def identify(rows: DataFrame) -> DataFrame:
    """Add ``section_key chunk_id section_hash index_text content_hash`` to windows.

    Needs ``project store relpath heading_path occurrence window_idx section_text window_text``.
    """
    path, text = F.col("heading_path"), F.col("window_text")
    out = rows.withColumn("section_key", T.section_key(path, F.col("occurrence")))
    return out.withColumns(
        {
            "chunk_id": T.chunk_id(F.col("project"), F.col("store"), F.col("relpath"), F.col("section_key"), F.col("window_idx")),
            "section_hash": T.section_hash(path, F.col("section_text")),
            "index_text": T.index_text(path, text),
            "content_hash": T.content_hash(path, text),
        }
    )


def chunk_notes(notes: DataFrame, window: int = WINDOW_WORDS, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Notes (``project store relpath body`` and more) to identified chunks."""
    return identify(windows(sections(notes), window=window, overlap=overlap))


def slices(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``slice``: the lines of each hit's span, cut from its file.

    ``hits`` has ``project store relpath start_line end_line``; ``files`` the key and ``text``.
    """
    lines = F.split("text", "\r\n|[\n\r]")
    part = F.array_join(F.slice(lines, F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return hits.join(files.select("project", "store", "relpath", "text"), ["project", "store", "relpath"], "left").withColumn("slice", part).drop("text")


def occurrences(headings: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Number equal heading paths in document order, from 1."""
    return headings.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def enclosing(points: DataFrame, spans: DataFrame, file: str, line: str) -> DataFrame:
    """The innermost span over each point: ``name`` of the shortest, null if none.

    ``points`` have ``file`` and ``line``; ``spans`` have ``file start_line
    end_line name``. Ties go to the later start, then the name. A span is cut
    into aligned blocks of 1, 8, 64... lines, at most 14 of each size, and of all
    spans a block keeps the innermost. A point lies in one block of each size: so
    rows grow with the logarithm of the longest span, not with its length.
    """
    spans = spans.where("start_line <= end_line").select(F.col("file").alias("__f"), F.col("start_line").cast("long").alias("a"), F.col("end_line").cast("long").alias("b"), "name")
    longest = spans.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 0
    levels = range((longest + 1).bit_length() // BLOCK_BITS + 1)
    low = lambda n: F.shiftright(F.col("a") + ((1 << n * BLOCK_BITS) - 1), n * BLOCK_BITS)
    high = lambda n: F.shiftright(F.col("b") + 1, n * BLOCK_BITS)
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))

    def blocks(n: int):
        whole = low(n + 1) < high(n + 1)  # some larger block fits between
        ends = F.concat(run(low(n), low(n + 1) * (1 << BLOCK_BITS)), run(high(n + 1) * (1 << BLOCK_BITS), high(n)))
        return F.transform(F.when(whole, ends).otherwise(run(low(n), high(n))), lambda k: F.struct(F.lit(n).alias("__n"), k.alias("__k")))

    inner = F.struct((F.col("b") - F.col("a")).alias("n"), (-F.col("a")).alias("s"), F.col("name").alias("name"))
    cut = spans.select("__f", inner.alias("__in"), F.explode(F.concat(*map(blocks, levels))).alias("x")).groupBy("__f", "x.__n", "x.__k").agg(F.min("__in").alias("__in"))
    asked = points.select(F.col(file).alias("__f"), F.col(line).alias("__l")).where("__f is not null and __l is not null").distinct()
    placed = asked.select("__f", "__l", F.explode(F.array(*(F.struct(F.lit(n).alias("__n"), F.shiftright(F.col("__l").cast("long"), n * BLOCK_BITS).alias("__k")) for n in levels))).alias("x")).select("__f", "__l", "x.*")
    found = placed.join(cut, ["__f", "__n", "__k"]).groupBy("__f", "__l").agg(F.min("__in").alias("__in"))
    return points.join(found, (F.col(file) == F.col("__f")) & (F.col(line) == F.col("__l")), "left").select(*points.columns, F.col("__in.name").alias("enclosing"))
