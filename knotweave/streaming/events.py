"""File-event streams: decode, debounce, coalesce, route, apply.

All functions take static tables and streams alike, but for
:func:`describe_queue`, which keeps state. Session windows replace timers: a
key's session closes when nothing came for the gap.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTE_GAP, CODE_GAP, MEMORY_GAP, KEYWORD_GAP = "200 milliseconds", "500 milliseconds", "500 milliseconds", "1 second"
OVERFLOW = 50
PILLARS = ("notes", "design", "plans", "learnings")
BASE_S, CAP_S = 2.0, 240.0


def watermarked(events: DataFrame, late: str = "10 seconds", ts: str = "ts") -> DataFrame:
    """Events with a timestamp that a watermark may follow (times without zone are cast)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def ignored(path: Column) -> Column:
    """Editor and atomic-write leftovers: hidden files, ``~``, ``.tmp``, ``.swp``."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return name.startswith(".") | name.rlike(r"~$|\.(tmp|swp|swx|part)$")


def decode(events: DataFrame, root: str) -> DataFrame:
    """Add ``project store relpath`` of paths ``<root>/<project>/<pillar>/...``; others are dropped."""
    base = root.rstrip("/") + "/"
    rest = F.split(F.substring("path", F.lit(len(base) + 1), F.length("path")), "/")
    kept = events.where(F.col("path").startswith(base) & ~ignored(F.col("path"))).withColumn("__r", rest)
    kept = kept.where((F.size("__r") >= 3) & F.col("__r")[1].isin(*PILLARS))
    return kept.withColumns({"project": F.col("__r")[0], "store": F.col("__r")[1], "relpath": F.array_join(F.slice("__r", F.lit(3), F.size("__r")), "/")}).drop("__r")


def debounce(events: DataFrame, key: list[str], gap: str, ts: str = "ts", event: str = "event") -> DataFrame:
    """One row for each burst of a key: its last event (of those at one time the greatest), when it began, how many came."""
    burst = events.groupBy(F.session_window(ts, gap).alias("w"), *key)
    return burst.agg(F.max_by(event, F.struct(ts, event)).alias(event), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n")).select(*key, event, "first_ts", "last_ts", "n")


def coalesce_batches(events: DataFrame, gap: str = CODE_GAP, ts: str = "ts", overflow: int = OVERFLOW) -> DataFrame:
    """One row for each burst of a project: its paths with their last events.

    A burst of more than ``overflow`` paths asks for a full revalidation.
    """
    burst = events.groupBy(F.session_window(ts, gap).alias("w"), "project")
    latest = burst.agg(F.array_sort(F.collect_list(F.struct("relpath", F.col(ts).alias("ts"), "event"))).alias("all"), F.max(ts).alias("last_ts"))
    n = F.size("all")
    last = F.filter("all", lambda x, i: (i == n - 1) | (F.try_element_at("all", i + 2).relpath != x.relpath))
    out = latest.withColumn("changes", F.transform(last, lambda x: F.struct(x.relpath.alias("relpath"), x.event.alias("event"))))
    return out.select("project", "last_ts", "changes", F.size("changes").alias("n"), (F.size("changes") > overflow).alias("revalidate"))


def real_deletes(events: DataFrame, listing: DataFrame) -> DataFrame:
    """Events in which a deletion of a file that is still there becomes a change."""
    there = listing.select("project", "relpath", F.lit(True).alias("__there")).distinct()
    out = events.join(there, ["project", "relpath"], "left")
    return out.withColumn("event", F.when((F.col("event") == "deleted") & F.col("__there"), "modified").otherwise(F.col("event"))).drop("__there")


def route_docs(events: DataFrame, globs: list[str]) -> DataFrame:
    """Events of documents that fit the globs."""
    from knotweave.sources.notes import in_globs

    return events.where(in_globs(F.col("relpath"), globs))


def backoff_s(level: Column, base: float = BASE_S, cap: float = CAP_S) -> Column:
    """``base`` doubled ``level`` times, at most ``cap``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), level), F.lit(cap))


def describe_queue(changes: DataFrame, base: float = BASE_S, cap: float = CAP_S) -> DataFrame:
    """Changed symbols by file, held back until the file settles.

    ``changes``: project file symbol body level. The newest body of a symbol
    wins. Every change re-arms the file's timer: ``base`` seconds, doubled for
    each level; a retry brings the level it failed at, and a fresh edit does not
    lower it. Rows ``project file symbol body level`` come when the timer fires.
    """
    import json

    def settle(key, batches, state):
        if state.hasTimedOut:
            pending, level = state.get
            state.remove()
            rows = json.loads(pending)
            yield pd.DataFrame({"project": key[0], "file": key[1], "symbol": list(rows), "body": list(rows.values()), "level": level})
            return
        pending, level = state.get if state.exists else ("{}", 0)
        rows = json.loads(pending)
        for batch in batches:
            rows.update(zip(batch["symbol"], batch["body"], strict=True))
            level = max(level, int(batch["level"].max()))
        delay = min(base * 2**level, cap)
        state.update((json.dumps(rows), level + 1))
        state.setTimeoutDuration(int(delay * 1000))
        return

    return changes.groupBy("project", "file").applyInPandasWithState(settle, "project string, file string, symbol string, body string, level int", "pending string, level int", "append", "ProcessingTimeTimeout")


def still_current(results: DataFrame, symbols: DataFrame) -> DataFrame:
    """Results whose symbol has the content it had when it was queued."""
    return results.join(symbols.select("symbol_ref", F.col("content_hash").alias("__now")), "symbol_ref").where(F.col("content_hash") == F.col("__now")).drop("__now")


def once(events: DataFrame, key: list[str]) -> DataFrame:
    """Without repeats of an event inside the watermark."""
    return events.dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def apply_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that hands every batch to ``apply``; the hash gate makes replays harmless."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class Progress:
    """Rows done so far, counted batch by batch."""

    def __init__(self) -> None:
        self.batches, self.rows = 0, 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.batches, self.rows = self.batches + 1, self.rows + batch.count()
