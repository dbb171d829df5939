"""Three-way merges of records and bodies; version rings."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEPT_VERSIONS = 20


def resolve(base: Column, ours: Column, theirs: Column) -> Column:
    """One field's merged value; null stands for absent.

    Sides that agree win; a side equal to the base yields to the other; a
    change beats a deletion; two changes take the smaller. Symmetric.
    """
    return (
        F.when(ours.eqNullSafe(theirs), ours)
        .when(ours.eqNullSafe(base), theirs)
        .when(theirs.eqNullSafe(base), ours)
        .when(ours.isNull(), theirs)
        .when(theirs.isNull(), ours)
        .otherwise(F.least(ours, theirs))
    )


def merge_fields(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``record key value`` of all keys that survive, from three tables of that shape.

    ``value`` is canonical text, so that texts that differ are values that
    differ. ``position`` orders a record's keys: id, then the base's order
    (``position`` there, if given), then new keys by name.
    """
    order = F.col("position") if "position" in base.columns else F.lit(0)
    b = base.select("record", "key", F.col("value").alias("__b"), order.alias("__p"))
    o, t = (x.select("record", "key", F.col("value").alias(n)) for x, n in ((ours, "__o"), (theirs, "__t")))
    all3 = b.join(o, ["record", "key"], "full").join(t, ["record", "key"], "full")
    merged = all3.withColumn("value", resolve(F.col("__b"), F.col("__o"), F.col("__t"))).where("value is not null")
    place = F.row_number().over(Window.partitionBy("record").orderBy(F.col("key") != "id", F.col("__p").isNull(), "__p", "key"))
    return merged.select("record", "key", "value", place.alias("position"))


def merge_symbols(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Merged records; ``content_hash`` is blank where the sides differ in it."""
    hashes = lambda x, n: x.where("key = 'content_hash'").select("record", F.col("value").alias(n))
    sides = hashes(ours, "__o").join(hashes(theirs, "__t"), "record", "full").where(~F.col("__o").eqNullSafe(F.col("__t"))).select("record", F.lit(True).alias("__dirty"))
    out = merge_fields(base, ours, theirs).join(sides, "record", "left")
    return out.withColumn("value", F.when(F.col("__dirty") & (F.col("key") == "content_hash"), "").otherwise(F.col("value"))).drop("__dirty")


def merge_lines(base: str, ours: str, theirs: str) -> tuple[str, bool]:
    """(merged text, whether it conflicts): three-way by lines.

    Regions that only one side changed take that side; equal changes count
    once; others are put side by side between conflict marks.
    """
    b, o, t = (x.splitlines(keepends=True) for x in (base, ours, theirs))

    def matches(side: list[str]) -> dict[int, int]:
        return {i + n: j + n for i, j, size in difflib.SequenceMatcher(None, b, side, autojunk=False).get_matching_blocks() for n in range(size)}

    in_o, in_t = matches(o), matches(t)
    anchors = [(i, in_o[i], in_t[i]) for i in range(len(b)) if i in in_o and i in in_t] + [(len(b), len(o), len(t))]
    out: list[str] = []
    conflict = False
    at_b = at_o = at_t = 0
    for i, j, k in anchors:
        own_b, own_o, own_t = b[at_b:i], o[at_o:j], t[at_t:k]
        if own_o == own_t or own_t == own_b:
            out += own_o
        elif own_o == own_b:
            out += own_t
        else:
            conflict = True
            closed = lambda lines: [*lines[:-1], lines[-1] if lines[-1].endswith("\n") else lines[-1] + "\n"] if lines else []
            out += ["<<<<<<< ours\n", *closed(own_o), "=======\n", *closed(own_t), ">>>>>>> theirs\n"]
        out += b[i : i + 1]
        at_b, at_o, at_t = i + 1, j + 1, k + 1
    return "".join(out), conflict


def merge_bodies(rows: DataFrame) -> DataFrame:
    """Add ``body`` and ``conflict`` to rows of ``base ours theirs``; null is empty."""

    @F.pandas_udf("body string, conflict boolean")
    def merged(base, ours, theirs):
        import pandas as pd

        return pd.DataFrame([merge_lines(b or "", o or "", t or "") for b, o, t in zip(base, ours, theirs, strict=True)], columns=["body", "conflict"])

    return rows.withColumn("__m", merged("base", "ours", "theirs")).withColumns({"body": F.col("__m.body"), "conflict": F.col("__m.conflict")}).drop("__m")


def stash(versions: DataFrame, new: DataFrame, keep: int = KEPT_VERSIONS) -> DataFrame:
    """Versions (id seq ...) with the new ones numbered on, the last ``keep`` of each id.

    ``new`` has the other columns and ``at`` to order several of one id.
    """
    last = versions.groupBy("id").agg(F.max("seq").alias("__last"))
    numbered = new.join(last, "id", "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.row_number().over(Window.partitionBy("id").orderBy("at"))).cast(versions.schema["seq"].dataType))
    return prune(versions.unionByName(numbered.select(*versions.columns)), keep)


def prune(versions: DataFrame, keep: int = KEPT_VERSIONS) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("seq"))
    return versions.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def restore(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """The versions (id seq) asked for."""
    return versions.join(asked.select("id", "seq"), ["id", "seq"], "left_semi")
