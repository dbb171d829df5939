"""Notes bound to symbols: joining, staleness, health, re-homing.

A note has ``relpath symbol_ref symbol_was file content_hash signature body``;
a symbol has ``symbol_ref fqn name file content_hash signature symbol_was``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotweave.functions import symbols as S
from knotweave.functions import text as T
from knotweave.storage import broadcast_if_small, saved

TOP = 6
#: Symbols up to which a name, file or identifier makes pairs of notes and symbols.
HOT = 100
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def _spellings(symbols: DataFrame) -> DataFrame:
    """``symbol_ref position binding`` for every spelling a symbol answers to."""
    return symbols.select("symbol_ref", F.posexplode(S.bindings(F.col("symbol_ref"), F.col("symbol_was"))).alias("position", "binding"))


def by_binding(notes: DataFrame) -> DataFrame:
    """``binding relpath``: the first note, by file name, of each spelling."""
    own = F.array_distinct(F.filter(F.concat(F.array("symbol_ref"), F.coalesce("symbol_was", F.array().cast("array<string>"))), lambda b: b.isNotNull() & (b != "")))
    return notes.select(F.explode(own).alias("binding"), "relpath").groupBy("binding").agg(F.min("relpath").alias("relpath"))


def attach(symbols: DataFrame, notes: DataFrame) -> DataFrame:
    """Symbols with their note: ``learning`` STRUCT<relpath, stale, body>, null without one.

    A symbol's spellings are tried in order, its key first. A note is stale if
    both content hashes are known and differ.
    """
    met = _spellings(symbols).join(by_binding(notes), "binding")
    best = met.groupBy("symbol_ref").agg(F.min_by("relpath", "position").alias("__rel"))
    note = notes.select(F.col("relpath").alias("__rel"), F.col("content_hash").alias("__hash"), F.col("body").alias("__body"))
    known = (F.coalesce("__hash", F.lit("")) != "") & (F.coalesce("content_hash", F.lit("")) != "")
    out = symbols.join(best, "symbol_ref", "left").join(note, "__rel", "left")
    learning = F.when(F.col("__rel").isNotNull(), F.struct(F.col("__rel").alias("relpath"), (known & (F.col("__hash") != F.col("content_hash"))).alias("stale"), T.py_strip(F.coalesce("__body", F.lit(""))).alias("body")))
    return out.withColumn("learning", learning).drop("__rel", "__hash", "__body")


def marks(symbols: DataFrame, notes: DataFrame) -> DataFrame:
    """``node``: keys of symbols with a note; a binding of no symbol stands for itself."""
    first = _spellings(symbols).groupBy("binding").agg(F.min("symbol_ref").alias("key"))
    return by_binding(notes).join(first, "binding", "left").select(F.coalesce("key", "binding").alias("node")).distinct()


def report(notes: DataFrame, symbols: DataFrame, orphans_only: bool = False) -> DataFrame:
    """``relpath symbol status file new_file``: ok, moved (another file) or orphan."""
    names = _spellings(symbols).select("binding", "symbol_ref").union(symbols.where("fqn is not null").select(F.col("fqn"), "symbol_ref"))
    first = names.groupBy("binding").agg(F.min("symbol_ref").alias("symbol_ref"))
    current = first.join(symbols.select("symbol_ref", F.col("file").alias("__file")), "symbol_ref").drop("symbol_ref")
    out = notes.withColumnRenamed("symbol_ref", "symbol").join(current, F.col("symbol") == F.col("binding"), "left")
    status = F.when(F.col("binding").isNull(), "orphan").when(~F.col("__file").eqNullSafe(F.col("file")), "moved").otherwise("ok")
    out = out.select("relpath", "symbol", status.alias("status"), "file", F.when(status == "moved", F.col("__file")).alias("new_file"))
    return out.where("status <> 'ok'") if orphans_only else out


def _keys(name: str, file: str, words: str) -> Column:
    """What makes a symbol and a note meet: name, file, identifiers of the signature."""
    all_keys = F.concat(F.array(F.concat(F.lit("n:"), name), F.concat(F.lit("f:"), file)), F.transform(words, lambda w: F.concat(F.lit("s:"), w)))
    return F.filter(F.array_distinct(all_keys), lambda k: k.isNotNull())


def _fit(name: Column, file: Column, both: Column, words: Column, others: Column) -> Column:
    """3 for an equal name, 2 for the same file, twice the Jaccard similarity of ``words`` and ``others`` identifiers, ``both`` of them shared."""
    overlap = F.coalesce(F.try_divide(both, words + others - both), F.lit(0.0))
    return F.when(name, 3.0).otherwise(0.0) + F.when(file, 2.0).otherwise(0.0) + F.when((words > 0) & (others > 0), 2.0 * overlap).otherwise(0.0)


def _scored(pairs: DataFrame, notes: DataFrame, entries: DataFrame) -> DataFrame:
    """``__n relpath symbol_ref score`` of pairs (``__n __s``) that fit at all; a note's own symbol does not."""
    met = pairs.join(notes.drop("__keys"), "__n").join(entries.drop("keys"), "__s").where(~F.array_contains("spellings", F.col("__bound")))
    file = (F.col("__file") != "") & (F.col("file") == F.col("__file"))
    score = _fit(F.col("name") == F.col("__name"), file, F.size(F.array_intersect("__sig", "sig")), F.size("__sig"), F.size("sig"))
    return met.select("__n", "relpath", "symbol_ref", score.alias("score")).where("score > 0")


def _by_classes(notes: DataFrame, entries: DataFrame, hot: DataFrame, top: int) -> DataFrame:
    """``__n __s``: for each note the ``top`` best by the ``hot`` keys (``__k``) alone, ties by ``symbol_ref``.

    Notes of the same hot keys and as many identifiers are one class, symbols
    likewise: classes are compared, and a class stands for its first members.
    """

    def classed(rows: DataFrame, key: str, keys: str, sig: str, *more: str) -> DataFrame:
        own = rows.select(key, F.explode(keys).alias("__k")).join(hot, "__k").groupBy(key).agg(F.sort_array(F.collect_list("__k")).alias("h"))
        return own.join(rows.select(key, F.size(sig).alias("m"), *more), key)

    ours, theirs = saved(classed(notes, "__n", "__keys", "__sig")), saved(classed(entries, "__s", "keys", "sig", "symbol_ref"))
    heads = theirs.withColumn("__i", F.row_number().over(Window.partitionBy("h", "m").orderBy("symbol_ref", "__s"))).where(F.col("__i") <= top)
    heads = saved(heads.groupBy("h", "m").agg(F.sort_array(F.collect_list(F.struct("symbol_ref", "__s"))).alias("heads")))
    asked = ours.select(F.col("h").alias("__h"), F.col("m").alias("__m")).distinct()
    shared = F.array_intersect("h", "__h")
    some = lambda kind: F.exists(shared, lambda k: k.startswith(kind) & (k != "f:"))
    words = F.size(F.filter(shared, lambda k: k.startswith("s:")))
    # Classes against classes: what is equal in both is counted once, however many notes and symbols there are.
    met = asked.crossJoin(broadcast_if_small(heads)).withColumn("score", _fit(some("n:"), some("f:"), words, F.col("__m"), F.col("m"))).where("score > 0")
    own, order = ["__h", "__m"], F.desc("score")
    upto = F.sum(F.size("heads")).over(Window.partitionBy(*own).orderBy(order))  # equal scores count together
    level = F.sum(F.size("heads")).over(Window.partitionBy(*own, "score"))
    near = met.withColumn("__before", upto - level).where(F.col("__before") < top).select(*own, "score", F.explode("heads").alias("e"))
    best = near.withColumn("__i", F.row_number().over(Window.partitionBy(*own).orderBy(order, "e"))).where(F.col("__i") <= top)
    lists = saved(best.groupBy(*own).agg(F.collect_list("e.__s").alias("__list")))
    listed = ours.join(broadcast_if_small(lists), (F.col("h") == F.col("__h")) & (F.col("m") == F.col("__m")))
    return listed.select("__n", F.explode("__list").alias("__s"))


def candidates(orphans: DataFrame, symbols: DataFrame, top: int = TOP) -> DataFrame:
    """``relpath symbol_ref score rank``: where an orphaned note may belong.

    3 for an equal name, 2 for the same file, and twice the Jaccard similarity
    of the signatures' identifiers. Symbols meet notes by name, file or
    identifier, never as all pairs: a note whose ``top`` best share its name and
    have more than 4, which is all that others can have, is settled by these.
    The rest meet by keys that at most ``HOT`` symbols have, and by classes of
    what they have of the others. That loses nothing: a symbol that shares hot
    keys only is among the first of its class, or that many go before it.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(IDENTIFIER), F.lit(0)))
    leaf = S.tail(S.ref_parts(F.col("symbol_ref")).tail)
    # Saved, since a second look would number the rows anew.
    notes = orphans.where("relpath is not null").select(F.monotonically_increasing_id().alias("__n"), "relpath", F.col("symbol_ref").alias("__bound"), leaf.alias("__name"), F.col("file").alias("__file"), words(F.col("signature")).alias("__sig"))
    notes = saved(notes.withColumn("__keys", _keys("__name", "__file", "__sig")))
    entries = symbols.where("symbol_ref is not null").select(F.monotonically_increasing_id().alias("__s"), "symbol_ref", "name", "file", words(F.col("signature")).alias("sig"), S.bindings(F.col("symbol_ref"), F.col("symbol_was")).alias("spellings"))
    entries = saved(entries.withColumn("keys", _keys("name", "file", "sig")))
    few = entries.groupBy(F.col("name").alias("__name")).agg(F.count("*").alias("__many")).where(F.col("__many") <= HOT).select("__name")
    pairs = notes.select("__n", "__name").join(few, "__name").join(entries.select("__s", F.col("name").alias("__name")), "__name").select("__n", "__s")
    named = saved(_scored(pairs, notes, entries))
    settled = named.where("score > 4").groupBy("__n").agg(F.count("*").alias("__many")).where(F.col("__many") >= top).select("__n")
    rest = saved(notes.join(settled, "__n", "left_anti"))
    scored = named.join(settled, "__n", "left_semi")
    if not rest.isEmpty():
        have = entries.select("__s", F.explode("keys").alias("__k"))
        want = saved(rest.select("__n", F.explode("__keys").alias("__k")))
        counts = saved(have.join(want.select("__k").distinct(), "__k", "left_semi").groupBy("__k").agg(F.count("*").alias("__many")))
        met = want.join(counts.where(F.col("__many") <= HOT), "__k").join(have, "__k").select("__n", "__s")
        hot = counts.where(F.col("__many") > HOT).select("__k")
        if not hot.isEmpty():
            # A note's own symbols are no candidates: so many more are looked at. Orphans have none.
            own = rest.select("__n", F.col("__bound").alias("b")).join(entries.select(F.explode("spellings").alias("b")), "b").groupBy("__n").count()
            met = met.union(_by_classes(rest, entries, broadcast_if_small(hot), top + (own.agg(F.max("count")).first()[0] or 0)))
        scored = scored.union(_scored(met.distinct(), rest, entries))
    ranked = scored.drop("__n").withColumn("rank", F.row_number().over(Window.partitionBy("relpath").orderBy(F.desc("score"), "symbol_ref"))).where(F.col("rank") <= top)
    return ranked.withColumn("score", F.round("score", 2)).select("relpath", "symbol_ref", "score", "rank")


def convert(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``relpath binding status symbol_ref target``: noop, convert, orphan or collision.

    Every note is classified by itself: its binding answers to a live symbol or
    to none. Two notes for one symbol collide, the later file name; so does a
    note whose target file is another note.
    """
    first = _spellings(symbols).groupBy("binding").agg(F.min("symbol_ref").alias("__ref"))
    met = notes.select("relpath", F.col("symbol_ref").alias("binding")).join(first, "binding", "left")
    met = met.withColumn("target", F.when(F.col("__ref").isNotNull(), F.concat(S.ref_slug(F.col("__ref")), F.lit(".md"))))
    held = notes.select(F.col("relpath").alias("target"), F.lit(True).alias("__held"))
    done = (F.col("binding") == F.col("__ref")) & (F.col("relpath") == F.col("target"))
    claim = F.row_number().over(Window.partitionBy("__ref").orderBy(F.desc(done), "relpath"))
    joined = met.join(held, "target", "left").withColumn("__claim", claim)
    taken = F.coalesce("__held", F.lit(False)) & (F.col("relpath") != F.col("target"))
    status = F.when(F.col("__ref").isNull(), "orphan").when(done, "noop").when((F.col("__claim") > 1) | taken, "collision").otherwise("convert")
    return joined.select("relpath", "binding", status.alias("status"), F.col("__ref").alias("symbol_ref"), "target")


def path_of(symbols: DataFrame, notes: DataFrame) -> DataFrame:
    """``symbol_ref relpath``: a symbol's existing note by any spelling, else its canonical file."""
    met = _spellings(symbols).join(by_binding(notes), "binding", "left")
    best = met.groupBy("symbol_ref").agg(F.min_by("relpath", F.when(F.col("relpath").isNotNull(), F.col("position"))).alias("relpath"))
    return best.withColumn("relpath", F.coalesce("relpath", F.concat(S.ref_slug(F.col("symbol_ref")), F.lit(".md"))))


def dated_entry(body: Column, date: Column, text: Column) -> Column:
    """A body with one more entry under its date."""
    return F.concat(F.when(F.coalesce(body, F.lit("")) == "", "").otherwise(F.concat(F.rtrim(body), F.lit("\n\n"))), F.lit("### "), date.cast("string"), F.lit("\n\n"), T.py_strip(text), F.lit("\n"))


def reaffirm(notes: DataFrame, symbols: DataFrame, today: Column) -> DataFrame:
    """Notes with their symbol's hash, file and signature of now, and the date."""
    now = symbols.select("symbol_ref", *(F.col(c).alias(f"__{c}") for c in ("content_hash", "file", "signature")))
    out = notes.join(now, "symbol_ref", "left")
    alive = F.col("__content_hash").isNotNull()
    for c in ("content_hash", "file", "signature"):
        out = out.withColumn(c, F.when(alive, F.col(f"__{c}")).otherwise(F.col(c)))
    return out.withColumn("reaffirmed", F.when(alive, today.cast("string"))).drop("__content_hash", "__file", "__signature")


def rehome(notes: DataFrame, moves: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rebind notes by ``moves`` (symbol_ref to_ref); ``refused`` where a note is there already."""
    taken = by_binding(notes).select(F.col("binding").alias("to_ref"), F.lit(True).alias("__taken"))
    target = symbols.select(F.col("symbol_ref").alias("to_ref"), *(F.col(c).alias(f"__{c}") for c in ("content_hash", "file", "signature")))
    out = notes.join(moves.join(taken, "to_ref", "left").join(target, "to_ref", "left"), "symbol_ref", "left")
    refused = F.col("to_ref").isNotNull() & (F.coalesce("__taken", F.lit(False)) | F.col("__file").isNull())
    go = F.col("to_ref").isNotNull() & ~refused
    was = F.array_distinct(F.concat(F.coalesce("symbol_was", F.array().cast("array<string>")), F.array("symbol_ref")))
    changed = {"symbol_was": was, "symbol_ref": F.col("to_ref"), "relpath": F.concat(S.ref_slug(F.col("to_ref")), F.lit(".md")), **{c: F.col(f"__{c}") for c in ("content_hash", "file", "signature")}}
    return out.select(*(F.when(go, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in notes.columns), refused.alias("refused"))
