"""Language identification by cross-parsing entropy (Ziv and Merhav, 1993).

A suffix automaton of labelled text recognises all its substrings. Parsing a
text against it greedily, each phrase being the longest match, needs few
phrases if the text speaks that language. The language with the fewest phrases,
normalised by the lengths of text and sample, wins.

All languages' automata form one table of transitions that parses many
stretches of text in step, as arrays.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, string_buffers, unused, worker_cache
from .words import chunks

#: The sample that a language is learned from: whole documents of so many bytes
#: together, out of so many that are looked at. Beyond ``SAMPLE_LANGUAGES``
#: languages each has less, so that the automata of all together stay as large.
SAMPLE_BYTES, SAMPLE_DOCS, SAMPLE_LANGUAGES = 32768, 256, 8
#: Texts are parsed in stretches of so many bytes, side by side; how many bytes
#: of a stretch are looked at first when its beginning turns out different.
STRETCH, GLANCE = 256, 64
UNKNOWN = "und"


def fold_bytes(raw: np.ndarray) -> np.ndarray:
    """ASCII capitals to small letters; other bytes stay."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower[raw]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class CrossParser:
    """Phrase counts of texts against every language's sample."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        folded = {k: fold_bytes(np.frombuffer(samples[k], np.uint8)) for k in self.languages}
        seen = np.unique(np.concatenate([*folded.values(), np.zeros(0, np.uint8)]))
        # symbol 0: in no sample; the last symbol: nothing, the state stays
        self.symbol = np.zeros(256, np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.pad = len(seen) + 1
        width = len(seen) + 2
        self.weight = np.array([np.log2(len(folded[k]) + 2) for k in self.languages])
        # A suffix automaton has less than twice as many states as symbols; rows that
        # are not used take no memory. Languages' automata are built and dropped in turn.
        rows = sum(2 * len(folded[k]) + 2 for k in self.languages)
        kind = np.int32 if rows * width < 1 << 30 else np.int64
        # An entry is twice the place of the next state's row, plus 1 if a phrase begins.
        table, self.roots, base = np.empty((rows, width), kind), [], 0
        for k in self.languages:
            step = suffix_automaton(self.symbol[folded[k]].tolist())
            lost = len(step)  # the state after a symbol that begins no match
            own = table[base : base + lost + 1]
            own[:] = (base + lost) * width << 1 | 1
            for c, to in step[0].items():
                own[:, c] = (base + to) * width << 1 | 1
            for state, to in enumerate(step):
                own[state, list(to)] = (np.fromiter(to.values(), kind, len(to)) + kind(base)) * kind(width) << 1
            own[:, self.pad] = (base + np.arange(lost + 1)) * width << 1
            self.roots.append((base + lost) * width)
            base += lost + 1
        self.table = table.ravel()
        self.roots = np.array(self.roots, kind)

    def phrases(self, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """[language, text]: phrases of each text, by Arrow offsets and bytes.

        All stretches are parsed at once, as if a phrase began with each. A
        phrase may reach over the edge: then the state at the end of the stretch
        before is the true beginning, and the stretch is parsed again from
        there, until it falls into step with the first parse (mostly within a
        few bytes) or ends. A changed end is passed on, until none changes.
        """
        size = np.diff(at)
        many = -(-size // STRETCH)
        own = np.repeat(np.arange(len(size)), many)
        first = at[:-1][own] + STRETCH * (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many))
        length = np.minimum(STRETCH, at[1:][own] - first)
        lanes = len(own)
        symbols = np.full(lanes * STRETCH, self.pad, self.table.dtype)
        # the stretches of a text follow each other, so its bytes do too
        into = np.arange(len(raw)) - np.repeat(first, length) + np.repeat(np.arange(lanes) * STRETCH, length)
        symbols[into] = self.symbol[fold_bytes(raw)]
        symbols = np.ascontiguousarray(symbols.reshape(lanes, STRETCH).T)
        begun = np.repeat(self.roots[:, None], lanes, 1)
        seen, early = self._run(symbols[:GLANCE], begun)
        state, late = self._run(symbols[GLANCE:], seen)
        later = np.r_[False, own[1:] == own[:-1]]
        asked = np.flatnonzero(later)
        while len(asked):
            true = state[:, asked - 1]
            new = (true != begun[:, asked]).any(0)
            asked, true = asked[new], true[:, new]
            begun[:, asked] = true
            after, early[:, asked] = self._run(symbols[:GLANCE, asked], true)
            off = (after != seen[:, asked]).any(0)
            seen[:, asked] = after
            redo = asked[off]
            end, late[:, redo] = self._run(symbols[GLANCE:, redo], after[:, off])
            moved = redo[(end != state[:, redo]).any(0)]
            state[:, redo] = end
            asked = moved[np.r_[later, False][moved + 1]] + 1
        out = np.zeros((len(self.languages), len(size)))
        for n in range(len(self.languages)):
            out[n] = np.bincount(own, early[n] + late[n], len(size))
        return out

    def _run(self, symbols: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, phrases begun) of each [language, lane] after the columns' symbols."""
        state, count = state.copy(), np.zeros(state.shape, self.table.dtype)
        for column in symbols:
            state += column
            state = self.table[state]
            count += state & 1
            state >>= 1
        return state, count

    def rates(self, at: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Phrases normalised: bits for each byte, if phrases point into the sample."""
        return self.phrases(at, raw) * self.weight[:, None] / np.maximum(np.diff(at), 1)


def learn(docs: DataFrame, may_learn: Column, sample_bytes: int = SAMPLE_BYTES, sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """A bounded sample of every language's texts.

    Of each non-null ``lang``, the ``sample_docs`` rows that ``may_learn``, have
    a letter, and whose doc_id hashes lowest are looked at in that order; those
    whose whole texts still fit into ``sample_bytes`` together are the sample.
    No text is cut: what doesn't fit is left out, and if nothing fits, the
    shortest text is the sample. Equal texts count once. Sizes are ranked
    first; only the texts chosen are shuffled and read.
    """
    usable = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.octet_length("text").cast("long")
    sized = usable.select("lang", "doc_id", size.alias("size"), F.when(size > sample_bytes, size).otherwise(0).alias("over"), F.xxhash64("text").alias("tie"))
    order = Window.partitionBy("lang").orderBy("over", F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "tie")
    picked = sized.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs).select("lang", "rank", "size", "tie").collect()
    room = sample_bytes * SAMPLE_LANGUAGES // max(SAMPLE_LANGUAGES, len({r.lang for r in picked}))
    chosen: dict[str, dict[int, int]] = {}
    left: dict[str, int] = {}
    for row in sorted(picked, key=lambda r: (r.lang, r["rank"])):
        own = chosen.setdefault(row.lang, {})
        if row.tie not in own and row.size <= left.setdefault(row.lang, room):
            left[row.lang] -= row.size
            own[row.tie] = row["rank"]
    for lang, own in chosen.items():
        if not own:
            own[min((r.size, r["rank"], r.tie) for r in picked if r.lang == lang)[2]] = 1
    keys = [(lang, tie, rank) for lang, own in chosen.items() for tie, rank in own.items()]
    if not keys:
        return {}
    wanted = F.broadcast(docs.sparkSession.createDataFrame(keys, "lang string, tie bigint, rank int"))  # at most sample_docs of a language
    texts = usable.select("lang", "text", F.xxhash64("text").alias("tie")).join(wanted, ["lang", "tie"]).groupBy("lang", "rank").agg(F.min("text").alias("text")).collect()
    out: dict[str, bytes] = {}
    for row in sorted(texts, key=lambda r: (r.lang, r["rank"])):
        out[row.lang] = out.get(row.lang, b"") + row.text.encode("utf-8") + b"\n"
    return out


def has_letter(text: Column) -> Column:
    """Whether a text has a language at all; null for null."""
    return text.rlike(r"\p{L}")


def identify(docs: DataFrame, samples: dict[str, bytes], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to every row, by its whole text.

    ``und`` with score 0 for a text that is null or has no letter, and for all
    if nothing was learned. The score is how far the second language's rate is
    above the first's: 0 for a tie (the alphabetically first wins), 1 if there
    is no second. Columns of those names are replaced; all others stay. There is
    no shuffle.
    """
    docs = small_batches(docs).drop("lang_pred", "score")
    key = hashlib.sha1(json.dumps({k: v.hex() for k, v in samples.items()}, sort_keys=True).encode()).hexdigest()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    names = docs.columns
    letter = unused("letter", names)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = worker_cache(f"cross_parser:{key}", lambda: CrossParser(samples))
        for batch in batches:
            for part in chunks(batch, text):
                at, raw, _ = string_buffers(part.column(text))
                known = np.asarray(part.column(letter).fill_null(False)) & bool(samples)
                pred, score = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
                if known.any():
                    rate = parser.rates(at, raw)
                    best = rate.argmin(0)
                    low = np.sort(rate, 0)
                    margin = 1 - low[0] / np.maximum(low[1], 1e-300) if len(low) > 1 else np.ones(len(known))
                    pred = np.where(known, np.array(parser.languages, object)[best], pred)
                    score = np.where(known, margin, score)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in range(len(names))), pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.withColumn(letter, has_letter(F.col(text))).mapInArrow(predict, schema)
