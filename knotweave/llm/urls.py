"""URL filters: host and path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds all vocabulary terms of a url in one pass. A
hit counts only where no letter or digit touches it. One strict term rejects a
url; soft terms reject it when several different ones occur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, worker_cache

#: Terms of which one is enough.
STRICT_TERMS = ("porn", "porno", "xxx", "xvideos", "hentai", "camgirls", "escorts", "sexcam", "sexcams", "phishing", "warez", "keygen", "malware", "onlinecasino", "viagra")
#: Terms of which several different ones are needed.
SOFT_TERMS = ("adult", "sex", "sexy", "nude", "casino", "poker", "bet", "betting", "slots", "jackpot", "cracked", "torrent", "pills", "pharmacy", "dating", "lottery", "erotic", "webcam")
SOFT_LIMIT = 2
#: Terms that a vocabulary table may have.
MOST_TERMS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered.

    Empty for null and for a url without ``://``.
    """
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty like :func:`url_host`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def vocabulary(terms: DataFrame) -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a table (``term weight``), lowered, sorted, each once.

    ``weight`` is ``strict`` or ``soft``; rows of another weight, and null or
    empty terms, are left out. The automaton lives in every worker, so a table of more than
    ``MOST_TERMS`` terms is an error.
    """
    rows = terms.where("term <> '' and weight in ('strict', 'soft')").select(F.lower("term").alias("term"), "weight").distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple(sorted(r.term for r in rows if r.weight == w) for w in ("strict", "soft"))


def _automaton(strict: Sequence[str], soft: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:  # a term in both lists is strict
        found.add_word(term, (term, True))
    if len(found):
        found.make_automaton()
    return found


def count_terms(url: str | None, automaton) -> tuple[int, int]:
    """(strict hits, different soft terms) of one url, by whole terms only."""
    if not url or not len(automaton):
        return 0, 0
    text = url.lower()
    strict, soft = 0, set()
    for end, (term, is_strict) in automaton.iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def term_hits(url: Column, strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS) -> Column:
    """STRUCT<strict, soft>: hits of strict terms and number of different soft terms."""

    key = hashlib.sha1(repr((sorted(strict), sorted(soft))).encode()).hexdigest()

    @F.pandas_udf("strict int, soft int")
    def hits(urls: pd.Series) -> pd.DataFrame:
        automaton = worker_cache(f"url_terms:{key}", lambda: _automaton(strict, soft))
        return pd.DataFrame([count_terms(u, automaton) for u in urls], columns=["strict", "soft"], dtype="int32")

    return hits(url)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does.

    Rules are (verdict, host, path). One fits its host and all subdomains when
    the path starts with the rule's. Host plus path measure length; ties go to
    the alphabetically first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), *(-ord(c) for c in r[1] + r[2]))):
        name = rule_host.lower() + rule_path
        fits = ((host == rule_host.lower()) | host.endswith("." + rule_host.lower())) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge_urls(rows: DataFrame, rules: Iterable[tuple[str, str, str]] = (), url: str = "url", strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """Add ``host path rule verdict strict_hits soft_hits`` to every row.

    A rule's verdict holds; without one, a strict term or ``soft_limit``
    different soft terms block and all else is allowed. A null or empty url has
    empty host and path, no hits, and is allowed. Columns of those names are
    replaced. There is no shuffle: each row is judged where it is read.
    """
    rows = rows.drop("host", "path", "rule", "verdict", "strict_hits", "soft_hits")
    hits = unused("hits", rows.columns)
    rows = rows.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url)), hits: term_hits(F.col(url), strict, soft)})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col(f"{hits}.strict") > 0) | (F.col(f"{hits}.soft") >= soft_limit), "block").otherwise("allow")
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own), "strict_hits": F.col(f"{hits}.strict"), "soft_hits": F.col(f"{hits}.soft")}).drop(hits)
