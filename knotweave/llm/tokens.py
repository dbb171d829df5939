"""Whole-text token ids from a ``tokenizers`` file, one encoding per distinct word.

Texts repeat words far more often than they bring new ones. A text is cut into
words exactly as the tokenizer's own normaliser and pre-tokenizer would, and
the tokenizer's model runs once for each word that the worker has not seen.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .common import worker_cache

#: A worker forgets its words beyond this many; that costs time, never results.
CACHE_WORDS = 400_000

#: Texts of these characters alone take the fast pattern, where ``re`` and the
#: tokenizer's pattern agree; any other character takes the tokenizer's own steps.
_PLAIN = re.compile(r"[^\t-\r -~\xa1-\xa9\xab-\xae\xb0\xb1\xb4\xb6-\xb8\xbb\xbfÀ-ÖØ-öø-ÿ‐-‧]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class WordIds:
    """Ids of texts under one ``tokenizers`` file, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_word = self._has_known_words(path)
        self.letters = byte_letters()
        self.bytes_of = {ord(c): b for b, c in self.letters.items()}
        self.seen: dict[str, bytes] = {}

    @staticmethod
    def _has_known_words(path: str) -> bool:
        """Whether the file cuts words as this class does; others encode whole texts."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return steps == ["NFC", "Replace", "Lowercase"] and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"].get("Regex") == pattern

    def words(self, text: str) -> list[str]:
        """The text's words, normalised and in order."""
        if _PLAIN.search(text) is None:
            return _FAST.findall(text.lower())
        # Unicode versions differ between libraries: the tokenizer's own steps decide
        cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [spelt.translate(self.bytes_of).encode("latin-1").decode("utf-8") for spelt, _ in cuts]

    def _learn(self, words: set[str]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        for word in words:
            spelt = word.encode("utf-8").decode("latin-1").translate(letters)
            self.seen[word] = np.array([t.id for t in tokenize(spelt)], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, without special tokens; null counts as empty."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        cut = [self.words(t) if t else [] for t in texts]
        new: set[str] = set()
        for words in cut:
            new.update(words)
        new.difference_update(self.seen)
        if len(self.seen) + len(new) > CACHE_WORDS:  # none of these texts' words may be missing below
            self.seen.clear()
            new = {w for words in cut for w in words}
        self._learn(new)
        ids = self.seen.__getitem__
        return [b"".join(map(ids, words)) for words in cut]


def word_ids(path: str) -> WordIds:
    """This worker's :class:`WordIds` for ``path``."""
    return worker_cache(f"word_ids:{path}", lambda: WordIds(path))
