"""Words and runs of words of many texts at once, as arrays of hashes.

Arrow string buffers are read in place. Hashes are polynomials modulo 2**64
with odd bases, finished by a mixer; runs of words of any length come from one
prefix sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64, string_buffers

_rng = np.random.default_rng(77)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = tuple(np.uint64(int(b) | 1) for b in _rng.integers(2**62, 2**63, 3, dtype=np.uint64))
_powers: dict[int, np.ndarray] = {}

#: Bytes of text that one step of arrays covers, unless one text is longer.
CHUNK_BYTES = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1024, 2 * (len(have) if have is not None else 0))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[int(base)] = np.cumprod(have)
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    """The odd base's inverse modulo 2**64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


class Words:
    """The words of some texts, one after the other.

    ``hash``: of each word; ``text``: the number of its text; ``left``: words
    from it to its text's end; ``begin``: each text's first word.
    """

    def __init__(self, column: pa.Array, fold: np.ndarray | None = None):
        """``fold`` maps bytes before words are cut, if given."""
        at, raw, _ = string_buffers(column)
        n = len(raw)
        if fold is not None:
            raw = fold[raw]
        space = _SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.r_[True, space[:-1]] if n else np.zeros(0, bool)
        after = np.r_[space[1:], True] if n else np.zeros(0, bool)
        self.start = np.flatnonzero(~space & (before | edge[:-1]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        size = self.end - self.start
        self.text = np.searchsorted(at, self.start, "right") - 1
        count = np.bincount(self.text, minlength=len(at) - 1)
        ends = np.cumsum(count)
        self.begin, self.count = ends - count, count
        self.left = ends[self.text] - np.arange(len(size)) if len(size) else size
        if len(size):
            first = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(first, size)
            spelt = _BYTE[raw[~space]] * powers(_BASES[0], int(size.max()))[within]
            self.hash = mix64(np.add.reduceat(spelt, first) + size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self._sums: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.hash)

    def runs(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        """Hash of the words from ``start`` to before ``end``; kinds are independent."""
        base, n = _BASES[1 + kind], len(self.hash)
        if kind not in self._sums:
            own = mix64(self.hash + np.uint64(kind + 1))
            self._sums[kind] = np.r_[np.uint64(0), np.cumsum(own * powers(base, n))]
        sums = self._sums[kind]
        return mix64((sums[end] - sums[start]) * powers(inverse(base), n + 1)[start])

    def grams(self, size: int, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words inside one text."""
        start = np.flatnonzero(self.left >= size)
        return start, self.runs(start, start + size, kind)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``CHUNK_BYTES`` bytes together."""
    at, _, _ = string_buffers(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the least of values[i : i + width].

    Only for i with a whole window; by doubling.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(values)), 1
    while size < width:
        shift = min(size, width - size)
        a, b = best[: len(best) - shift], best[shift:]
        best, size = np.where(values[b] < values[a], b, a), size + shift
    return best[:n]
