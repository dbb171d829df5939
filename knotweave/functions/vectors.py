"""Embeddings and vector arithmetic inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_words

DIM = 256
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """Signed feature hashing of lower-cased words by MD5, scaled to length 1.

    The digest is a number modulo ``dim`` (a power of two up to 256); bit 8 is
    the sign. A text without words is the zero vector.
    """
    if dim < 1 or dim > 256 or dim & (dim - 1):
        raise ValueError("dim must be a power of two up to 256")
    words = py_words(F.lower(F.coalesce(text, F.lit(""))))
    # Twice the component, and 1 more if the word counts up: digits 30 to 32 of the digest.
    code = lambda d: F.pmod(d, F.lit(dim)) * 2 + F.shiftright(d, 8) % 2
    codes = F.transform(words, lambda w: code(F.conv(F.substring(F.md5(w.cast("binary")), 30, 3), 16, 10).cast("int")))
    # One sort, not a fold of each word into a vector: in a sorted list with each code added once, a code's
    # first place tells how many come before it. Lists of one bind what is used for each component.
    every = F.sequence(F.lit(0), F.lit(2 * dim))
    first = lambda held: F.transform(every, lambda c: F.array_position(held, c) - c.cast("long"))
    before = F.transform(F.array(F.sort_array(F.concat(codes, every))), first)
    less = lambda p, i: p[2 * i + 1] - p[2 * i]
    more = lambda p, i: p[2 * i + 2] - p[2 * i + 1]
    total = F.transform(before, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (more(p, i) - less(p, i)).cast("double")))[0]
    return unit(total)


def dot(a: Column, b: Column) -> Column:
    """Inner product; lengths that differ are an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension")).cast("double")).otherwise(product)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """Scaled to length 1; the zero vector stays."""
    # Lists of one bind the vector and its length to names: what a lambda holds is computed for each element.
    scaled = lambda u, n: F.transform(u, lambda x: F.when(n > 0, x / F.nullif(n, F.lit(0.0))).otherwise(x))
    return F.transform(F.array(v), lambda u: F.transform(F.array(norm(u)), lambda n: scaled(u, n))[0])[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of any two vectors of one length; 0 with a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


class Embedders:
    """Named text-to-vector functions, chosen by a spec such as ``hash`` or ``hash:64``.

    An embedder is a pair of column functions, for documents and for queries;
    models come as pandas UDFs that a caller registers.
    """

    def __init__(self) -> None:
        self._known: dict[str, Callable[[str], tuple[Callable[[Column], Column], Callable[[Column], Column]]]] = {}
        self.register("hash", lambda size: (lambda t: hash_embedding(t, int(size or DIM)),) * 2)

    def register(self, name: str, make: Callable[[str], tuple[Callable[[Column], Column], Callable[[Column], Column]]]) -> None:
        self._known[name] = make

    def get(self, spec: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
        """(document function, query function); an unknown spec is an error, never a fallback."""
        name, _, argument = spec.partition(":")
        if name not in self._known:
            raise ValueError(f"no embedder {name!r}; known: {', '.join(sorted(self._known))}")
        return self._known[name](argument)


def with_query_prefix(query: Column, prefix: str = QUERY_PREFIX) -> Column:
    """Asymmetric models read an instruction before a query, never before a document."""
    return F.concat(F.lit(prefix), query)
