"""Tokens, lexical text, identities and text codecs as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that carry no information in a query, and the token patterns.
STOPWORDS = ("a", "after", "an", "and", "back", "before", "by", "for", "given", "in", "into", "is", "it", "its", "of", "on", "one", "only", "or", "re", "single", "so", "that", "the", "them", "then", "this", "to", "up", "which", "with")
TOKEN = "[A-Za-z0-9_]+"
CAMEL = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+"
NAME_PART = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
# White space that Python's str methods cut: ASCII, then the Unicode spaces.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NUL = "\x00"


def raw_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores; accents split words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokenize(text: Column) -> Column:
    """Lower-cased :func:`raw_tokens`; null has none."""
    return F.transform(raw_tokens(text), F.lower)


def subtokens(text: Column) -> Column:
    """Lower-cased parts of snake and camel case tokens that have several parts."""

    def parts(token: Column) -> Column:
        pieces = F.flatten(F.transform(F.split(token, "_"), lambda p: F.regexp_extract_all(p, F.lit(CAMEL), F.lit(0))))
        return F.transform(pieces, F.lower)

    return F.flatten(F.filter(F.transform(raw_tokens(text), parts), lambda p: F.size(p) > 1))


def name_terms(name: Column, fqn: Column) -> Column:
    """Sorted set of a symbol's name, its qualified name and their lower-cased parts."""

    def parts(text: Column) -> Column:
        words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
        cut = lambda w: F.regexp_extract_all(w, F.lit(NAME_PART), F.lit(0))
        return F.flatten(F.transform(words, lambda w: F.transform(F.when(F.size(cut(w)) > 0, cut(w)).otherwise(F.array(w)), F.lower)))

    whole = F.filter(F.array(name, fqn), lambda x: x.isNotNull() & (x != ""))
    return F.array_sort(F.array_distinct(F.concat(whole, parts(name), parts(fqn))))


def lexical_text(heading_path: Column, body: Column) -> Column:
    """What sparse scoring reads: the breadcrumb with spaces, a newline, the body."""
    return F.concat(F.regexp_replace(F.coalesce(heading_path, F.lit("")), "/", " "), F.lit("\n"), F.coalesce(body, F.lit("")))


def informative(tokens: Column) -> Column:
    """Different tokens longer than one character that are no stopwords."""
    kept = F.filter(tokens, lambda t: F.length(t) > 1)
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, STOPWORDS)))


def py_strip(text: Column) -> Column:
    """Python's ``strip()``."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def py_words(text: Column) -> Column:
    """Python's ``split()``: words between any white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def sha1_parts(*parts: Column) -> Column:
    """SHA-1 over the parts, each followed by NUL, the last one too."""
    return F.sha1(F.concat(*(x for p in parts for x in (p.cast("string"), F.lit(NUL)))).cast("binary"))


def short_hash(text: Column, n: int = 8) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, n)


def section_key(heading_path: Column, occurrence: Column) -> Column:
    """The breadcrumb, with ``#n`` for a later section of the same path."""
    key = F.array_join(heading_path, "/")
    return F.when(occurrence > 1, F.concat(key, F.lit("#"), occurrence.cast("string"))).otherwise(key)


def chunk_id(project: Column, store: Column, relpath: Column, key: Column, window: Column) -> Column:
    """Identity of a window: its project, path, section and number."""
    keyed = F.when(store == "notes", relpath).otherwise(F.concat(store, F.lit(":"), relpath))
    return sha1_parts(project, keyed, key, window)


def section_hash(heading_path: Column, section_text: Column) -> Column:
    return sha1_parts(F.array_join(heading_path, "/"), section_text)


def index_text(heading_path: Column, text: Column) -> Column:
    """What is embedded: the breadcrumb, an empty line, the text; or just the text."""
    return F.when(F.size(heading_path) > 0, F.concat(F.array_join(heading_path, " › "), F.lit("\n\n"), text)).otherwise(text)


def content_hash(heading_path: Column, text: Column) -> Column:
    return sha1_parts(index_text(heading_path, text))


def body_hash(body: Column) -> Column:
    """Hash of a note's stripped body; front matter plays no part."""
    return sha1_parts(py_strip(F.coalesce(body, F.lit(""))))


def code_hash(text: Column) -> Column:
    """Hash of a symbol's or file's text: 16 digits, no NUL."""
    return F.substring(F.sha1(text.cast("binary")), 1, 16)


def slug(title: Column) -> Column:
    """Letters, digits, spaces, ``-`` and ``_`` stay; spaces become ``-``; lower case."""
    kept = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N} _-]", "")
    return F.lower(F.regexp_replace(py_strip(kept), r"\s+", "-"))


def ordered_distinct(values: Column) -> Column:
    """First occurrences, in order."""
    return F.array_distinct(values)


def trailing_run(whole: Column, run: Column) -> Column:
    """Whether ``run`` is a non-empty tail of ``whole``."""
    n = F.size(run)
    return (n > 0) & (n <= F.size(whole)) & (F.slice(whole, F.greatest(F.size(whole) - n + 1, F.lit(1)), n) == run)


def leading_run(whole: Column, run: Column) -> Column:
    """Whether ``run`` is a head of ``whole``; an empty one is."""
    return (F.size(run) <= F.size(whole)) & (F.slice(whole, F.lit(1), F.size(run)) == run)


def heading_suffix(path: Column, cited: Column) -> Column:
    """Whether a cited heading is the tail of a section's path, in any case."""
    clean = lambda a: F.transform(F.split(a, "/"), lambda s: F.lower(py_strip(s)))
    return trailing_run(clean(path), clean(cited))


def docref(ref: Column) -> Column:
    """STRUCT<store, relpath> of ``design:x.md``; without a store it is ``notes``."""
    store = F.regexp_extract(ref, "^(notes|design|plans|learnings):", 1)
    return F.struct(F.when(store == "", "notes").otherwise(store).alias("store"), F.regexp_replace(ref, "^(notes|design|plans|learnings):", "").alias("relpath"))


def to_docref(store: Column, relpath: Column) -> Column:
    return F.when(store == "notes", relpath).otherwise(F.concat(store, F.lit(":"), relpath))


def portable_path(path: Column, roots: Sequence[tuple[str, str]]) -> Column:
    """``$NAME/rest`` under the longest root that holds the path; else unchanged."""
    out = path
    for name, root in sorted(roots, key=lambda r: len(r[1])):
        inside = (path == root) | path.startswith(root.rstrip("/") + "/")
        out = F.when(inside, F.concat(F.lit(f"${name}"), F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path)))).otherwise(out)
    return out


def expand_path(path: Column, roots: Sequence[tuple[str, str]]) -> Column:
    """The inverse of :func:`portable_path`."""
    out = path
    for name, root in roots:
        token = f"${name}"
        inside = (path == token) | path.startswith(token + "/")
        out = F.when(inside, F.concat(F.lit(root.rstrip("/")), F.substring(path, F.lit(len(token) + 1), F.length(path)))).otherwise(out)
    return out


def safe_relpath(path: Column) -> Column:
    """Whether a path stays inside its root: not empty, not absolute, no ``..``."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def project_name_ok(name: Column) -> Column:
    """Whether a name is one path segment of letters, digits, ``.``, ``_`` and ``-``."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$") & ~name.isin(".", ".."), F.lit(False))


def host_slug(host: Column) -> Column:
    """A host name as a folder: lower case, its first label, safe characters."""
    return F.regexp_replace(F.lower(F.element_at(F.split(host, r"\."), 1)), "[^a-z0-9-]+", "-")


def munge_path(path: Column) -> Column:
    """A path as one folder name: everything but letters and digits becomes ``-``."""
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def toml_escape(text: Column) -> Column:
    """The text inside a basic TOML string."""
    out = F.regexp_replace(text, r"\\", r"\\\\")
    for raw, spelt in (('"', r"\\\""), ("\n", r"\\n"), ("\t", r"\\t"), ("\r", r"\\r")):
        out = F.regexp_replace(out, raw, spelt)
    return out


def toml_unescape(text: Column) -> Column:
    """The inverse of :func:`toml_escape`."""
    held = F.regexp_replace(text, r"\\\\", "\x00")
    for spelt, raw in ((r'\\"', '"'), (r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r")):
        held = F.regexp_replace(held, spelt, raw)
    return F.replace(held, F.lit("\x00"), F.lit("\\"))


def is_test_path(path: Column) -> Column:
    """Whether a path looks like a test: a test folder or a test file name."""
    return F.coalesce(F.lower(path).rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.[^/]*$|\.(test|spec)\.[^/]*$"), F.lit(False))


def authority(called_by: Column) -> Column:
    """ln(1 + callers)."""
    return F.log1p(F.coalesce(F.size(called_by), F.lit(0)).cast("double"))


def language_of(path: Column, first_line: Column) -> Column:
    """Language by extension, else by shebang (``env`` unwrapped), else by ``#tag``."""
    # File extensions and interpreters by language.
    by_extension = {"py": "python", "lua": "lua", "rs": "rust", "go": "go", "c": "c", "h": "c", "zsh": "zsh", "sh": "sh", "bash": "bash", "fish": "fish", "rb": "ruby", "ts": "typescript", "js": "javascript", "java": "java", "cpp": "cpp", "mk": "make"}
    by_program = {"python": "python", "lua": "lua", "zsh": "zsh", "sh": "sh", "bash": "bash", "fish": "fish", "ruby": "ruby", "node": "javascript"}
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    program = F.regexp_extract(F.coalesce(first_line, F.lit("")), r"^#!\s*\S*?(?:/env\s+(?:-\S+\s+)*)?([A-Za-z]+)[0-9.]*(?:\s|$)", 1)
    program = F.when(program == "", F.regexp_extract(F.coalesce(first_line, F.lit("")), r"^#!\s*(?:\S*/)?([A-Za-z]+)[0-9.]*(?:\s|$)", 1)).otherwise(program)
    tag = F.lower(F.regexp_extract(F.coalesce(first_line, F.lit("")), r"^#([A-Za-z]\w*)", 1))
    lookup = lambda table, key: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)
    makefile = F.when(F.lower(F.regexp_extract(path, r"([^/]+)$", 1)) == "makefile", "make")
    known = F.when(tag.isin(*{*by_extension.values()}), tag)
    return F.coalesce(makefile, lookup(by_extension, extension), lookup(by_program, program), known)


def tool_kind(tool: Column, argument: Column) -> Column:
    """What a tool call was for: consult, save, search, read or other."""
    name = F.lower(F.coalesce(tool, F.lit("")))
    what = F.lower(F.coalesce(argument, F.lit("")))
    return (
        F.when(name.rlike(r"(note|design|plan|code)_(lookup|apropos|xref|dossier|graph)$|_read$") & (name != "read"), "consult")
        .when(name.rlike(r"(note_(store|append|edit)|learning_add|design_add|plan_add)$"), "save")
        .when(name.isin("grep", "glob") | (name.isin("bash") & what.rlike(r"\b(grep|rg|find|ag)\b")), "search")
        .when(name.isin("read") | (name.isin("bash") & what.rlike(r"\b(cat|head|tail|less)\b")), "read")
        .otherwise("other")
    )
