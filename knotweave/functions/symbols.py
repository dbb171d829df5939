"""Names and references of source-code symbols, by language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trailing_run

# How languages qualify names.
FILE_SCOPED = ("bash", "c", "fish", "make", "sh", "zsh")
PATH_MODES = {"python": "module", "lua": "module", "go": "package", "rust": "crate"}
PATH_ROOTS = {"python": "src", "lua": "lua", "go": "src"}
INDEX_FILES = {"python": "__init__", "lua": "init", "rust": "mod"}
LUA_TABLES = ("M", "Module", "_M", "mod", "self")

ANY_SEPARATOR = r"::|\."
IDENTIFIER = r"^[\p{L}_][\p{L}\p{N}_]*$"


def separator(lang: Column) -> Column:
    return F.when(lang == "rust", "::").otherwise(".")


def _empty() -> Column:
    return F.array().cast("array<string>")


def segments(name: Column, lang: Column) -> Column:
    """A qualified name cut by its language's separator, or by either if unknown."""
    cut = F.when(F.coalesce(lang, F.lit("")) == "", F.split(name, ANY_SEPARATOR)).when(lang == "rust", F.split(name, "::")).otherwise(F.split(name, r"\."))
    return F.when(F.coalesce(name, F.lit("")) == "", _empty()).otherwise(cut)


def tail(name: Column) -> Column:
    """The last segment, by either separator."""
    return F.element_at(F.split(name, ANY_SEPARATOR), -1)


def is_suffix_of(name: Column, partial: Column) -> Column:
    """Whether ``partial`` ends ``name`` right after a separator."""
    return (F.coalesce(partial, F.lit("")) != "") & (F.coalesce(name, F.lit("")) != "") & (name.endswith(F.concat(F.lit("."), partial)) | name.endswith(F.concat(F.lit("::"), partial)))


def local_name(raw: Column, lang: Column) -> Column:
    """A Lua name without its table; the type that a Rust ``impl`` is for."""
    lua = F.element_at(F.split(raw, "[:.]"), -1)
    body = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^impl\s*<[^>]*>", "impl"), "^impl", ""))
    target = F.trim(F.element_at(F.split(body, " for "), -1))
    rust = F.element_at(F.split(F.trim(F.regexp_replace(target, "(?s)<.*$", "")), "::"), -1)
    return F.when(lang == "lua", lua).when((lang == "rust") & raw.rlike(r"^impl\b"), F.when(rust == "", raw).otherwise(rust)).otherwise(raw)


def _path_parts(file: Column) -> Column:
    """The path's segments, the last one without its extension."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(file, F.lit("")), r"(?<=[^/])\.[^./]+$", ""), "/"), lambda p: (p != "") & (p != "."))


def _by_language(table: dict[str, str], lang: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), lang)


def path_scope(lang: Column, file: Column) -> Column:
    """What the file's path adds to a qualified name in its language."""
    parts = _path_parts(file)
    mode, root = _by_language(PATH_MODES, lang), _by_language(PATH_ROOTS, lang)
    last_src = F.size(parts) - F.array_position(F.reverse(parts), "src") + 1
    crate = F.when(F.array_contains(parts, "src"), F.slice(parts, last_src.cast("int") + 1, F.greatest(F.size(parts) - last_src.cast("int"), F.lit(0)))).otherwise(parts)
    # roots are cut from the front for as long as they repeat
    first_other = F.coalesce(F.try_element_at(F.filter(F.transform(parts, lambda p, i: F.when(~p.eqNullSafe(root), i)), lambda i: i.isNotNull()), F.lit(1)), F.size(parts))
    rooted = F.slice(parts, first_other + 1, F.size(parts))
    scope = F.when(mode == "crate", crate).otherwise(rooted)
    package = F.when(F.size(scope) >= 2, F.slice(scope, F.size(scope) - 1, 1)).otherwise(_empty())
    module = _without_index(scope, lang)
    return F.when(mode.isNull(), _empty()).when(mode == "package", package).otherwise(module)


def _without_index(parts: Column, lang: Column) -> Column:
    index = _by_language(INDEX_FILES, lang)
    is_index = F.coalesce(F.try_element_at(parts, F.lit(-1)) == index, F.lit(False))
    return F.when(is_index, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def declared_scope(lang: Column, container: Column) -> Column:
    """The nesting that the source declares; what is no identifier is dropped."""
    return F.filter(F.transform(F.coalesce(container, _empty()), lambda c: local_name(c, lang)), lambda n: n.rlike(IDENTIFIER))


def scope_of(lang: Column, file: Column, container: Column) -> Column:
    """A symbol's context as its language would say it: the file itself where files are scopes."""
    own_file = F.when(F.coalesce(file, F.lit("")) == "", _empty()).otherwise(F.array(file))
    return F.when(lang.isin(*FILE_SCOPED), own_file).otherwise(F.concat(path_scope(lang, file), declared_scope(lang, container)))


def declared_tail(container: Column, name: Column, lang: Column) -> Column:
    """What the file does not say of a symbol's name: declared nesting and leaf."""
    chain = F.filter(declared_scope(lang, container), lambda c: ~c.isin(*LUA_TABLES))
    leaf = F.when(F.coalesce(name, F.lit("")) == "", _empty()).otherwise(F.array(name))
    return _join(F.concat(chain, leaf), lang)


def _join(parts: Column, lang: Column) -> Column:
    return F.when(lang == "rust", F.array_join(parts, "::")).otherwise(F.array_join(parts, "."))


def symbol_ref(file: Column, container: Column, name: Column, lang: Column) -> Column:
    """``path#tail``, or the tail alone without a path."""
    t = declared_tail(container, name, lang)
    return F.when(F.coalesce(file, F.lit("")) == "", t).otherwise(F.concat(file, F.lit("#"), t))


def ref_parts(ref: Column) -> Column:
    """STRUCT<path, tail>; a handle without ``#`` has an empty path."""
    has = F.instr(ref, "#") > 0
    return F.struct(F.when(has, F.substring_index(ref, "#", 1)).otherwise("").alias("path"), F.when(has, F.regexp_replace(ref, "^[^#]*#", "")).otherwise(ref).alias("tail"))


def fqn(scope: Column, name: Column, lang: Column, file: Column, container: Column) -> Column:
    """The qualified name that a developer of the language would write."""
    scoped = F.when(F.size(F.coalesce(scope, _empty())) > 0, _join(F.concat(scope, F.array(name)), lang)).otherwise(name)
    return F.when(lang.isin(*FILE_SCOPED), symbol_ref(file, container, name, lang)).otherwise(scoped)


def display_name(scope: Column, name: Column, lang: Column, fallback: Column) -> Column:
    """Scope and name joined; the qualified name where either is missing."""
    missing = (F.size(F.coalesce(scope, _empty())) == 0) | (F.coalesce(name, F.lit("")) == "")
    return F.when(missing, F.coalesce(F.when(fallback != "", fallback), name)).otherwise(_join(F.concat(scope, F.array(name)), lang))


def key(stored: Column, file: Column, container: Column, name: Column, lang: Column) -> Column:
    """The stored reference, or the one that the parts give."""
    return F.coalesce(F.when(stored != "", stored), symbol_ref(file, container, name, lang))


def bindings(current: Column, was: Column) -> Column:
    """Every spelling a symbol answers to, its key first."""
    return F.array_distinct(F.concat(F.array(current), F.filter(F.coalesce(was, _empty()), lambda w: w != "")))


def canonical(file: Column, container: Column, name: Column, lang: Column) -> Column:
    """STRUCT<path, tail>: the two runs of segments that spell the symbol.

    The recorded name is one segment even if it holds a separator.
    """
    path = _without_index(_path_parts(file), lang)
    chain = F.filter(declared_scope(lang, container), lambda c: ~c.isin(*LUA_TABLES))
    leaf = F.when(F.coalesce(name, F.lit("")) == "", _empty()).otherwise(F.array(name))
    return F.struct(path.alias("path"), F.concat(chain, leaf).alias("tail"))


def match_tier(canon: Column, name: Column, was: Column, query: Column) -> Column:
    """How a query names a symbol: ref, name, exact, suffix or was; null if not.

    One rule: what a caller types is a trailing run of path and tail. The tier
    only says how much was pinned down. A recorded earlier spelling counts when
    it is typed exactly.
    """
    cut = lambda s: F.filter(F.split(s, ANY_SEPARATOR), lambda x: x != "")
    parts = ref_parts(query)
    typed_path = F.filter(F.split(F.regexp_replace(parts.path, r"(?<=[^/])\.[^./]+$", ""), "/"), lambda x: x != "")
    path_ok = (parts.path == "") | trailing_run(canon.path, typed_path)
    by_ref = path_ok & (parts.tail != "") & ((parts.tail == name) | trailing_run(canon.tail, cut(parts.tail)))
    run, typed = F.concat(canon.path, canon.tail), cut(query)
    by_name = F.when(query == name, "name").when(trailing_run(run, typed), F.when(F.size(typed) == F.size(run), "exact").when(F.size(typed) == 1, "name").otherwise("suffix")).when(F.array_contains(F.coalesce(was, _empty()), query), "was")
    return F.when(F.coalesce(query, F.lit("")) == "", F.lit(None).cast("string")).when(F.instr(query, "#") > 0, F.when(by_ref, "ref")).otherwise(by_name)


def query_leaf(query: Column) -> Column:
    """The last segment that a query can match a name by: what joins use as their key."""
    return tail(F.regexp_replace(query, "^.*#", ""))


def encode_location(project: Column, relpath: Column) -> Column:
    return F.when(F.coalesce(project, F.lit("")) == "", relpath).otherwise(F.concat(project, F.lit(":"), relpath))


def decode_location(location: Column, project: Column) -> Column:
    """STRUCT<project, relpath>; a bare location is the reading project's."""
    has = F.instr(location, ":") > 0
    return F.struct(F.when(has, F.substring_index(location, ":", 1)).otherwise(project).alias("project"), F.when(has, F.regexp_replace(location, "^[^:]*:", "")).otherwise(location).alias("relpath"))


def encode_edge(name: Column, location: Column) -> Column:
    return F.when(F.coalesce(location, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" ["), location, F.lit("]")))


def decode_edge(edge: Column, project: Column) -> Column:
    """STRUCT<project, name, relpath, location> of ``name [location]``."""
    has = F.instr(edge, " [") > 0
    name = F.trim(F.when(has, F.substring_index(edge, " [", 1)).otherwise(edge))
    location = F.when(has, F.regexp_replace(F.regexp_replace(edge, r"^.*?(?s) \[", ""), r"\]+$", "")).otherwise("")
    at = decode_location(location, project)
    return F.struct(at.project.alias("project"), name.alias("name"), at.relpath.alias("relpath"), location.alias("location"))


def edge_is_from(edge: Column, relpath: Column) -> Column:
    return edge.endswith(F.concat(F.lit("["), relpath, F.lit("]")))


def ref_slug(ref: Column) -> Column:
    """A file name for a reference; a hash is added if anything was lost or is upper case."""
    safe = _munge(ref)
    hashed = F.concat(safe, F.lit("-"), F.substring(F.sha1(ref.cast("binary")), 1, 8))
    return F.when((safe != ref) | (safe != F.lower(safe)), hashed).otherwise(safe)


def legacy_ref_slug(ref: Column) -> Column:
    """The earlier file name, which did not look at case."""
    safe = _munge(ref)
    return F.when(safe != ref, F.concat(safe, F.lit("-"), F.substring(F.sha1(ref.cast("binary")), 1, 8))).otherwise(safe)


def _munge(ref: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ref, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def path_matches(file: Column, partial: Column) -> Column:
    """Whether ``partial`` is a trailing run of the file's segments; empty matches all."""
    clean = lambda p: F.split(F.regexp_replace(p, "^/+|/+$", ""), "/")
    return (F.coalesce(partial, F.lit("")) == "") | trailing_run(clean(file), clean(partial))


def under(file: Column, prefix: Column) -> Column:
    """Whether a file lies in a folder, or is it; an empty prefix holds all."""
    clean = F.regexp_replace(prefix, "^/+|/+$", "")
    return (F.coalesce(clean, F.lit("")) == "") | (file == clean) | file.startswith(F.concat(clean, F.lit("/")))


def scope_matches(scope: Column, partial: Column) -> Column:
    """Whether ``partial`` is a trailing run of the scope; either separator will do."""
    typed = F.filter(F.split(partial, ANY_SEPARATOR), lambda s: s != "")
    return (F.coalesce(partial, F.lit("")) == "") | trailing_run(F.coalesce(scope, _empty()), typed)


def group_key(axis: str, file: Column, scope: Column, depth: int = 0) -> Column:
    """The group of a symbol on the axis file, dir or scope, at most ``depth`` deep."""
    cut = lambda parts: F.slice(parts, F.lit(1), F.lit(depth)) if depth else parts
    if axis == "file":
        return F.coalesce(F.when(file != "", file), F.lit("(unresolved)"))
    if axis == "dir":
        folders = F.split(file, "/")
        folders = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0)))
        return F.when(F.coalesce(file, F.lit("")) == "", "(unresolved)").when(F.size(folders) == 0, "(root)").otherwise(F.array_join(cut(folders), "/"))
    if axis == "scope":
        parts = F.coalesce(scope, _empty())
        return F.when(F.size(parts) == 0, "(no scope)").otherwise(F.array_join(cut(parts), "."))
    raise ValueError("axis must be file, dir or scope")
