"""POSIX path strings as Columns, by the rules of Python's pure paths of versions 3.12 and 3.13, and glob patterns."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def is_absolute(path: Column | str) -> Column:
    return F.startswith(_col(path), F.lit("/"))


def _names(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))


def parts(path: Column | str) -> Column:
    """The path's components; that of an absolute path begins with ``/``."""
    p = _col(path)
    return F.when(is_absolute(p), F.concat(F.array(F.lit("/")), _names(p))).otherwise(_names(p))


def _join(absolute: Column, names: Column) -> Column:
    text = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), F.array_join(names, "/"))
    return F.when(text == "", F.lit(".")).otherwise(text)


def normal(path: Column | str) -> Column:
    """Without empty and ``.`` components and without a slash at the end; ``..`` stays."""
    p = _col(path)
    return _join(is_absolute(p), _names(p))


def name(path: Column | str) -> Column:
    names = _names(_col(path))
    return F.when(F.size(names) > 0, F.element_at(names, -1)).when(_col(path).isNotNull(), F.lit(""))


def suffix(path: Column | str) -> Column:
    return F.regexp_extract(name(path), r"(?s)\A.+(\.[^.]+)\z", 1)


def stem(path: Column | str) -> Column:
    n = name(path)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix(path)))


def suffixes(path: Column | str) -> Column:
    n = name(path)
    tail = F.split(F.regexp_replace(n, r"\A\.+", ""), r"\.")
    each = F.transform(F.slice(tail, F.lit(2), F.greatest(F.size(tail) - 1, F.lit(0))), lambda x: F.concat(F.lit("."), x))
    return F.when(F.endswith(n, F.lit(".")), F.array().cast("array<string>")).otherwise(each)


def parent(path: Column | str) -> Column:
    p = _col(path)
    names = _names(p)
    return _join(is_absolute(p), F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))))


def parents(path: Column | str) -> Column:
    """All parents, the nearest first."""
    p = _col(path)
    names = _names(p)
    count = F.when(F.size(names) > 0, F.sequence(F.size(names) - 1, F.lit(0))).when(p.isNotNull(), F.array().cast("array<int>"))
    return F.transform(count, lambda k: _join(is_absolute(p), F.slice(names, F.lit(1), k)))


def uri(path: Column | str) -> Column:
    """A ``file`` URI; null for a relative path. Each byte outside the unreserved ones is percent-encoded."""
    quoted = F.transform(parts(path), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    body = F.concat(F.lit("file:///"), F.array_join(F.slice(quoted, F.lit(2), F.greatest(F.size(quoted) - 1, F.lit(0))), "/"))
    return F.when(is_absolute(path), F.replace(F.replace(body, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")))


def joinpath(path: Column | str, *more: Column | str) -> Column:
    """Components one after the other; an absolute one replaces what stands before it. Strings in ``more`` are literal."""
    out = _col(path)
    for piece in more:
        piece = F.lit(piece) if isinstance(piece, str) else piece
        out = F.when(is_absolute(piece), piece).otherwise(F.concat_ws("/", out, piece))
    return normal(out)


def with_name(path: Column | str, new: Column | str) -> Column:
    """The last component replaced; an error where there is none."""
    new = F.lit(new) if isinstance(new, str) else new
    ready = F.when(name(path) == "", F.raise_error(F.concat(F.lit("no name to replace in "), _col(path))).cast("string")).otherwise(new)
    return joinpath(parent(path), ready)


def with_stem(path: Column | str, new: Column | str) -> Column:
    return with_name(path, F.concat(F.lit(new) if isinstance(new, str) else new, suffix(path)))


def with_suffix(path: Column | str, new: Column | str) -> Column:
    """Another suffix, or none if it is empty."""
    return with_name(path, F.concat(stem(path), F.lit(new) if isinstance(new, str) else new))


def absolute(path: Column | str, start: str) -> Column:
    """Relative paths below ``start``."""
    return joinpath(F.lit(start), _col(path))


def resolve(path: Column | str) -> Column:
    """The absolute path without ``..`` and links, as far as it exists; tasks look at the file system, which they must share."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if p is None else os.path.realpath(p) for p in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(_col(path))


def glob_regex(pattern: str, wild: str = ".") -> str:
    """A regular expression of a pattern with ``*`` and ``?``; wild is what one wildcard character may be."""
    return r"(?s)\A" + "".join(f"{wild}*" if c == "*" else wild if c == "?" else re.escape(c) for c in pattern) + r"\z"


def match_pattern(pattern: str, subject: Column | str) -> Column:
    """Whether the whole subject matches. An empty pattern matches nothing, and ``*.*`` needs a dot."""
    subject = _col(subject)
    return F.lit(False) & subject.isNotNull() if pattern == "" else subject.rlike(glob_regex(pattern))


def match_segment(pattern: str, subject: Column | str) -> Column:
    """As ``match_pattern`` for one path component: wildcards don't cross a slash, and an empty pattern matches an empty one."""
    return _col(subject).rlike(glob_regex(pattern, "[^/]"))


def ext(path: Column | str, wanted: str) -> Column:
    """Whether the suffix is just ``wanted``, such as ``.rst``; case matters. Combine with ``&``, ``|`` and ``~``."""
    return suffix(path) == wanted
