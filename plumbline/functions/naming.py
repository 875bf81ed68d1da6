"""Conversion between source names and names that are safe in a series id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Forbidden symbol and its token, in order of replacement.
SYMBOL_TOKENS = {
    "?": "%question%",
    "<": "%left-angle-bracket%",
    ">": "%right-angle-bracket%",
    "/": "%slash%",
    "\\": "%backslash%",
    "|": "%pipe%",
    "*": "%asterisk%",
    ":": "%colon%",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonize_name(c: Column | str) -> Column:
    """Safe name. An odd number of colons means that the last one separates a
    line number: it becomes ``+``, all other symbols become tokens."""
    name = _col(c)
    odd_colons = F.size(F.split(name, ":")) % 2 == 0
    name = F.when(odd_colons, F.regexp_replace(name, ":([^:]*)$", "+$1")).otherwise(name)
    for symbol, token in SYMBOL_TOKENS.items():
        name = F.replace(name, F.lit(symbol), F.lit(token))
    return name


def decanonize_name(c: Column | str) -> Column:
    """Source name for display. The ``+`` before a line number stays."""
    name = _col(c)
    for symbol, token in SYMBOL_TOKENS.items():
        name = F.replace(name, F.lit(token), F.lit(symbol))
    return name


def canonize_path(c: Column | str) -> Column:
    """Safe name of every component of a slash-separated path."""
    path = _col(c)
    # Most paths need no change and skip the work per component.
    changes = untidy(path) | path.rlike(r"[?<>\\|*:]")
    slow = F.array_join(F.transform(path_parts(path), canonize_name), "/")
    return F.when(changes, slow).otherwise(path)


def untidy(path: Column) -> Column:
    """Whether a path has leading, trailing or doubled slashes."""
    return path.startswith("/") | path.endswith("/") | path.contains("//")


def tidy_path(c: Column | str) -> Column:
    """The path without leading, trailing and doubled slashes."""
    path = _col(c)
    return F.when(untidy(path), F.array_join(path_parts(path), "/")).otherwise(path)


def path_parts(c: Column | str) -> Column:
    """Components of a path, without the empty ones of doubled or leading slashes."""
    return F.filter(F.split(_col(c), "/"), lambda part: part != "")


def parent_of(c: Column | str) -> Column:
    """Directory part of a node path; the root's parent is the empty string."""
    return F.regexp_replace(_col(c), "/?[^/]*$", "")


def base_of(c: Column | str) -> Column:
    """Last component of a node path."""
    return F.regexp_extract(_col(c), "([^/]*)$", 1)


def depth_of(c: Column | str) -> Column:
    """Number of components; a root has depth 1."""
    return F.size(F.split(_col(c), "/"))


def separators(c: Column, separator: str) -> Column:
    """How often a one-character separator occurs."""
    return F.length(c) - F.length(F.replace(c, F.lit(separator), F.lit("")))


def prefix(c: Column, separator: str, parts: Column) -> Column:
    """The first ``parts`` components."""
    return F.call_function("substring_index", c, F.lit(separator), parts)
