"""Expressions over request lines (``k=v k=v``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(line: Column | str) -> Column:
    """Non-empty whitespace-separated tokens."""
    return F.filter(F.split(_col(line), r"\s+"), lambda t: t != "")


def second_field(token: Column, delim: str) -> Column:
    """Text between the first and the second delimiter."""
    return F.split_part(token, F.lit(delim), F.lit(2))


def attr_value(line: Column | str, attr: str, default: str | None = "", delim: str = "=") -> Column:
    """Value of the first token that starts with ``attr`` + ``delim``; the
    default when there is none or its value is empty."""
    hits = F.filter(tokens(line), lambda t: F.startswith(t, F.lit(attr + delim)))
    value = second_field(F.try_element_at(hits, F.lit(1)), delim)
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default).cast("string"))


def pair_args(line: Column | str) -> Column:
    """``k v k v`` as ``k=v k=v``: every even-numbered blank becomes ``=``."""
    parts = F.split(_col(line), " ")
    last = F.floor((F.size(parts) - 1) / 2).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.concat_ws("=", F.get(parts, 2 * i), F.get(parts, 2 * i + 1)),
    )
    return F.array_join(pairs, " ")


def resolve_query(query: Column | str, service: Column | str) -> Column:
    """Absolute query text: ``+/x`` is relative to the service's full name."""
    query, service = _col(query), _col(service)
    rest = F.substr(query, F.lit(3))
    joined = (
        F.when(F.startswith(rest, F.lit("/")), rest)
        .when(F.endswith(service, F.lit("/")), F.concat(service, rest))
        .otherwise(F.concat(service, F.lit("/"), rest))
    )
    return F.when(F.startswith(query, F.lit("+/")), joined).otherwise(query)


def effective_args(line: Column | str, defaults: Column) -> Column:
    """Declared defaults (a map) overlaid by the tokens of a request line.

    Only declared names are overridden, the last token of a name wins, and
    positional parameters keep their declared value. Names match exactly.
    """

    def overlay(toks: Column) -> Column:
        def value_of(name: Column, value: Column) -> Column:
            hits = F.filter(toks, lambda t: F.startswith(t, F.concat(name, F.lit("="))))
            given = second_field(F.try_element_at(hits, F.lit(-1)), "=")
            positional = F.startswith(name, F.lit("NO_NAME_PARAM"))
            return F.when(positional, value).otherwise(F.coalesce(given, value))

        return F.transform_values(defaults, value_of)

    # The one-element array binds the tokens, which are then split only once.
    return F.get(F.transform(F.array(tokens(line)), overlay), F.lit(0))
