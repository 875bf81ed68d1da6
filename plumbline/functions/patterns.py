"""Translation of shell globs, find-style patterns and metric ranges.

All of this is string work on a few user arguments at plan time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def glob_to_regex(glob: str) -> str:
    """Whole-string Java regex for a shell glob; ``*`` also matches ``/``."""
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        close = glob.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = close
        else:
            out.append(re.escape(char) if not char.isalnum() else char)
        i += 1
    return "(?s)^" + "".join(out) + "$"


def literal_prefix(glob: str) -> str:
    """What every match of a shell glob begins with; the whole glob if it has no signs."""
    return re.split(r"[*?\[]", glob, maxsplit=1)[0]


def find_regex(pattern: str) -> str:
    """Java regex for a find-style pattern, where groups and alternation are
    written with a backslash and stand for themselves without one."""
    swap = {"\\(": "(", "\\)": ")", "\\|": "|", "(": "\\(", ")": "\\)", "|": "\\|"}
    tokens = re.findall(r"\\.|.", pattern, flags=re.S)
    return "".join(swap.get(t, t) for t in tokens)


def whole_match(c: Column, regex: str) -> Column:
    return c.rlike(f"^(?:{regex})$")


def prefix_match(c: Column, regex: str) -> Column:
    return c.rlike(f"^(?:{regex})")


def in_range(c: Column, bounds: str) -> Column:
    """Inclusive ``lo,hi`` test; an empty or ``*`` bound is open."""
    low, _, high = (part.strip() for part in bounds.partition(","))
    test = F.lit(True)
    if low not in ("", "*"):
        test = c >= F.lit(_number(low))
    if high not in ("", "*"):
        test = (c <= F.lit(_number(high))) if low in ("", "*") else test & (c <= F.lit(_number(high)))
    return test


def _number(text: str) -> int | float:
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
