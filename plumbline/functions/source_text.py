"""Functions of C/C++ source texts: what is code, and where functions are.

Lexical helpers for the batches of ``functions.source_batch``. Nothing is
preprocessed: of a conditional directive the first branch is read, whatever its
condition, so that braces match.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

#: Version of the counting rules; results of other versions do not count.
RULES = 2

# Comments, directives and literals; all but literals are blanked out.
OPAQUE = re.compile(
    r"""
    (?P<blank> //(?:\\\r?\n|[^\n])* | /\*.*?(?:\*/|\Z) | ^[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])* )
  | (?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"
  | (?:u8|[uUL])?"(?:\\.|[^"\\\n])*"
  | (?<![0-9a-fA-F])'(?:\\.|[^'\\\n])*'
    """,
    re.X | re.S | re.M,
)
DIRECTIVE = re.compile(r"[ \t]*#\s*(if|el|endif)")
CATCH = re.compile(r"\s*catch\s*\([^()]*\)\s*\{")
HEAD_TOKEN = re.compile(r"[A-Za-z_]\w*|::|->|[=!<>]=|&&|\|\||\d[\w.]*|[^\w\s]")

# Fixed values of the counting rules.
SCOPES = {"namespace", "class", "struct", "union", "enum"}
NO_FUNCTIONS = SCOPES | {"catch"}
NOT_A_NAME = {"__attribute__", "__declspec", "__asm__", "alignas", "decltype", "noexcept", "throw", "requires"}
ACCESS = re.compile(r"\s*(?:public|private|protected)\s*:(?!:)")
WORD = re.compile(r"[A-Za-z_]\w*\Z")


def functions_of(code: str, begin: int, end: int, breaks: list[int], closing: dict[int, tuple[int, bool]]) -> Iterator[tuple]:
    """Yields (name, first character, start of the body, end of the body, end,
    incomplete) of every function of ``code[begin:end]``.

    ``code`` is free of comments and literals; ``breaks`` are the places of all braces
    and semicolons, and ``closing`` tells for every opening brace the place behind the
    one that closes it and whether there is one. Bodies are jumped over, and what
    stands before one is looked at once.
    """
    start = seen = begin
    head: list[str] = []
    open_ = 0
    parameters: set[str] | None = None
    i = bisect_left(breaks, begin)
    while i < len(breaks) and breaks[i] < end:
        at = breaks[i]
        sign, pos, i = code[at], at + 1, i + 1
        if sign != "}":
            while sign == "{" and seen == start and (access := ACCESS.match(code, start, at)) is not None:
                start = seen = access.end()
            piece = HEAD_TOKEN.findall(code[seen:at])
            head += piece
            open_ += piece.count("(") - piece.count(")")
        if sign == ";":
            if parameters is not None:
                more = bool(piece) and _last_name(piece) in parameters
            else:
                parameters = _declared_parameters(head)
                more = parameters is not None
            if more:
                head.append(";")
                seen = pos
                continue
        elif sign == "{":
            seen = at
            name = _function_name(head)
            if open_ > 0 or name is not None and _is_member_init(head) or name is None and "=" in head:
                # A default argument, the value of a member or of a variable.
                i = bisect_left(breaks, closing[at][0], i)
                continue
            if name is not None:
                pos, closed = closing[at]
                while "try" in head and (handler := CATCH.match(code, pos, end)) is not None:
                    pos, closed = closing[handler.end() - 1]
                first = start
                while code[first].isspace():
                    first += 1
                yield name, first, at + 1, pos - 1 if closed else pos, pos, not closed
                i = bisect_left(breaks, pos, i)
        start = seen = pos
        head, open_, parameters = [], 0, None


def plain_code(text: str) -> str:
    """The text without comments, directives and contents of literals, and with
    the first branch of every condition only. Line breaks stay."""
    parts, pos, depth, skipped = [], 0, 0, 0
    for match in OPAQUE.finditer(text):
        plain, opaque = text[pos : match.start()], match.group()
        breaks = "\n" * opaque.count("\n")
        if skipped:
            parts += ["\n" * plain.count("\n"), breaks]
        else:
            parts += [plain, " " if match.group("blank") is not None else '""', breaks]
        pos = match.end()
        directive = DIRECTIVE.match(opaque)
        if directive is None or match.group("blank") is None:
            continue
        if directive.group(1) == "if":
            depth += 1
        elif depth and directive.group(1) == "el":
            skipped = skipped or depth
        elif depth:
            skipped = 0 if skipped == depth else skipped
            depth -= 1
    rest = text[pos:]
    return "".join([*parts, "\n" * rest.count("\n") if skipped else rest])


def _last_name(tokens: list[str]) -> str:
    return next((t for t in reversed(tokens) if t not in ("[", "]")), "")


def _declared_parameters(head: list[str]) -> set[str] | None:
    """The parameters of an old-style function, if ``head`` ends in the declaration of
    one: names in the parentheses, and types for them between these and the body."""
    opens = _parameter_list(head)
    if opens < 1 or ")" not in head[opens:]:
        return None
    closes = head.index(")", opens)
    names = {t for t in head[opens + 1 : closes] if t != ","}
    declared = [t for t in head[closes + 1 :] if t not in ("[", "]")]
    old = len(declared) > 1 and all(map(WORD.match, names)) and WORD.match(declared[0]) and declared[-1] in names
    return names if old else None


def _parameter_list(head: list[str]) -> int:
    """Index of the parenthesis that opens the parameters, or -1."""
    depth = base = 0
    for j, token in enumerate(head):
        before = head[j - 1] if j else ""
        if token == "(":
            inside = head[j + 1 : j + 3]
            if depth == base and before != "operator" and inside[:1] in (["*"], ["&"], ["&&"]) and WORD.match(inside[-1]):
                # What returns a function or an array is named inside.
                base += 1
            else:
                named = WORD.match(before) and before not in NOT_A_NAME and before != "operator"
                if depth == base and (named or _operator_at(head, j) is not None):
                    return j
            depth += 1
        elif token == ")":
            depth -= 1
            base = min(base, max(depth, 0))
        elif token == "=" and depth == 0 and before != "operator":
            return -1
    return -1


def _operator_at(head: list[str], j: int) -> int | None:
    """Index of the ``operator`` keyword whose symbol or type ends right before ``j``."""
    for k in range(j - 1, max(j - 10, -1), -1):
        if head[k] == "operator":
            return k if k < j - 1 else None
        if head[k] in (";", "=", "{", "}") and k < j - 2:
            return None
    return None


def _spelled(tokens: list[str]) -> str:
    """Tokens with a blank where two words meet."""
    parts: list[str] = []
    for before, token in zip(["", *tokens], tokens):
        parts += [" ", token] if WORD.match(before) and WORD.match(token) else [token]
    return "".join(parts)


def _function_name(head: list[str]) -> str | None:
    j = _parameter_list(head)
    if j < 1:
        return None
    k = _operator_at(head, j)
    k = j - 1 if k is None else k
    if k > 0 and head[k - 1] == "~":
        k -= 1
    while k > 1 and head[k - 1] == "::" and WORD.match(head[k - 2]):
        k -= 2
    name = _spelled(head[k:j])
    return None if name in NO_FUNCTIONS else name


def _is_member_init(head: list[str]) -> bool:
    """Whether a brace after ``head`` initialises a member instead of opening a body."""
    depth, listed = 0, False
    for token in head[_parameter_list(head) :]:
        if token in ("(", "{"):
            depth += 1
        elif token in (")", "}"):
            depth -= 1
        listed = listed or (token == ":" and depth == 0)
    return listed and (head[-1] == ">" or WORD.match(head[-1]) is not None)
