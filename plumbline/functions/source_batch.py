"""Per-function counts of a batch of C/C++ source texts.

All texts of a batch are one array of characters. Braces are matched by sorting their
depths, tokens are found by comparing characters, and the counts of a function are
differences of running sums at both ends of its body. Only what stands before a body
is read token by token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from plumbline.functions.source_text import functions_of, plain_code

# Fixed values of the counting rules: words by what they count as.
DECISIONS = ("if", "for", "while", "and", "or")
HEADERS = ("if", "for", "while", "switch")
WORDS = ("if", "for", "while", "switch", "case", "and", "or")

#: Kinds of tokens; words have theirs by place.
OPEN, CLOSE, SEMICOLON, DECISION = len(WORDS) + 1, len(WORDS) + 2, len(WORDS) + 3, len(WORDS) + 4


def _word_characters(x: np.ndarray) -> np.ndarray:
    return ((x >= 48) & (x <= 57)) | ((x | 32) >= 97) & ((x | 32) <= 122) | (x == 95) | (x > 127)


def _pairs(x: np.ndarray, sign: str) -> np.ndarray:
    """Places of a doubled sign; of three in a row the first two are one."""
    at = np.flatnonzero(x == ord(sign))
    if not len(at):
        return at
    first = np.append(True, np.diff(at) > 1)
    run = np.cumsum(first) - 1
    within = np.arange(len(at)) - np.flatnonzero(first)[run]
    follows = np.append(~first[1:], False)
    return at[(within % 2 == 0) & follows]


def _tokens(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of all tokens that count, in order."""
    kind = np.zeros(len(x), np.int8)
    word = _word_characters(x)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    for number, text in enumerate(WORDS, 1):
        at = starts[lengths == len(text)]
        for offset, sign in enumerate(text):
            at = at[x[at + offset] == ord(sign)]
        kind[at] = number
    for sign, number in (("(", OPEN), (")", CLOSE), (";", SEMICOLON), ("?", DECISION)):
        kind[x == ord(sign)] = number
    for sign in "&|":
        kind[_pairs(x, sign)] = DECISION
    places = np.flatnonzero(kind)
    return places, kind[places]


def _closing(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], dict[int, tuple[int, bool]]]:
    """Places of braces and semicolons, and the end of what each opening brace opens."""
    brace = np.flatnonzero((x == 123) | (x == 125))
    opens = x[brace] == 123
    text = np.searchsorted(starts, brace, "right") - 1
    running = np.concatenate([[0], np.cumsum(np.where(opens, 1, -1))])
    depth = running[1:] - running[np.searchsorted(brace, starts)][text]
    # By text and depth: the closing brace that leaves the depth before the opening one.
    low, high = (int(depth.min()), int(depth.max()) + 1) if len(depth) else (0, 1)
    level = text * (high - low + 2) + depth - low + 1
    key = level * (len(x) + 1) + brace
    closers = np.sort(key[~opens])
    wanted = key[opens] - (len(x) + 1)
    at = np.searchsorted(closers, wanted)
    found = at < len(closers)
    same = found.copy()
    same[found] = closers[at[found]] // (len(x) + 1) == wanted[found] // (len(x) + 1)
    place = ends[text[opens]].copy()
    place[same] = closers[at[same]] % (len(x) + 1) + 1
    breaks = np.flatnonzero((x == 123) | (x == 125) | (x == 59)).tolist()
    return breaks, dict(zip(brace[opens].tolist(), zip(place.tolist(), same.tolist())))


def _after_loops(kind: np.ndarray, depth: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which tokens close the head of a ``while`` (of one function, no other between)."""
    closes, loops = np.flatnonzero(kind == CLOSE), np.flatnonzero(kind == WORDS.index("while") + 1)
    out = np.zeros(len(kind), bool)
    if not len(closes) or not len(loops):
        return out
    low = int(depth.min())
    key = np.sort((depth[closes] - low) * len(kind) + closes)
    wanted = (depth[loops] - low) * len(kind) + loops
    at = np.searchsorted(key, wanted)
    found = at < len(key)
    loops, match = loops[found], key[at[found]]
    same = match // len(kind) == depth[loops] - low
    loops, match = loops[same], match[same] % len(kind)
    following = np.append(np.flatnonzero(kind == WORDS.index("while") + 1), len(kind))
    alone = match < following[np.searchsorted(following, loops, "right")]
    mine = owner[loops] == owner[match]
    out[match[alone & mine]] = True
    return out


#: Characters that are looked at together.
TOGETHER = 1 << 20


def groups(texts: list[str]) -> Iterator[slice]:
    """Neighbouring texts of about ``TOGETHER`` characters."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= TOGETHER:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def measure(texts: list[str]) -> dict[str, list | np.ndarray]:
    """``text`` (its number), ``name``, ``line``, ``mmcc``, ``tmcc``, ``sif``, ``lif`` and
    ``incomplete`` of every function of every text, as columns.

    ``incomplete`` says that the body is never closed and took the rest of its text.
    """
    codes = [plain_code(t) for t in texts]
    code = "\n".join(codes)
    x = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths
    breaks, closing = _closing(x, starts, ends)
    found = [
        (number, *function)
        for number, (begin, end) in enumerate(zip(starts.tolist(), ends.tolist()))
        for function in functions_of(code, begin, end, breaks, closing)
    ]
    text, name, first, body, stop, end, incomplete = map(list, zip(*found)) if found else ([],) * 7
    first, body, stop, end = (np.array(c, np.int64) for c in (first, body, stop, end))
    places, kind = _tokens(x)
    low, high = np.searchsorted(places, body), np.searchsorted(places, stop)
    # Parentheses open before each token; a function's own depth starts at its body.
    steps = (kind == OPEN).astype(np.int64) - (kind == CLOSE)
    running = np.concatenate([[0], np.cumsum(steps)])
    owner = np.full(len(places), -1, np.int64)
    change = np.zeros(len(places) + 1, np.int64)
    np.add.at(change, low, np.arange(1, len(low) + 1))
    np.add.at(change, high, -np.arange(1, len(low) + 1))
    owner = np.cumsum(change[:-1]) - 1
    own_depth = running[:-1] - (running[low][owner] if len(low) else 0)
    after_loop = _after_loops(kind, running[1:], owner)
    behind = np.append(False, after_loop[:-1]) & np.append(False, owner[1:] == owner[:-1])
    single = (kind == SEMICOLON) & (own_depth == 0) & ~behind

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[high] - sums[low]

    def of(words: tuple[str, ...]) -> np.ndarray:
        return np.isin(kind, [WORDS.index(w) + 1 for w in words])

    both = 1 + total((kind == DECISION) | of(DECISIONS))
    breaks_before = np.concatenate([[0], np.cumsum(x == 10)])
    line = breaks_before[first] - breaks_before[starts][text] + 1 if found else first
    return {
        "text": np.array(text, np.int64), "name": name, "line": line,
        "mmcc": both + total(of(("switch",))), "tmcc": both + total(of(("case",))),
        "sif": total(single) + total(of(HEADERS)), "lif": breaks_before[end] - breaks_before[first] + 1,
        "incomplete": np.array(incomplete, bool),
    }


def function_metrics(text: str) -> list[tuple[str, int, int, int, int, int, bool]]:
    """Name, first line, counts and whether it is incomplete, of every function of a text."""
    found = measure([text])
    columns = ("line", "mmcc", "tmcc", "sif", "lif", "incomplete")
    return list(zip(found["name"], *(found[c].tolist() for c in columns)))
