"""Suffix order of byte strings by two-stage sorting, in numpy.

Only the suffixes that are smaller than their successor are sorted directly.
The others are induced: buckets are scanned in ascending order, and every suffix
met places the suffix one byte before it at the front of that byte's bucket.
Scans handle a whole bucket at once; only a run of one repeated byte needs a
step for each of its bytes.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray, depth: int) -> np.ndarray:
    """The eight bytes from every position as one big-endian number (zeros past the end)."""
    padded = np.concatenate([text, np.zeros(depth + 8, np.uint8)])
    out = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : len(padded) - 7 + i].astype(np.uint64)
    return out


def _sorted_directly(picked: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """``picked`` ordered by their first ``depth`` bytes: eight bytes at a time,
    and only groups that are still tied go on."""
    order = picked[np.argsort(eight[picked], kind="stable")]
    group = np.cumsum(np.append(True, eight[order][1:] != eight[order][:-1])) if len(order) else order
    tied = np.arange(len(order))
    for at in range(8, depth, 8):
        sizes = np.bincount(group[tied]) if len(tied) else np.empty(0, np.int64)
        tied = tied[sizes[group[tied]] > 1] if len(tied) else tied
        if not len(tied):
            break
        keys, groups = eight[order[tied] + at], group[tied]
        inner = np.lexsort((keys, groups))
        order[tied] = order[tied][inner]
        keys = keys[inner]
        new = np.append(True, (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1]))
        # Group numbers only have to differ; those of tied rows start afresh.
        group = group.copy()
        group[tied] = np.cumsum(new)
        done = np.ones(len(group), bool)
        done[tied] = False
        group[done] = 0
    return order


def suffix_order(text: np.ndarray, depth: int, eight: np.ndarray | None = None) -> np.ndarray:
    """Positions of ``text`` ordered by the suffixes' first ``depth`` bytes at least.

    The end of the text counts as smaller than any byte. Suffixes that agree on
    ``depth`` bytes may stand in any order, next to one another.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64)
    eight = words_at(text, depth) if eight is None else eight
    # Smaller than the successor: the next different byte is greater.
    change = np.flatnonzero(text[1:] != text[:-1])
    rising = np.zeros(n, bool)
    if len(change):
        ends = np.append(change, n - 1)
        lengths = np.diff(np.append(-1, ends))
        ups = np.append(text[change + 1] > text[change], False)
        rising = np.repeat(ups, lengths)
    direct = _sorted_directly(np.flatnonzero(rising), eight, depth)
    sizes = np.bincount(text, minlength=256)
    starts = np.cumsum(sizes) - sizes
    out = np.full(n, -1, np.int64)
    fill = starts.copy()
    of_direct = np.bincount(text[direct], minlength=256) if len(direct) else np.zeros(256, np.int64)
    at = 0
    for byte in np.flatnonzero(of_direct):
        count = of_direct[byte]
        end = starts[byte] + sizes[byte]
        out[end - count : end] = direct[at : at + count]
        at += count
    # The last suffix has only the empty one behind it, which comes first.
    out[fill[text[-1]]] = n - 1
    fill[text[-1]] += 1

    def induce(found: np.ndarray, own: int | None) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[~rising[before]]
        of = text[before]
        if own is None:
            return before
        return before[of == own]

    for byte in np.flatnonzero(sizes):
        low, split = starts[byte], starts[byte] + sizes[byte] - of_direct[byte]
        # Inside the bucket: runs of the same byte, one step for each byte.
        at = low
        while at < fill[byte]:
            new = induce(out[at : fill[byte]], byte)
            at = fill[byte]
            out[at : at + len(new)] = new
            fill[byte] = at + len(new)
        assert fill[byte] == split, "every suffix has its place"
        whole = out[low : starts[byte] + sizes[byte]]
        before = induce(whole, None)
        before = before[text[before] > byte]
        of = text[before]
        order = np.argsort(of, kind="stable")
        before, of = before[order], of[order]
        counts = np.bincount(of, minlength=256) if len(of) else np.zeros(256, np.int64)
        done = 0
        for other in np.flatnonzero(counts):
            out[fill[other] : fill[other] + counts[other]] = before[done : done + counts[other]]
            fill[other] += counts[other]
            done += counts[other]
    return out


def common_prefixes(order: np.ndarray, text: np.ndarray, depth: int, eight: np.ndarray | None = None) -> np.ndarray:
    """Whether each suffix in ``order`` shares ``depth`` bytes with the one before.

    Both must have that many bytes; the caller passes only such suffixes.
    """
    eight = words_at(text, depth) if eight is None else eight
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        left, right = order[:-1], order[1:]
        ok = np.ones(len(left), bool)
        for at in [*range(0, depth - 7, 8), depth - 8]:
            ok &= eight[left + at] == eight[right + at]
        same[1:] = ok
    return same
