"""Periodic runs of words by string synchronising sets (operator 13).

A run is a longest stretch of words with a smallest period q that holds at least
four periods. Words are compared by 64-bit hashes.

* Periods below ``DIRECT`` are the highly periodic regions. They are detected
  separately, by comparing every word with the q-th after it.
* For every dyadic scale t from ``DIRECT`` on, a synchronising set picks positions
  by the hashes of the t words behind them: i is picked if the least hash among
  i .. i + t stands at i or at i + t. Whether i is picked depends only on the 2 t
  words from i, so equal contexts are picked alike. Positions whose t words have a
  period of at most t / 4 are left out: the set would be dense there, and the
  region has its small period from a scale before.
* Any t neighbouring positions that are not all left out hold a picked one. A run
  of period q with t <= q < 2 t therefore has a picked position with the same
  context q words on, and none in between, as 2 t >= q. So neighbours among equal
  contexts propose all periods, and the proposed period is the smallest one.
* Proposals are extended both ways by binary search over prefix hashes, and what
  they give is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm import packed

#: Periods below this are found by direct comparison; the first scale.
DIRECT = 8
#: Periods that a run holds at least, and words.
EXPONENT, SHORTEST = 4, 6

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Runs:
    """Start, length and period of runs, as columns; sorted by start for each period."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> None:
        if len(start):
            self.parts.append((start, length, period))

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            none = np.empty(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(c) for c in zip(*self.parts))


def _islands(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every stretch of set values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def small_periods(words: np.ndarray, row: np.ndarray, found: Runs) -> None:
    """Runs of periods below ``DIRECT``; ``row`` numbers the text of each word."""
    by_period: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for q in range(1, min(DIRECT, len(words))):
        start, equal = _islands((words[q:] == words[:-q]) & (row[q:] == row[:-q]))
        long = equal >= (EXPONENT - 1) * q
        start, length = start[long], equal[long] + q
        for p, (starts, ends) in by_period.items():
            if q % p == 0 and len(starts) and len(start):
                at = np.searchsorted(starts, start, "right") - 1
                inside = (at >= 0) & (ends[at] >= start + length)
                start, length = start[~inside], length[~inside]
        by_period[q] = start, start + length
        found.add(start, length, np.full(len(start), q))


def synchronising_set(rolling: packed.Rolling, left_out: np.ndarray, scale: int) -> np.ndarray:
    """Picked positions, given which windows of ``scale`` words are left out."""
    ids = rolling.grams(scale)
    never = np.iinfo(np.uint64).max
    ids[left_out[: len(ids)]] = never
    least = packed.sliding_min(ids, scale + 1)
    own, far = ids[: len(least)], ids[scale:]
    return np.flatnonzero(((least == own) | (least == far)) & (least != never))


def _common(rolling: packed.Rolling, a: np.ndarray, b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``a`` and ``b`` on (back, if ``step`` is -1) agree, ``room`` at most."""
    low, high = np.zeros(len(a), np.int64), room.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        if step > 0:
            equal = rolling.spans(x, x + middle) == rolling.spans(y, y + middle)
        else:
            equal = rolling.spans(x - middle, x) == rolling.spans(y - middle, y)
        low[open_] = np.where(equal, middle, low[open_])
        high[open_] = np.where(equal, high[open_], middle - 1)


def periods_of_scale(words: np.ndarray, bounds: np.ndarray, scale: int, found: Runs) -> None:
    """Runs of periods from ``scale`` up to twice that, in texts that can hold one."""
    long = np.flatnonzero(np.diff(bounds) >= EXPONENT * scale)
    lengths = np.diff(bounds)[long]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    x = words[packed.ragged(bounds[long], lengths)]
    row = np.repeat(np.arange(len(long)), lengths)
    # Regions of small period, from the scales before.
    start, length, period = found.columns()
    which = np.searchsorted(bounds[long], start, "right") - 1
    here = (which >= 0) & (start < bounds[long][which] + lengths[which])
    short = here & (period * 4 <= scale) & (length >= scale)
    change = np.zeros(len(x) + 1, np.int32)
    moved = start[short] - bounds[long][which[short]] + begins[which[short]]
    np.add.at(change, moved, 1)
    np.add.at(change, moved + length[short] - scale + 1, -1)
    rolling = packed.Rolling(x)
    picked = synchronising_set(rolling, np.cumsum(change[:-1]) > 0, scale)
    picked = picked[picked + 2 * scale <= ends[row[picked]]]
    # Neighbours among equal contexts of one text.
    context = rolling.spans(picked, picked + 2 * scale) ^ packed.mix(row[picked].astype(np.uint64) + np.uint64(1))
    order = np.argsort(context, kind="stable")
    near, far = picked[order[:-1]], picked[order[1:]]
    gap = far - near
    same = (context[order][1:] == context[order][:-1]) & (gap >= scale) & (gap < 2 * scale)
    near, gap = near[same & (row[near] == row[far])], gap[same & (row[near] == row[far])]
    if not len(near):
        return
    # One proposal for each chain whose contexts overlap at the same distance.
    order = np.lexsort((near, gap))
    near, gap = near[order], gap[order]
    fresh = np.append(True, (gap[1:] != gap[:-1]) | (near[1:] > near[:-1] + 2 * scale) | (row[near[1:]] != row[near[:-1]]))
    heads = np.flatnonzero(fresh)
    first, last, q = near[heads], near[np.append(heads[1:], len(near)) - 1], gap[heads]
    text = row[first]
    back = _common(rolling, first, first + q, first - begins[text], -1)
    ahead = _common(rolling, last, last + q, ends[text] - last - q, 1)
    start, length = first - back, last + q + ahead - first + back
    enough = length >= EXPONENT * q
    runs = np.unique(np.stack([start[enough], length[enough], q[enough]], 1), axis=0)
    equal = np.array([np.array_equal(x[s : s + n - p], x[s + p : s + n]) for s, n, p in runs], bool)
    start, length, q = runs[equal].T if len(runs) else (first[:0],) * 3
    text = row[start]
    found.add(start - begins[text] + bounds[long][text], length, q)


def runs_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the texts whose words (hashes) lie between ``bounds``: start
    (in ``words``), length, period, by start and period."""
    found = Runs()
    sizes = np.diff(bounds)
    small_periods(words, np.repeat(np.arange(len(sizes)), sizes), found)
    scale = DIRECT
    while len(sizes) and EXPONENT * scale <= sizes.max():
        periods_of_scale(words, bounds, scale, found)
        scale *= 2
    start, length, period = found.columns()
    keep = length >= np.maximum(SHORTEST, EXPONENT * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        data, offsets = packed.utf8(batch.column(1))
        for low, high in packed.groups_of(offsets, packed.CHUNK):
            part = data[offsets[low] : offsets[high]]
            begin, end, bounds = packed.words_of(part, offsets[low : high + 1] - offsets[low])
            start, length, period = runs_of(packed.word_hashes(part, begin, end), bounds)
            # A run's words after its first period go.
            change = np.zeros(len(begin) + 1, np.int32)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            text = np.searchsorted(bounds, start, "right") - 1
            runs = pa.StructArray.from_arrays(
                [pa.array(c) for c in (start - bounds[text], length, period)], fields=list(RUN)
            )
            held = np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32)
            collapsed = []
            for r in range(high - low):
                a, b = offsets[low + r] - offsets[low], offsets[low + r + 1] - offsets[low]
                tokens = part[a:b].tobytes().split()
                if held[r] < held[r + 1]:
                    tokens = [tokens[i] for i in np.flatnonzero(~gone[bounds[r] : bounds[r + 1]])]
                collapsed.append(b" ".join(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(low, high - low),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(held), runs),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )
    packed.release()


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs``.

    Words lie between blanks and the five ASCII controls next to tab. ``runs`` holds
    every longest stretch with a smallest period q and at least max(6, 4 q) words:
    ``start`` (number of its first word), ``length``, ``period``, by start and
    period. ``collapsed`` is the text without the words that a run holds after its
    first period, joined by one space.

    NULL and empty texts have no words and no runs. Every row is judged alone, so
    repeated rows give repeated results and a NULL id stays NULL; an empty table
    gives an empty result. No other column is read, so their names cannot clash.
    There is no shuffle: a text is handled where the scan puts it, in memory
    proportional to its length.
    """
    packed.small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_found, RESULT)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where one document in ten repeats a part of itself.

    With h the CRC-32 of the decimal id, g = h div 10 and n words: if 10 divides h,
    word i from a = g mod n on becomes word a + (i - a) mod p, where p is
    1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    some = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n, g = F.when(F.size("words") > 0, F.size("words")), F.floor(F.col("h") / 10)
    a = F.pmod(g, n)
    p = F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1
    some = some.withColumns({"n": n, "a": a.cast("int"), "p": p.cast("int")})
    part = F.slice("words", F.col("a") + 1, "p")
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.concat(F.slice("words", 1, F.col("a")), F.flatten(F.array_repeat(part, times))), 1, F.col("n"))
    text = F.when(F.col("n").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text"))
    return some.select("doc_id", text.alias("text"))


def _longest(field: str) -> Column:
    """Of the longest run, the first one, of the smallest period."""
    keyed = F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start, r.period))
    best = F.array_min(keyed)
    return {"start": best["start"], "period": best["period"], "length": -best["less"]}[field]


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every planted document."""
    found = periodic_runs(planted(docs.select("doc_id", "text")))
    lines = F.transform(
        "runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period)
    )
    best = found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[_longest(f).alias(f) for f in ("start", "length", "period")],
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    milli = F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("long")
    return best.select(
        "doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
