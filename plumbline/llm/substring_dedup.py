"""Relative Lempel-Ziv removal of repeated passages of words (operator 2)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed, repeats

WINDOW = 50
GRAM = 16


class Reference:
    """The indexed blocks of earlier documents: every window of their tokens by
    hash, with the place where its smallest document has it."""

    def __init__(self, tokens, starts, docs_of_starts, window: int):
        self.tokens, self.window = tokens, window
        hashes = packed.Rolling(tokens).spans(starts, starts + window)
        order = np.lexsort((starts, docs_of_starts, hashes))
        hashes, starts = hashes[order], starts[order]
        head = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.empty(0, bool)
        self.hashes, self.places = hashes[head], starts[head]

    def longest_matches(self, starts) -> np.ndarray:
        """For every window the place in the reference where it stands first."""
        hashes = packed.Rolling(self.tokens).spans(starts, starts + self.window)
        place = self.places[np.searchsorted(self.hashes, hashes)]
        equal = np.ones(len(starts), bool)
        for j in range(self.window):
            equal &= self.tokens[starts + j] == self.tokens[place + j]
        return np.where(equal, place, starts)


def factors(starts, places, docs_of_starts, docs_of_places):
    """Greedy factors of neighbouring windows, as (first window, number of windows).

    A factor copies from one place of an earlier document and runs on while the
    next token continues the copy. Where it ends, the windows over the boundary
    are looked up anew, so a repeat that no single factor holds is still found.
    Only factors of at least one window count.
    """
    copied = docs_of_places < docs_of_starts
    follows = np.zeros(len(starts), bool)
    follows[1:] = (
        copied[1:] & copied[:-1] & (starts[1:] == starts[:-1] + 1) & (places[1:] == places[:-1] + 1)
    )
    heads = np.flatnonzero(copied & ~follows)
    ends = np.flatnonzero(np.append(~follows, True))
    nxt = ends[np.searchsorted(ends, heads, "right")]
    return starts[heads], nxt - heads


def _compare(text, begins, lengths, docs, groups, window):
    """Factor all contexts against the block that they form themselves; a copy
    counts if it comes from a smaller document."""
    sizes = lengths - window + 1
    starts = packed.ragged(begins, sizes)
    doc = np.repeat(docs, sizes)
    reference = Reference(text, starts, doc, window)
    places = reference.longest_matches(starts)
    of_place = docs[np.searchsorted(begins, places, "right") - 1]
    first, count = factors(starts, places, doc, of_place)
    return packed.ragged(first, count)


def _kept(window: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        def bounds_of(data, offsets):
            return packed.words_of(data, offsets)[2]

        data, offsets, bounds, gone = repeats.covered(docs, marks, bounds_of, window)
        texts = []
        for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            words = data[a:b].tobytes().split()
            lost = gone[bounds[row] : bounds[row + 1]]
            if lost.any():
                words = [words[i] for i in np.flatnonzero(~lost)]
            texts.append(b" ".join(words))
        total = np.concatenate([[0], np.cumsum(gone)])
        out = docs.drop_columns(["__block"])
        for name, column in {
            "__n_words": pa.array(np.diff(bounds).astype(np.int64)),
            "__n_removed": pa.array((total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64)),
            "__sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            "__kept": pa.array(texts, pa.binary()).cast(pa.string()),
        }.items():
            out = out.append_column(name, column)
        return out

    return run


def dedup_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` (``doc_id``, ``text`` and any others), with
    ``__n_words``, ``__n_removed``, ``__kept`` (the words left, joined by one
    space) and its ``__sha256``.

    Words are separated by blanks and the five ASCII controls next to tab. A word
    goes if ``window`` consecutive words over it also start in a row with a
    smaller ``doc_id``. NULL and empty texts have no words, a row without
    ``doc_id`` keeps all, rows of the same ``doc_id`` do not remove one another,
    an empty table gives an empty result.
    """
    gram = max(1, min(GRAM, window))
    placed, marks = repeats.marked_windows(docs, repeats.Words, window, gram, _compare)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += ["__n_words long", "__n_removed long", "__sha256 string", "__kept string"]
    return placed.groupBy("__block").cogroup(marks.groupBy("__block")).applyInArrow(_kept(window), ", ".join(fields))


def digest(docs: DataFrame) -> DataFrame:
    done = dedup_words(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_removed").alias("n_removed"),
        F.col("__sha256").alias("kept_sha256"),
    )
