"""Suffix-array removal of repeated byte strings (operator 6)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import packed, repeats
from plumbline.llm.suffixes import common_prefixes, suffix_order, words_at

WINDOW = 50
GRAM = 20


def _compare(text, begins, lengths, docs, groups, window):
    """Sort the suffixes of all contexts; neighbours that share ``window`` bytes
    are one string, and all but its smallest document's starts are marked."""
    eight = words_at(text, window)
    order = suffix_order(text, window, eight)
    which = np.searchsorted(begins, order, "right") - 1
    whole = order + window <= begins[which] + lengths[which]
    order, which = order[whole], which[whole]
    same = common_prefixes(order, text, window, eight)
    heads = np.flatnonzero(~same)
    doc = docs[which]
    smallest = np.minimum.reduceat(doc, heads)
    later = doc > np.repeat(smallest, np.diff(np.append(heads, len(doc))))
    return np.sort(order[later])


def _kept(window: int, whole_characters: bool):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        data, offsets, _, gone = repeats.covered(docs, marks, lambda _, o: o, window)
        if whole_characters:
            # A character goes only if all of its bytes go.
            first = (data & 0xC0) != 0x80
            first[offsets[:-1][offsets[:-1] < len(data)]] = True
            heads = np.flatnonzero(first)
            if len(heads):
                every = np.logical_and.reduceat(gone, heads)
                gone = np.repeat(every, np.diff(np.append(heads, len(data))))
        total = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        begin = offsets[:-1][offsets[:-1] < len(data)]
        opens[begin] = gone[begin]
        spans = np.concatenate([[0], np.cumsum(opens)])
        removed = total[offsets[1:]] - total[offsets[:-1]]
        texts, hashes = [], []
        for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
            left = data[a:b]
            left = (left[~gone[a:b]] if removed[row] else left).tobytes()
            texts.append(left)
            hashes.append(hashlib.sha256(left).hexdigest())
        out = docs.drop_columns(["__block"])
        extra = {
            "__n_bytes": pa.array(np.diff(offsets)),
            "__n_removed": pa.array(removed.astype(np.int64)),
            "__n_spans": pa.array((spans[offsets[1:]] - spans[offsets[:-1]]).astype(np.int64)),
            "__sha256": pa.array(hashes, pa.string()),
        }
        if whole_characters:
            extra["__kept"] = pa.array(texts, pa.binary()).cast(pa.string())
        for name, column in extra.items():
            out = out.append_column(name, column)
        return out

    return run


def dedup_bytes(docs: DataFrame, window: int = WINDOW, keep_characters: bool = False) -> DataFrame:
    """All columns of ``docs`` (``doc_id``, ``text`` and any others), with
    ``__n_bytes``, ``__n_removed``, ``__n_spans``, ``__sha256`` of what is left,
    and ``__kept`` (the text left) with ``keep_characters``.

    A byte goes if a string of ``window`` bytes over it also starts in a row with
    a smaller ``doc_id``. NULL text reads as empty, a row without ``doc_id``
    keeps all, rows of the same ``doc_id`` do not remove one another, an empty
    table gives an empty result. With ``keep_characters`` a character stays
    unless all its bytes are covered, so that the rest is valid UTF-8.
    """
    placed, marks = repeats.marked_windows(docs, repeats.Bytes, window, min(GRAM, window), _compare)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += ["__n_bytes long", "__n_removed long", "__n_spans long", "__sha256 string"]
    fields += ["__kept string"] if keep_characters else []
    run = _kept(window, keep_characters)
    return placed.groupBy("__block").cogroup(marks.groupBy("__block")).applyInArrow(run, ", ".join(fields))


def digest(docs: DataFrame) -> DataFrame:
    done = dedup_bytes(docs.select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("__n_bytes").alias("n_bytes"),
        F.col("__n_removed").alias("n_removed"),
        F.col("__n_spans").alias("n_spans"),
        F.col("__sha256").alias("kept_sha256"),
    )


def removed_text(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings taken out of ``text`` and ``n_chars`` to match."""
    done = dedup_bytes(docs, keep_characters=True)
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.when(F.col("text").isNotNull(), F.col("__kept")).alias("text"))
        elif name == "n_chars":
            columns.append(
                F.when(F.col("text").isNotNull(), F.length("__kept").cast(docs.schema[name].dataType)).alias(name)
            )
        else:
            columns.append(F.col(f"`{name}`"))
    return done.select(*columns)
