"""Languages of documents and of the spans of mixed ones (operator 4)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm import packed

#: Labelled documents that the scores are learned from, at most; one of each language stays.
SAMPLE = 6000
#: Hash cells of the character grams, and the gram lengths.
CELLS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
#: A script counts for a language from this share of its letters.
SCRIPT_SHARE = 0.002
#: Words whose scores a worker remembers.
REMEMBERED = 120_000
#: New words that are scored at a time.
STEP = 10_000
UNKNOWN = "und"
#: Rows of held-out documents have this remainder.
FOLDS, HELD_OUT = 4, 2

WORD = re.compile(r"[^\W\d_]+")

#: First and last code point of the script ranges.
SCRIPTS = [
    ("latin", 0x41, 0x24F),
    ("ipa", 0x250, 0x2AF),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("indic", 0x900, 0xDFF),
    ("thai", 0xE00, 0xE7F),
    ("tibetan", 0xF00, 0xFFF),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x139F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
NAMES = sorted({name for name, _, _ in SCRIPTS}) + ["other"]
_FIRST = np.array([low for _, low, _ in SCRIPTS])
_LAST = np.array([high for _, _, high in SCRIPTS])
_NUMBER = np.array([NAMES.index(name) for name, _, _ in SCRIPTS])


def script_of(points: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(_FIRST, points, "right") - 1, 0)
    inside = (points >= _FIRST[at]) & (points <= _LAST[at])
    return np.where(inside, _NUMBER[at], len(NAMES) - 1)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of every gram of every word (with its edges), the word it is of, and
    the script of each word's first letter."""
    text = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    cells, owners = [], []
    value = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        value = value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :].astype(np.uint64)
        if n in GRAMS:
            whole = owner[: len(value)] == owner[n - 1 :]
            cells.append((packed.mix(value + np.uint64(n << 40))[whole] % np.uint64(CELLS)).astype(np.int64))
            owners.append(owner[: len(value)][whole])
    script = script_of(points[np.minimum(starts + 1, len(points) - 1)]) if len(words) else np.empty(0, np.int64)
    return np.concatenate(cells), np.concatenate(owners), script


@dataclass
class Model:
    """Log probabilities of the cells by language, and the languages of each script."""

    languages: list[str]
    cells: np.ndarray
    allowed: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        cell, owner, script = grams_of(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        order = np.argsort(owner, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(owner[order]) > 0))
        out[owner[order][heads]] = np.add.reduceat(self.cells[cell[order]], heads, axis=0)
        return np.where(self.allowed[script], out, np.float32(-1e4))


class Scorer:
    """Word scores of a model, remembered up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)), np.float32)

    def codes(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.index})
        if len(self.index) + len(new) > REMEMBERED:
            self.clear()
            new = list(set(words))
        if new:
            self.index.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            # A word has dozens of grams, so few words are scored at a time.
            parts = [self.model.scores(new[i : i + STEP]) for i in range(0, len(new), STEP)]
            self.table = np.concatenate([self.table, *parts])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word, for all rows of ``offsets`` side by side.

    Staying is free and any change costs ``switch``. Step ``t`` handles word
    ``t`` of all rows that are long enough.
    """
    lengths = np.diff(offsets)
    rows = np.argsort(-lengths, kind="stable")
    firsts, lengths = offsets[:-1][rows], lengths[rows]
    number, kinds = len(rows), scores.shape[1]
    came = np.zeros(scores.shape, np.int16)
    best = np.zeros((number, kinds))
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if number else 0) + 1), "right")
    stay = np.arange(kinds, dtype=np.int16)
    for t, live in enumerate(active):
        at = firsts[:live] + t
        if t == 0:
            best[:live] = scores[at]
            continue
        have = best[:live]
        top = have.argmax(axis=1)
        move = have[np.arange(live), top] - switch
        changed = move[:, None] > have
        came[at] = np.where(changed, top[:, None], stay)
        best[:live] = np.where(changed, move[:, None], have) + scores[at]
    path = np.zeros(len(scores), np.int16)
    state = best.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        live = active[t]
        at = firsts[:live] + t
        path[at] = state[:live]
        state[:live] = came[at, state[:live]] if t else state[:live]
    return path


def is_held_out(key: str = "doc_id"):
    """Rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _counted(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(languages), CELLS), np.int64)
        scripts = np.zeros((len(languages), len(NAMES)), np.int64)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text.lower())
                if words:
                    cell, _, script = grams_of(words)
                    cells[languages.index(lang)] += np.bincount(cell, minlength=CELLS)
                    scripts[languages.index(lang)] += np.bincount(script, minlength=len(NAMES))
        rows = [i for i in range(len(languages)) if scripts[i].any()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int32()),
                pa.array([cells[i].tobytes() for i in rows], pa.binary()),
                pa.array([scripts[i].tobytes() for i in rows], pa.binary()),
            ],
            names=["language", "cells", "scripts"],
        )

    return run


def _summed(table: pa.Table) -> pa.Table:
    first = table["language"][0].as_py()
    sums = [
        np.frombuffer(b"".join(table[n].to_pylist()), np.int64).reshape(table.num_rows, -1).sum(axis=0).tobytes()
        for n in ("cells", "scripts")
    ]
    return pa.table(
        {
            "language": pa.array([first], pa.int32()),
            "cells": pa.array([sums[0]], pa.binary()),
            "scripts": pa.array([sums[1]], pa.binary()),
        }
    )


def sampled(known: DataFrame, counts: dict[str, int], sample: int) -> DataFrame:
    """The rows of the smallest hashes of every language, an equal number of each.

    A bound on the hash, from the language's rows, leaves about twice as many and 40
    more of each, so that the rows of a common language are not ranked in one task.
    """
    each = max(1, sample // len(counts))
    rows = known.sparkSession.createDataFrame(list(counts.items()), "lang string, rows long")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = known.join(F.broadcast(rows), "lang").select("text", "lang", F.xxhash64("doc_id").alias("h"), part.alias("part"), "rows")
    few = few.where(F.col("part") * F.col("rows") <= 2 * each + 40)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("part", "h", "text"))
    return few.withColumn("rank", rank).where(F.col("rank") <= each)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, an equal
    number of every language (one at least) chosen by a hash of the id, so that no
    label is lost. Counts per language are what reaches the driver."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & ~is_held_out())
    counts = dict(map(tuple, known.groupBy("lang").count().collect()))
    chosen = sampled(known, counts, sample) if counts else known
    chosen = chosen.select("text", "lang").repartition(8)
    languages = sorted(counts)
    fields = "language int, cells binary, scripts binary"
    rows = chosen.mapInArrow(_counted(languages), fields).groupBy("language").applyInArrow(_summed, fields).collect()
    rows = sorted((r["language"], r["cells"], r["scripts"]) for r in rows)
    if not rows:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    cells = np.array([np.frombuffer(c, np.int64) for _, c, _ in rows], float)
    scripts = np.array([np.frombuffer(s, np.int64) for _, _, s in rows], float)
    logs = np.log((cells + 0.5) / (cells.sum(axis=1, keepdims=True) + 0.5 * CELLS))
    allowed = (scripts / scripts.sum(axis=1, keepdims=True) >= SCRIPT_SHARE).T
    # A script that no language has leaves all of them open.
    allowed[~allowed.any(axis=1)] = True
    return Model([languages[i] for i, _, _ in rows], np.ascontiguousarray(logs.T, np.float32), allowed)


def _labelled(model, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        names = scorer.model.languages
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            split = [WORD.findall(t.lower()) for t in texts]
            offsets = np.cumsum([0, *map(len, split)])
            words = [w for s in split for w in s]
            langs, shares, pieces = [], [], []
            if names and words:
                codes = scorer.codes(words)
                path = viterbi(scorer.table[codes], offsets)
                letters = np.fromiter(map(len, words), np.int64, len(words))
                row = np.repeat(np.arange(len(texts)), np.diff(offsets))
                weight = np.bincount(row * len(names) + path, letters, len(texts) * len(names)).reshape(len(texts), -1)
            for i in range(len(texts)):
                own = split[i]
                if not names or not any(c.isalpha() for w in own for c in w):
                    langs.append(UNKNOWN)
                    shares.append(0.0)
                    pieces.append([])
                    continue
                top = int(weight[i].argmax())
                langs.append(names[top])
                shares.append(float(weight[i, top] / weight[i].sum()))
                if spans:
                    own = path[offsets[i] : offsets[i + 1]]
                    at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    ends = np.append(at[1:], len(own))
                    pieces.append([{"first": int(a), "last": int(b) - 1, "lang": names[own[a]]} for a, b in zip(at, ends)])
                else:
                    pieces.append(None)
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(shares, pa.float64()), pa.array(pieces, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "__lang", "__share", "__spans"])
        scorer.clear()
        packed.release()

    return run


def label(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """All columns of ``docs`` with ``__lang`` (the language with most letters),
    ``__share`` (its share of the letters) and ``__spans`` (runs of words of one
    language, numbered from 0 over the runs of letters).

    A text that is NULL or has no letter is ``und`` with share 0 and no spans, and
    so is every text if there was nothing to learn from. Ties go to the first
    language by name. An empty table gives an empty result.
    """
    packed.small_batches(docs.sparkSession)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += ["__lang string", "__share double", "__spans array<struct<first:long,last:long,lang:string>>"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_labelled(sent, spans), ", ".join(fields))


def predict(docs: DataFrame) -> DataFrame:
    """The query's digest: fold, predicted language and score of every row."""
    done = label(docs.select("doc_id", "text"), learn(docs), spans=False)
    return done.select(
        "doc_id",
        is_held_out().alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__share").alias("score"),
    )


def with_language(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text has no language (``und``)."""
    done = label(docs, learn(docs), spans=False)
    return done.where(F.col("__lang") != UNKNOWN).select(*[f"`{c}`" for c in docs.columns])
