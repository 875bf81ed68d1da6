"""Text sinks: the wide view as CSV and folded stacks as lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.fetch import wide_lines

#: A quoted or plain cell with the comma or end behind it; cells of one run of ``nan``.
CELL = re.compile(r'((?:nan(?:,|$)){1,4096})|((?:"[^"]*")+|[^,]*)(?:,|$)')
CELLS = "TIME string, at int, cell string, n_cells int"
CELLS_PER_BATCH = 50_000


def write_view_csv(view: DataFrame, path: str) -> None:
    """CSV sorted by ``TIME`` with a header row; unknown values read ``nan``.

    Titles hold quotes, which are doubled as CSV readers expect.
    """
    (
        view.orderBy("TIME")
        .write.option("header", True)
        .option("nullValue", "nan")
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def write_wide_csv(points: DataFrame, path: str) -> None:
    """The wide view of any number of series as one CSV document: its part files follow
    by name, and only the first has the header."""
    wide_lines(points).select("line").write.text(path)


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """``TIME, at, cell, n_cells``: the cells of a document of ``write_wide_csv`` that are
    not ``nan``, with their place in the line (the time's is 0 and left out) and how many
    the line has. The header's time reads ``TIME``, its cells are the titles.

    Lines may have millions of cells. A line is read from left to right, and only some of
    its known cells are held at once.
    """

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch["value"]:
                yield from known_cells(line.as_py())

    return spark.read.text(path).mapInArrow(cells, CELLS)


def known_cells(line: str, size: int = CELLS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The known cells of one line, ``size`` in a batch."""
    time, n_cells = line.partition(",")[0], sum(width for _, width, _ in _scan(line))

    def batch() -> pa.RecordBatch:
        n = len(places)
        return pa.RecordBatch.from_pydict(
            {"TIME": [time] * n, "at": pa.array(places, pa.int32()), "cell": texts, "n_cells": pa.array([n_cells] * n, pa.int32())}
        )

    places, texts = [], []
    for at, _, text in _scan(line):
        if at and text is not None:
            places.append(at)
            texts.append(text)
            if len(places) == size:
                yield batch()
                places, texts = [], []
    if places:
        yield batch()


def _scan(line: str) -> Iterator[tuple[int, int, str | None]]:
    """Place, number and text of the cells; a run of unknown ones at once, without text."""
    at, end = 0, 0
    for found in CELL.finditer(line):
        # Behind a cell that ends the line nothing is left.
        if found.start() == len(line) and not (end == 0 or line[end - 1] == ","):
            return
        end = found.end()
        width = 1 if found[1] is None else found[1].count("nan")
        yield at, width, found[2]
        at += width


def write_folded(folded: DataFrame, path: str) -> None:
    """One line per stack: the frames, a blank, the value."""
    line = F.concat_ws(" ", "stack", F.col("value").cast("string"))
    folded.select(line.alias("value")).write.text(path)
