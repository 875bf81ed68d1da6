"""Per-function complexity metrics of a table of source texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.functions.patterns import in_range
from plumbline.functions.source_batch import groups, measure
from plumbline.schema import LEAVES, METRICS


def code_metrics(sources: DataFrame, keep: Sequence[str] = (), incomplete: bool = False) -> DataFrame:
    """One row per function of every source text.

    Input ``path, content`` plus the ``keep`` columns (a snapshot id, say), which
    are repeated on the output rows. A file is read whole and independently of
    all others, so the job needs no shuffle: it runs where the scan put the
    file. The item name carries the first line, which keeps overloads apart.
    ``incomplete`` adds a column of that name: the body is never closed, so the
    function took the rest of its text.
    """
    keep = list(keep)
    schema = T.StructType([sources.schema[k] for k in keep] + LEAVES.fields)
    if incomplete:
        schema = T.StructType([*schema.fields, T.StructField("incomplete", T.BooleanType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch["content"].to_pylist()
            for part in groups(contents):
                found = measure(contents[part])
                of = pa.array(found["text"] + part.start)
                line = found["line"].tolist()
                item = pa.array([f"{name}:{at}" for name, at in zip(found["name"], line)], pa.string())
                columns = {c: batch[c].take(of) for c in [*keep, "path"]}
                columns |= {"item": item, **{n: pa.array(found[n]) for n in ("line", *METRICS, "incomplete")}}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    texts = sources.select(*keep, "path", "content").where(F.col("content").isNotNull())
    return texts.mapInArrow(run, schema)


def filter_metric_ranges(
    leaves: DataFrame, mmcc: str = "1,", tmcc: str = "1,", sif: str = "1,", lif: str = "1,"
) -> DataFrame:
    """Functions whose every metric lies in its inclusive ``lo,hi`` range."""
    for metric, bounds in zip(METRICS, (mmcc, tmcc, sif, lif)):
        leaves = leaves.where(in_range(F.col(metric), bounds))
    return leaves
