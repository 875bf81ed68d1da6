"""Measuring only texts that were not measured before.

Results are kept by content: one row for each text and version of the counting rules,
with the functions of the text. A collection hashes its texts, parses those whose hash
the table does not have, and joins the results to its paths. A file that was moved or
copied costs nothing, and a change of the rules measures everything anew.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.source_batch import groups, measure
from plumbline.functions.source_text import RULES
from plumbline.plans.session import materialize
from plumbline.schema import METRICS

#: A function of a text, as ``source_batch.measure`` tells it.
FIELDS = {"name": pa.string(), "line": pa.int64(), **{m: pa.int64() for m in METRICS}, "incomplete": pa.bool_()}
_SPELLED = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
RESULTS = f"hash string, functions array<struct<{', '.join(f'{n}: {_SPELLED[k]}' for n, k in FIELDS.items())}>>"


def read_results(spark: SparkSession, path: str, rules: int = RULES, but: str | None = None) -> DataFrame:
    """``hash, functions`` of the texts measured under these rules, without those of
    the run ``but``; empty at first."""
    try:
        stored = spark.read.schema(f"{RESULTS}, rules int, run string").option("basePath", path).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)
    mine = stored.where(F.col("rules") == rules)
    return (mine if but is None else mine.where(F.col("run") != but)).select("hash", "functions")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["content"].to_pylist()
        for part in groups(texts):
            found = measure(texts[part])
            count = part.stop - part.start
            # Functions come by text, in order.
            offsets = np.searchsorted(found["text"], np.arange(count + 1)).astype(np.int32)
            functions = pa.StructArray.from_arrays([pa.array(found[n], k) for n, k in FIELDS.items()], names=list(FIELDS))
            lists = pa.ListArray.from_arrays(pa.array(offsets), functions)
            yield pa.RecordBatch.from_arrays([batch["hash"].slice(part.start, count), lists], names=["hash", "functions"])


def measure_new(sources: DataFrame, path: str, run: str, rules: int = RULES) -> DataFrame:
    """Measure the texts that ``path`` has no result for; the new results.

    Texts are read twice but never shuffled unless many are new: first only their
    hashes are compared with the table, then those that are new are parsed where the
    scan put them. ``run`` names the part of the table that this collection writes;
    repeating a collection under its name writes the same part.
    """
    spark = sources.sparkSession
    hashed = sources.where(F.col("content").isNotNull()).select(F.sha2("content", 256).alias("hash"), "content")
    part = f"{path}/rules={rules}/run={run}"
    # A run that is repeated measures what it measured before.
    known = read_results(spark, path, rules, but=run)
    fresh = materialize(hashed.select("hash").distinct().join(known.select("hash"), "hash", "left_anti"), "new-texts")
    parsed = hashed.join(fresh, "hash", "left_semi").mapInArrow(_measured, RESULTS)
    # Equal texts in several files give one result.
    parsed.dropDuplicates(["hash"]).write.mode("overwrite").parquet(part)
    return spark.read.schema(RESULTS).parquet(part)


def metrics_of_changed(
    sources: DataFrame, path: str, run: str, keep: Sequence[str] = (), incomplete: bool = False, rules: int = RULES
) -> DataFrame:
    """What ``code_metrics`` gives, measuring only texts that ``path`` has not.

    Takes the same columns; the results table grows by the new texts.
    """
    measure_new(sources, path, run, rules)
    results = read_results(sources.sparkSession, path, rules)
    # Two collections at a time may both have measured a text.
    one_each = results.groupBy("hash").agg(F.first("functions").alias("functions"))
    listed = sources.where(F.col("content").isNotNull()).select(*keep, "path", F.sha2("content", 256).alias("hash"))
    rows = listed.join(one_each, "hash").select(*keep, "path", F.inline("functions"))
    item = F.concat("name", F.lit(":"), F.col("line").cast("string")).alias("item")
    return rows.select(*keep, "path", item, "line", *METRICS, *(["incomplete"] if incomplete else []))
