"""Approximate statistics of wide nodes: quantile sketches merged up the tree.

A file's leaves become one KLL sketch for each metric, which is all that goes up the
tree: one row for each file and enclosing node is shuffled, however many leaves a file
has, and a sketch stays small however many it stands for. The rows of the files are a
table worth keeping for each snapshot; any quantile of any node can be read from it
later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.naming import tidy_path
from plumbline.operators.tree import explode_ancestors
from plumbline.schema import METRICS

#: Size of a sketch. A quantile's rank is off by at most ``RANK_ERROR`` of all leaves,
#: with 99 per cent certainty each.
SIZE, RANK_ERROR = 800, 0.005

_WHOLE = ("byte", "short", "integer", "long")


def _kind(df: DataFrame, metric: str) -> str:
    return "bigint" if df.schema[metric].dataType.typeName() in _WHOLE else "double"


def file_sketches(
    leaves: DataFrame, path_col: str = "leaf_path", keys: Sequence[str] = (), metrics: Sequence[str] = METRICS, size: int = SIZE
) -> DataFrame:
    """One row per file: the number of leaves and, for each metric, ``_sketch``,
    ``_known``, ``_sum`` and ``_squares``. Unknown values (NULL, NaN) are left out."""
    file = F.regexp_replace(tidy_path(path_col), "/[^/]*$", "").alias("file")
    aggregates = []
    for m in metrics:
        kind = _kind(leaves, m)
        value = F.col(m).cast(kind)
        if kind == "double":
            value = F.when(~F.isnan(value), value)
        sketch = getattr(F, f"kll_sketch_agg_{kind}")(value, F.lit(size))
        real = value.cast("double")
        aggregates += [
            sketch.alias(f"{m}_sketch"), F.count(value).alias(f"{m}_known"), F.sum(real).alias(f"{m}_sum"),
            F.sum(real * real).alias(f"{m}_squares"),
        ]
    return leaves.groupBy(*keys, file).agg(F.count(F.lit(1)).alias("n_leaves"), *aggregates)


def rollup_sketches(
    files: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = METRICS, doubles: Sequence[str] = (), size: int = SIZE
) -> DataFrame:
    """The rows of ``file_sketches`` merged for every file and package: per node the same
    columns. ``doubles`` names the metrics that are no integers."""
    # Any name stands for the leaves of a file.
    rows = explode_ancestors(files.withColumn("__file", F.concat("file", F.lit("/-"))), "__file")
    aggregates = []
    for m in metrics:
        kind = "double" if m in doubles else "bigint"
        merged = getattr(F, f"kll_merge_agg_{kind}")(f"{m}_sketch", F.lit(size))
        aggregates += [merged.alias(f"{m}_sketch"), *[F.sum(f"{m}_{p}").alias(f"{m}_{p}") for p in ("known", "sum", "squares")]]
    return rows.groupBy(*keys, "node_path", "depth", "node_type").agg(F.sum("n_leaves").alias("n_leaves"), *aggregates)


def sketch_stats(
    nodes: DataFrame, keys: Sequence[str] = (), metrics: Sequence[str] = METRICS, doubles: Sequence[str] = (), quantile: float = 0.5
) -> DataFrame:
    """``_mean``, ``_median`` (or another ``quantile``) and ``_deviation`` of every
    metric of ``rollup_sketches``.

    Mean and deviation come from exact sums; the median is a value of the node whose
    rank is off by at most the sketch's error. Without known values all are NULL.
    """
    columns = []
    for m in metrics:
        kind = "double" if m in doubles else "bigint"
        known = F.col(f"{m}_known") > 0
        mean = F.col(f"{m}_sum") / F.col(f"{m}_known")
        middle = getattr(F, f"kll_sketch_get_quantile_{kind}")(f"{m}_sketch", F.lit(quantile)).cast("double")
        spread = F.sqrt(F.greatest(F.col(f"{m}_squares") / F.col(f"{m}_known") - mean * mean, F.lit(0.0)))
        columns += [F.when(known, c).alias(f"{m}_{s}") for s, c in (("mean", mean), ("median", middle), ("deviation", spread))]
    return nodes.select(*keys, "node_path", "depth", "node_type", "n_leaves", *columns)
