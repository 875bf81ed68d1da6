"""Roll-up of per-function metrics over the enclosing files and packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.naming import canonize_name, canonize_path, prefix, separators, tidy_path
from plumbline.operators.skew import EARLIER, distribution, integer_distribution, join_whole, value_histogram
from plumbline.plans.session import materialize
from plumbline.schema import COUNTERS, METRICS, NODE_TYPES, NODES


def with_leaf_path(leaves: DataFrame, name: str = "leaf_path") -> DataFrame:
    """Leaves with the path of their tree node: safe file path + safe item name."""
    return leaves.withColumn(name, F.concat_ws("/", canonize_path("path"), canonize_name("item")))


def explode_ancestors(df: DataFrame, path_col: str = "leaf_path") -> DataFrame:
    """One row per leaf and inner node above it: ``node_path, depth, node_type``.

    The last component of ``path_col`` is the leaf itself, the one before it is
    the file. A path of one part has no ancestors.
    """
    placed = df.withColumn("__path", tidy_path(path_col))
    placed = placed.withColumn("__levels", separators(F.col("__path"), "/"))
    # Only the depths are exploded; the prefix is cut by generated code.
    levels = F.when(F.col("__levels") > 0, F.sequence(F.lit(1), F.col("__levels")))
    return placed.select("*", F.explode(levels).alias("depth")).select(
        *[F.col(c) for c in df.columns],
        prefix(F.col("__path"), "/", F.col("depth")).alias("node_path"),
        "depth",
        F.when(F.col("depth") == F.col("__levels"), "file").otherwise("package").alias("node_type"),
    )


def rollup_stats(
    leaves: DataFrame,
    path_col: str = "leaf_path",
    keys: Sequence[str] = (),
    metrics: Sequence[str] = METRICS,
    exact_integers: bool = True,
) -> DataFrame:
    """Mean, median and deviation of the metrics of all leaves below each node.

    The root holds every leaf, so nothing is collected per node: the leaves are
    reduced to counts per (file, metric, value), those are repeated for the nodes
    above and summed, and the exact statistics come from the sums. Code metrics
    are integers; for measures that are not, say ``exact_integers=False``.
    """
    keys, metrics = list(keys), list(metrics)
    node = [*keys, "node_path", "depth", "node_type"]
    # Any name stands for the leaves of a file.
    file = F.regexp_replace(tidy_path(path_col), "/[^/]*$", "/-").alias("__file")
    long = leaves.select(*keys, file, *metrics).unpivot([*keys, "__file"], metrics, "metric", "value")
    counts = value_histogram(long, [*keys, "__file", "metric"], "value", "__count")
    rows = explode_ancestors(counts, "__file").select(*node, "metric", "value", "__count")
    if exact_integers:
        stats = integer_distribution(rows, [*node, "metric"], "value", placed_by=node, weight="__count")
    else:
        stats = distribution(rows, [*node, "metric"], "value", weight="__count")

    def pick(metric: str, stat: str):
        return F.max(F.when(F.col("metric") == metric, F.col(stat)))

    return stats.groupBy(*node).agg(
        F.max("n").alias("n_leaves"),
        *[
            pick(m, stat).alias(f"{m}_{stat}")
            for stat in ("mean", "median", "deviation")
            for m in metrics
        ],
    )


def leaf_params(
    leaves: DataFrame,
    path_col: str = "leaf_path",
    keys: Sequence[str] = (),
    metrics: Sequence[str] = METRICS,
    chunk_size: int = 10_000,
) -> DataFrame:
    """Leaf ids and values of each inner node, in arrays of ``chunk_size`` by path.

    A node with more leaves spans several rows (``chunk`` of ``n_chunks``), all full but
    the last, so that the root's list never sits in one row or one task. All leaves are
    kept; ``explode`` of ``params``, by chunk, gives the whole list in order.

    A leaf's place in its node comes from one sort over range partitions. There each
    partition holds whole nodes but for the first and the last one, so only nodes that
    go on from the partition before need a subtotal: fewer rows than partitions.
    """
    keys, metrics = list(keys), list(metrics)
    node = [*keys, "node_path"]
    rows = explode_ancestors(leaves.select(*keys, path_col, *metrics), path_col)
    placed = rows.repartitionByRange(*node, path_col).sortWithinPartitions(*node, path_col)
    # Sampled bounds change, so the sorted rows are stored. Ids count along a partition.
    placed = materialize(placed.withColumn("__id", F.monotonically_increasing_id()), "ordered-leaves")
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("__part"), *node).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*node).orderBy("__part")
    counts = counts.select(
        "__part", *node, "__first", F.coalesce(F.sum("__n").over(along.rowsBetween(*EARLIER)), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*node)).alias("__all"),
    )
    located = join_whole(placed.withColumn("__part", part), counts, ["__part", *node])
    rank = F.col("__before") + F.col("__id") - F.col("__first")
    chunk = F.floor(rank / F.lit(chunk_size)).cast("int")
    total = F.ceil(F.col("__all") / F.lit(chunk_size)).cast("int")
    item = F.struct(rank.alias("__rank"), F.struct(F.col(path_col).alias("item"), *metrics).alias("__item"))
    grouped = located.groupBy(*node, "depth", "node_type", chunk.alias("chunk"), total.alias("n_chunks"))
    listed = grouped.agg(F.array_sort(F.collect_list(item)).alias("params"))
    return listed.withColumn("params", F.transform("params", lambda p: p["__item"]))


def root_package(nodes: DataFrame) -> str:
    """The one package that holds all nodes; an error if there is no such package."""
    tops = nodes.where("depth = 1").select("node_path", "node_type").distinct().limit(2).collect()
    if len(tops) != 1 or tops[0]["node_type"] != "package":
        found = ", ".join(f"{t['node_type']} {t['node_path']}" for t in tops) or "none"
        raise ValueError(f"nodes need exactly one root package, found: {found}")
    return tops[0]["node_path"]


def component_counts(nodes: DataFrame, keys: Sequence[str] = (), error: int = 0) -> DataFrame:
    """Number of package, file and item nodes, also as a JSON status document.

    Nodes with an ``error`` column (from a report) give the status -1 if any of
    them has one set.
    """
    counts = [F.count_if(F.col("node_type") == t).alias(t) for t in NODE_TYPES]
    failed = F.count("error") > 0 if "error" in nodes.columns else F.lit(False)
    counted = nodes.groupBy(*keys).agg(*counts, F.when(failed, -1).otherwise(error).alias("__error"))
    document = F.struct(F.col("__error").alias("error"), F.struct(*NODE_TYPES).alias("statistic"))
    return counted.withColumn("status", F.to_json(document)).drop("__error")


def to_counter_row(leaves: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tree nodes with the twelve counters of a series row.

    Inner nodes store their means under the bare metric name; leaves store their
    four values and leave the other eight unknown (NULL).
    """
    keys = list(keys)
    leaf_nodes = leaves.select(
        *keys,
        F.col("leaf_path").alias("node_path"),
        F.size(F.split("leaf_path", "/")).alias("depth"),
        F.lit("item").alias("node_type"),
        *[F.col(m).cast("double").alias(m) for m in METRICS],
    )
    inner = stats.select(
        *keys,
        "node_path",
        "depth",
        "node_type",
        *[F.col(c if c not in METRICS else f"{c}_mean").cast("double").alias(c) for c in COUNTERS],
    )
    both = inner.unionByName(leaf_nodes, allowMissingColumns=True)
    parent = F.regexp_replace("node_path", "/?[^/]*$", "")
    return both.withColumn("parent_path", parent).select(*keys, *NODES.names)
