"""Folded stacks and the geometry of their frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.naming import prefix, separators, tidy_path
from plumbline.operators.skew import global_prefix_sum
from plumbline.schema import METRICS


def attr_list(attrs: str | Sequence[str]) -> list[str]:
    names = attrs.split(",") if isinstance(attrs, str) else list(attrs)
    names = [n.strip() for n in names if n.strip()]
    unknown = [n for n in names if n not in METRICS]
    if unknown or not names:
        raise ValueError(f"attributes must be among {METRICS}, got {attrs!r}")
    return names


def project_attrs(leaves: DataFrame, attrs: str | Sequence[str] = METRICS) -> DataFrame:
    """One row per leaf and chosen metric: ``attr, value``."""
    chosen = attr_list(attrs)
    ids = [c for c in leaves.columns if c not in METRICS]
    return leaves.unpivot(ids, chosen, "attr", "value")


def fold_stacks(leaves: DataFrame, attrs: str | Sequence[str] = METRICS) -> DataFrame:
    """Stacks ``package;...;file;item;attr`` with their summed values."""
    long = project_attrs(leaves, attrs)
    stack = F.concat_ws(";", F.replace(tidy_path("path"), F.lit("/"), F.lit(";")), F.col("item"), F.col("attr"))
    return long.groupBy(stack.alias("stack"), "attr").agg(F.sum("value").alias("value"))


def flame_frames(
    folded: DataFrame,
    width: float = 1200.0,
    height: float = 16.0,
    min_width: float = 0.0,
    partitions: int | None = None,
) -> DataFrame:
    """Frames of a flamegraph: inclusive and own total, depth and geometry in px.

    In preorder every frame starts where the own values of all earlier frames
    end, so one distributed prefix sum over the sorted frames gives all x
    offsets; no window over siblings and no join to ancestors is needed.
    """
    depths = F.explode(F.sequence(F.lit(1), F.col("__size"))).alias("depth")
    sized = folded.withColumn("__size", separators(F.col("stack"), ";") + 1)
    rows = sized.select("stack", "value", "__size", depths).select(
        prefix(F.col("stack"), ";", F.col("depth")).alias("frame"),
        "depth",
        "value",
        F.when(F.col("depth") == F.col("__size"), F.col("value")).otherwise(F.lit(0)).alias("own"),
    )
    totals = rows.groupBy("frame", "depth").agg(F.sum("value").alias("total"), F.sum("own").alias("self"))
    # Frames sort by their components, so that no frame comes between a parent
    # and its children.
    totals = totals.withColumn("parts", F.split("frame", ";"))
    placed = global_prefix_sum(totals, ["parts"], "self", "start", partitions)
    grand = folded.agg(F.sum("value")).scalar()
    scale = F.lit(float(width)) / grand
    return placed.select(
        "frame",
        F.element_at("parts", -1).alias("name"),
        "depth",
        "total",
        "self",
        (F.col("start") * scale).alias("x"),
        (F.col("total") * scale).alias("width"),
        ((F.col("depth") - 1) * F.lit(float(height))).alias("y"),
    ).where(F.col("width") >= F.lit(float(min_width)))
