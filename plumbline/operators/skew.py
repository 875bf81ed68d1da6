"""Ordered computations that hold when one key owns a large share of the rows.

A plain window over ``partitionBy(key)`` puts a whole key into one task. The
functions here cut a key into segments of bounded size, work inside the
segments, and pass a one-row summary per segment along. Both passes read the
input: give them a stored table, or ``materialize`` an expensive one first.
Join and window share their keys, so the rows are shuffled once; the left join
keeps rows without a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.session import materialize

SEGMENT = "__segment"
EARLIER = (Window.unboundedPreceding, -1)


def in_segments(df: DataFrame, order: str, width: int) -> DataFrame:
    """Rows with the number of their segment of ``width`` units of ``order``."""
    return df.withColumn(SEGMENT, F.floor(F.col(order) / F.lit(width)).cast("long"))


def join_whole(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL matches NULL, so that no row gets lost."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    matches = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, matches, how).drop(*[f"__r_{k}" for k in keys])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    width: int,
    prefix: str = "prev_",
    last_order: str | None = None,
) -> DataFrame:
    """``lag`` of ``values`` along ``order`` (an integral column) within ``keys``.

    ``last_order`` names an extra column with the key's greatest ``order``. The
    summary reads only the columns it needs and is combined before its shuffle;
    the rows themselves are shuffled once, by key and segment.
    """
    placed = in_segments(df, order, width)
    summary = placed.groupBy(*keys, SEGMENT).agg(
        F.max(order).alias("__hi"),
        *[(F.max(v) if v == order else F.max_by(v, order)).alias(f"__last_{v}") for v in values],
    )
    along = Window.partitionBy(*keys).orderBy(SEGMENT)
    carried = [F.lag(f"__last_{v}").over(along).alias(f"__carry_{v}") for v in values]
    carried.append(F.lag("__hi").over(along).isNotNull().alias("__carried"))
    if last_order:
        carried.append(F.max("__hi").over(Window.partitionBy(*keys)).alias(last_order))
    joined = placed.join(summary.select(*keys, SEGMENT, *carried), [*keys, SEGMENT], "left")
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(order)
    opens = F.row_number().over(inside) == 1
    extra = [last_order] if last_order else []
    return joined.select(
        *df.columns,
        *extra,
        *[
            F.when(opens, F.col(f"__carry_{v}")).otherwise(F.lag(v).over(inside)).alias(f"{prefix}{v}")
            for v in values
        ],
    )


def running_max(
    df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, name: str
) -> DataFrame:
    """Greatest ``value`` of all rows before the current one; NULL for the first."""
    placed = in_segments(df, order, width)
    summary = placed.groupBy(*keys, SEGMENT).agg(F.max(value).alias("__max"))
    along = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(*EARLIER)
    carry = summary.select(*keys, SEGMENT, F.max("__max").over(along).alias("__carry"))
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(order).rowsBetween(*EARLIER)
    # greatest() skips NULLs, so it also covers the first row and first segment.
    best = F.greatest(F.max(value).over(inside), F.col("__carry"))
    joined = placed.join(carry, [*keys, SEGMENT], "left")
    return joined.withColumn(name, best).select(*df.columns, name)


def key_maximum(
    df: DataFrame, keys: Sequence[str], order: str, width: int, name: str
) -> DataFrame:
    """Each row with its key's greatest ``order``, joined back per segment so
    that no join key is hot."""
    placed = in_segments(df, order, width)
    summary = placed.groupBy(*keys, SEGMENT).agg(F.max(order).alias("__hi"))
    top = summary.select(
        *keys, SEGMENT, F.max("__hi").over(Window.partitionBy(*keys)).alias(name)
    )
    return placed.join(top, [*keys, SEGMENT], "left").select(*df.columns, name)


def run_starts(
    df: DataFrame, keys: Sequence[str], order: str, low: str, high: str, gap: int, width: int, name: str
) -> DataFrame:
    """The ``order`` at which each row's run began.

    Rows are disjoint spans ``low..high``, sorted by ``order``; a span that
    begins more than ``gap`` after the end of the one before opens a run.
    """
    placed = in_segments(df, order, width)
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(order)
    # Unknown (NULL) for the first row of a segment, which the summary decides.
    opens = F.col(low) - F.lag(high).over(inside) > gap
    local = placed.withColumn("__local", F.when(opens, F.col(order)))
    summary = local.groupBy(*keys, SEGMENT).agg(
        F.min(low).alias("__low"),
        F.max(high).alias("__high"),
        F.min(order).alias("__head"),
        F.max("__local").alias("__tail"),
    )
    along = Window.partitionBy(*keys).orderBy(SEGMENT)
    before = F.lag("__high").over(along)
    fresh = F.when(before.isNull() | (F.col("__low") - before > gap), F.col("__head"))
    heads = summary.withColumn("__fresh", fresh)
    last = F.max(F.coalesce("__tail", "__fresh")).over(along.rowsBetween(*EARLIER))
    heads = heads.select(*keys, SEGMENT, F.coalesce("__fresh", last).alias("__start"))
    so_far = F.max("__local").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = local.join(heads, [*keys, SEGMENT], "left")
    return joined.withColumn(name, F.coalesce(so_far, F.col("__start"))).select(*df.columns, name)


def global_prefix_sum(
    df: DataFrame, order: Sequence[str], value: str, name: str, partitions: int | None = None
) -> DataFrame:
    """Sum of ``value`` over all rows that sort before the current one.

    A distributed sort: range partitions, one subtotal per partition, then a
    running sum inside each. Range bounds are sampled, so the placed rows are
    written once and both passes read that table.
    """
    target = [partitions] if partitions else []
    placed = df.repartitionByRange(*target, *order).withColumn("__part", F.spark_partition_id())
    placed = materialize(placed, "ordered")
    # One row per range partition: bounded by the partition count, not the data.
    subtotals = placed.groupBy("__part").agg(F.sum(value).alias("__sum"))
    along = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(*EARLIER)
    offsets = subtotals.select("__part", F.sum("__sum").over(along).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(*EARLIER)
    zero = F.lit(0)
    total = F.coalesce(F.sum(value).over(inside), zero) + F.coalesce(F.col("__offset"), zero)
    # A broadcast of one row per partition stays far below any threshold.
    joined = placed.join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, total).select(*df.columns, name)


def value_histogram(
    df: DataFrame, keys: Sequence[str], value: str, count: str, weight: str | None = None
) -> DataFrame:
    """Distinct known values per key with their counts: the only pass over the
    rows. Partial aggregation happens before the shuffle and a hot key is spread
    over its values. NULL and NaN are unknown. ``weight`` counts a row so often."""
    known = F.col(value).isNotNull()
    if df.schema[value].dataType.typeName() in ("double", "float"):
        known = known & ~F.isnan(value)
    return df.where(known).groupBy(*keys, value).agg(F.sum(weight if weight else F.lit(1)).alias(count))


def integer_distribution(
    df: DataFrame, keys: Sequence[str], value: str, placed_by: Sequence[str] | None = None, weight: str | None = None
) -> DataFrame:
    """Exact count, mean, median and population deviation of integers per key.

    Rows are reduced to one per distinct value before and in the first shuffle,
    so a key's window holds at most as many rows as the value has distinct
    integers, however many rows the key has. ``placed_by`` (a part of ``keys``)
    chooses the partitioning, so that a later grouping by it needs no shuffle.
    """
    keys = list(keys)
    hist = value_histogram(df, keys, value, "__n", weight).repartition(*(placed_by or keys))
    whole = Window.partitionBy(*keys)
    n, v = F.col("__n"), F.col(value)
    total, mean = F.col("__total"), F.col("__mean")
    ranked = (
        hist.withColumn("__before", F.coalesce(F.sum(n).over(whole.orderBy(value).rowsBetween(*EARLIER)), F.lit(0)))
        .withColumn("__total", F.sum(n).over(whole))
        .withColumn("__mean", F.sum(n * v).over(whole) / total)
    )
    middle = F.when(_holds_middle(F.col("__before"), n, total), v)
    return ranked.groupBy(*keys).agg(
        F.max(total).alias("n"),
        F.max(mean).alias("mean"),
        F.sqrt(F.sum(n * (v - mean) * (v - mean)) / F.max(total)).alias("deviation"),
        ((F.min(middle) + F.max(middle)) / 2).alias("median"),
    )


def distribution(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Exact count, mean, median and population deviation of doubles per key.

    The distinct values are sorted over range partitions, so a key with many of
    them spans many partitions whatever their spacing. A partition and key give
    one row of subtotals, and these rows tell where the middle ranks are and are
    merged into mean and deviation without cancellation. Sampled range bounds
    change when they are recomputed, so the sorted values are written once.
    """
    keys = list(keys)
    hist = value_histogram(df, keys, value, "__n", weight).withColumn("__v", F.col(value).cast("double"))
    placed = hist.select(*keys, "__n", "__v").repartitionByRange(*keys, "__v")
    placed = materialize(placed.withColumn("__part", F.spark_partition_id()), "values")
    inside = Window.partitionBy("__part", *keys)
    n, v, centre = F.col("__n"), F.col("__v"), F.sum(F.col("__n") * F.col("__v")).over(inside) / F.sum("__n").over(inside)
    ahead = F.coalesce(F.sum("__n").over(inside.orderBy("__v").rowsBetween(*EARLIER)), F.lit(0))
    ranked = placed.withColumn("__centre", centre).withColumn("__ahead", ahead)
    parts = ranked.groupBy("__part", *keys).agg(
        F.sum("__n").alias("__pn"),
        F.max("__centre").alias("__pc"),
        F.sum(n * (v - F.col("__centre")) * (v - F.col("__centre"))).alias("__ps"),
    )
    # One row for each partition that a key reaches into.
    whole = Window.partitionBy(*keys)
    size, mean = F.sum("__pn").over(whole), F.sum(F.col("__pn") * F.col("__pc")).over(whole) / F.sum("__pn").over(whole)
    before = F.coalesce(F.sum("__pn").over(whole.orderBy("__part").rowsBetween(*EARLIER)), F.lit(0))
    parts = parts.withColumns({"__total": size, "__mean": mean, "__before": before})
    off = F.col("__pc") - F.col("__mean")
    parts = parts.withColumn("__square", F.sum(F.col("__ps") + F.col("__pn") * off * off).over(whole))
    held = parts.where(_holds_middle(F.col("__before"), F.col("__pn"), F.col("__total")))
    middle = join_whole(ranked, held, ["__part", *keys])
    middle = middle.where(_holds_middle(F.col("__before") + F.col("__ahead"), n, F.col("__total")))
    return middle.groupBy(*keys).agg(
        F.max("__total").alias("n"),
        F.max("__mean").alias("mean"),
        F.sqrt(F.max(F.col("__square") / F.col("__total"))).alias("deviation"),
        ((F.min("__v") + F.max("__v")) / 2).alias("median"),
    )


def _holds_middle(before: Column, n: Column, total: Column) -> Column:
    """Whether ranks ``before+1 .. before+n`` include a middle rank of ``total``."""
    low, high = F.floor((total + 1) / 2), F.floor((total + 2) / 2)
    return (before < high) & (before + n >= low)
