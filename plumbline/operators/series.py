"""The time-series table: one row per tree node and snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators.skew import key_maximum, previous_row, running_max
from plumbline.schema import COUNTERS, EMPTY_STORE_TS, SERIES, STORE_START_TS

# Units of the order column (time steps, arrival numbers) per segment of a key.
SEGMENT_WIDTH = 100_000

# Seconds per duration suffix of a series definition.
SUFFIX_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2678400, "y": 31622400}

# Fixed values, the default store: one gauge per counter and one archive of snapshots.
DEFAULT_DEFINITIONS = [f"DS:{counter}:GAUGE:1y:U:U" for counter in COUNTERS] + ["RRA:LAST:0.1:1:10000"]


def duration_seconds(text: Column, year_days: int = 366) -> Column:
    """Seconds of ``90``, ``5m``, ``1y``; NULL when the text is no duration."""
    units = {**SUFFIX_SECONDS, "y": year_days * 86400}
    number = F.regexp_extract(text, r"^(\d+)[smhdwMy]?$", 1).try_cast("long")
    suffix = F.regexp_extract(text, r"^\d+([smhdwMy])$", 1)
    factor = F.lit(1)
    for unit, seconds in units.items():
        factor = F.when(suffix == unit, F.lit(seconds)).otherwise(factor)
    return number * factor


def parse_series_spec(
    df: DataFrame,
    definition: str = "def",
    start: int = STORE_START_TS,
    step: int = 1,
    year_days: int = 366,
) -> DataFrame:
    """``DS:name:type:heartbeat:min:max`` and ``RRA:cf:xff:steps:rows`` texts as
    typed columns; ``U`` is an unbounded limit (NULL)."""
    parts = F.split(F.col(definition), ":")

    def field(kind: str, i: int) -> Column:
        return F.when(F.get(parts, 0) == kind, F.get(parts, i))

    return df.select(
        "*",
        F.get(parts, 0).alias("kind"),
        field("DS", 1).alias("ds"),
        field("DS", 2).alias("ds_type"),
        duration_seconds(field("DS", 3), year_days).alias("heartbeat_s"),
        field("DS", 4).try_cast("double").alias("min"),
        field("DS", 5).try_cast("double").alias("max"),
        field("RRA", 1).alias("cf"),
        field("RRA", 2).try_cast("double").alias("xff"),
        field("RRA", 3).try_cast("int").alias("steps"),
        field("RRA", 4).try_cast("int").alias("rows"),
        F.lit(start).cast("long").alias("start"),
        F.lit(step).cast("long").alias("step"),
    )


def next_timestamp(series: DataFrame, root: str, default: int = EMPTY_STORE_TS) -> DataFrame:
    """One row with the snapshot counter after the last one of the root package."""
    is_root = (F.col("series_id") == root) & (F.col("node_type") == "package")
    last = F.coalesce(F.max("ts"), F.lit(default).cast("long"))
    return series.where(is_root).agg((last + 1).alias("next_ts"))


def collect_update(
    series: DataFrame, nodes: DataFrame, root: str, default: int = EMPTY_STORE_TS
) -> DataFrame:
    """Rows to append: every node of the snapshot at the next timestamp.

    A node without a series starts one simply by appearing. The timestamp is a
    scalar subquery, so nothing is joined.
    """
    stamp = next_timestamp(series, root, default).scalar()
    return nodes.select(
        F.col("node_path").alias("series_id"),
        "parent_path",
        F.col("depth").cast("int").alias("depth"),
        "node_type",
        stamp.cast("long").alias("ts"),
        *[F.col(c).cast("double").alias(c) for c in COUNTERS],
    )


def collect_init(
    series: DataFrame, nodes: DataFrame, root: str, default: int = EMPTY_STORE_TS
) -> DataFrame:
    """Rows to append for the nodes that have no series yet."""
    rows = collect_update(series, nodes, root, default)
    known = series.select("series_id").distinct()
    return rows.join(known, "series_id", "left_anti").select(*SERIES.names)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The stored series; a filter on ``snapshot`` prunes partitions. A store that
    nothing was appended to yet is empty."""
    try:
        return spark.read.schema(SERIES).option("basePath", path).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        none = spark.createDataFrame([], SERIES)
        return none.withColumn("snapshot", F.col("ts").cast("int"))


def append_series(rows: DataFrame, path: str, rerun: bool = False) -> None:
    """Write snapshots, each into its own partition.

    A snapshot that the store holds already is refused, so a collection that
    took a wrong timestamp never overwrites history; ``rerun`` replaces the
    partition on purpose, and leaves the same table when nothing changed. The
    rows are sorted by series to keep file statistics sharp.
    """
    if not rerun:
        stored = read_series(rows.sparkSession, path)
        taken = stored.join(rows.select(F.col("ts").alias("snapshot")).distinct(), "snapshot", "left_semi")
        found = taken.select("snapshot").first()
        if found:
            raise ValueError(f"snapshot {found[0]} is stored already; say rerun=True to replace it")
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in SERIES.fields])
    (
        typed.withColumn("snapshot", F.col("ts"))
        .repartitionByRange("snapshot", "series_id")
        .sortWithinPartitions("snapshot", "series_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot")
        .parquet(path)
    )


def reject_stale(
    updates: DataFrame,
    key: str = "series_id",
    ts: str = "ts",
    arrival: str = "arrival",
    last: DataFrame | None = None,
    width: int = SEGMENT_WIDTH,
) -> DataFrame:
    """Marks updates that are not newer than their series' last one.

    Adds ``last_ts`` and ``accepted``. ``last`` (``key, last_ts``) holds what
    earlier batches left behind; it enters as one row before all arrivals.
    """
    rows = updates.withColumn("__given", F.lit(True))
    if last is not None:
        before = last.select(key, F.col("last_ts").alias(ts)).withColumn(
            arrival, F.lit(-1).cast(updates.schema[arrival].dataType)
        )
        rows = rows.unionByName(before.withColumn("__given", F.lit(False)), allowMissingColumns=True)
    seen = running_max(rows, [key], arrival, ts, width, "last_ts")
    fresh = F.col("last_ts").isNull() | (F.col(ts) > F.col("last_ts"))
    return seen.where("__given").drop("__given").withColumn("accepted", fresh)


def normalize_gauge(
    samples: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    start: int = STORE_START_TS,
    step: int = 1,
    heartbeat: int = 366 * 86400,
    minimum: float | None = None,
    maximum: float | None = None,
    rows: int = 10_000,
    steps: int = 1,
    width: int | None = None,
) -> DataFrame:
    """Gauge samples on a regular grid of ``step`` seconds.

    The value read at ``ts`` holds for every grid point after the previous
    sample up to ``ts``. An interval longer than the heartbeat, or a value out
    of the limits, is unknown (NULL). Timestamps off the grid are floored; of
    the samples of one step the last one counts, and of samples of one time the
    one with the greatest values.
    Points that retention (``rows`` slots of ``steps`` points) would drop are
    never produced, which bounds the fan-out of one sample.
    """
    keys, values = list(keys), list(values)
    grid = samples.select(*keys, _floor(F.col(ts), step).alias("__at"), F.struct(ts, *values).alias("__sample"))
    grid = grid.where(F.col("__at") > start).groupBy(*keys, "__at").agg(F.max("__sample").alias("__sample"))
    grid = grid.select(*keys, F.col("__at").alias(ts), *[F.col(f"__sample.{v}").alias(v) for v in values])
    width = width or SEGMENT_WIDTH * step
    prev = previous_row(grid, keys, ts, [ts], width, prefix="__prev_", last_order="__max")
    prev = prev.withColumn("__prev", F.coalesce(f"__prev_{ts}", F.lit(_floor_int(start, step))))
    span = steps * step
    newest = (F.ceil(F.col("__max") / F.lit(span)) * F.lit(span)).cast("long")
    low = F.greatest(F.col("__prev"), newest - F.lit(rows * span))
    prev = prev.withColumn("__low", low).where(F.col("__low") < F.col(ts))
    slots = F.sequence(F.col("__low") + step, F.col(ts), F.lit(step).cast("long"))
    lost = (F.col(ts) - F.col("__prev")) > F.lit(heartbeat)

    def known(name: str) -> Column:
        bad = lost
        if minimum is not None:
            bad = bad | (F.col(name) < minimum)
        if maximum is not None:
            bad = bad | (F.col(name) > maximum)
        return F.when(~bad, F.col(name)).alias(name)

    kept = prev.select(*keys, *[known(v) for v in values], slots.alias("__slots"))
    return kept.select(*keys, F.explode("__slots").alias(ts), *values)


def _floor(c: Column, step: int) -> Column:
    return (F.floor(c / F.lit(step)) * F.lit(step)).cast("long") if step != 1 else c.cast("long")


def _floor_int(value: int, step: int) -> int:
    return value // step * step


def consolidate(
    points: DataFrame,
    values: Sequence[str],
    cf: str = "LAST",
    xff: float = 0.1,
    steps: int = 1,
    step: int = 1,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
) -> DataFrame:
    """``steps`` grid points merged into one; unknown when more than ``xff`` of
    them are unknown. A missing point counts as unknown. LAST is the newest
    known value."""
    span = step * steps
    slot = (F.ceil(F.col(ts) / F.lit(span)) * F.lit(span)).cast("long")
    merge = {
        "AVERAGE": lambda c: F.avg(c),
        "MIN": lambda c: F.min(c),
        "MAX": lambda c: F.max(c),
        "LAST": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))),
    }[cf.upper()]

    def merged(name: str) -> Column:
        unknown = F.lit(steps) - F.count(name)
        return F.when(unknown <= F.lit(xff * steps), merge(name)).alias(name)

    slotted = points.withColumn("__slot", slot)
    grouped = slotted.groupBy(*keys, "__slot").agg(*[merged(v) for v in values])
    return grouped.withColumnRenamed("__slot", ts)


def retain_last(
    points: DataFrame,
    rows: int = 10_000,
    steps: int = 1,
    step: int = 1,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    width: int | None = None,
) -> DataFrame:
    """The newest ``rows`` slots of each series (slots, not rows present)."""
    span = rows * steps * step
    top = key_maximum(points, list(keys), ts, width or SEGMENT_WIDTH * step, "__top")
    return top.where(F.col(ts) > F.col("__top") - F.lit(span)).drop("__top")


def trend(
    points: DataFrame,
    value: str = "value",
    keys: Sequence[str] = ("series_id", "counter"),
    ts: str = "ts",
    width: int = SEGMENT_WIDTH,
) -> DataFrame:
    """Change of a metric since the series' previous snapshot, and its sign."""
    moved = previous_row(points, list(keys), ts, [value], width, prefix="prev_")
    delta = F.col(value) - F.col(f"prev_{value}")
    return moved.withColumn("delta", delta).withColumn("direction", F.signum("delta").cast("int"))


def counter_trend(
    rows: DataFrame,
    counters: Sequence[str] = COUNTERS,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    width: int = SEGMENT_WIDTH,
) -> DataFrame:
    """``trend`` of every counter of the stored rows, in long form.

    The row before is found for all counters at once and taken apart afterwards, so a
    row is shuffled once and not once for each counter.
    """
    keys, counters = list(keys), list(counters)
    moved = previous_row(rows.select(*keys, ts, *counters), keys, ts, counters, width, prefix="__prev_")
    each = F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("value"), F.col(f"__prev_{c}").alias("prev_value")) for c in counters])
    long = moved.select(*keys, ts, F.inline(each)).withColumn("delta", F.col("value") - F.col("prev_value"))
    return long.withColumn("direction", F.signum("delta").cast("int"))


def trend_summary(moves: DataFrame, keys: Sequence[str] = ("series_id", "counter")) -> DataFrame:
    """Snapshots that raised and lowered a metric, and the balance of both."""
    return moves.groupBy(*keys).agg(
        F.count_if(F.col("direction") > 0).alias("ups"),
        F.count_if(F.col("direction") < 0).alias("downs"),
        F.coalesce(F.sum("direction"), F.lit(0)).cast("long").alias("balance"),
        F.sum("delta").alias("change"),
    )
