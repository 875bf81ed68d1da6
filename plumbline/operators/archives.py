"""Archives of a series store, as its definitions ask for.

An archive keeps one row per series and slot of ``steps`` grid points. A row holds
what can be merged: sum, number, least, greatest and last known value of each data
source. A snapshot therefore touches only the slots it lies in, and a coarser request
is answered exactly from any archive whose slots divide it, by any consolidation.

Archives lie in one folder, by ``steps`` and ``slot``; slots are partitions, so a
range reads its slots of one archive.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.plans.session import materialize
from plumbline.schema import STORE_START_TS

#: Columns that describe a series and stay with its rows.
DESCRIBED = ("parent_path", "depth", "node_type")
#: Parts of a value, and how they are put together.
PARTS = ("total", "known", "least", "greatest", "last", "last_ts")
#: What tells slots of archives apart.
SLOT = ["steps", "slot"]
#: Points that one task of an update puts together, at any number of them.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class DataSource:
    """A value of a series with its limits (None: none); out of them it is unknown."""

    name: str
    heartbeat_s: int | None = None
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class Archive:
    """``rows`` slots of ``steps`` grid points; unknown if more than ``xff`` of them are."""

    cf: str
    xff: float
    steps: int
    rows: int


@dataclass(frozen=True)
class Definitions:
    """The data sources and archives of a store, on a grid of ``step`` seconds."""

    sources: tuple[DataSource, ...]
    archives: tuple[Archive, ...]
    start: int = STORE_START_TS
    step: int = 1

    @classmethod
    def of(cls, parsed: DataFrame) -> Definitions:
        """From the rows of ``parse_series_spec``, one for each definition. Texts that
        are no definition, and values or archives that are defined twice, are refused."""
        rows = parsed.collect()
        sources = [DataSource(r.ds, r.heartbeat_s, r.min, r.max) for r in rows if r.kind == "DS" and r.ds]
        archives = [
            Archive(r.cf.upper(), r.xff, r.steps, r.rows) for r in rows if r.kind == "RRA" and r.steps and r.rows and r.cf
        ]
        if len(sources) + len(archives) != len(rows) or not sources or not archives:
            raise ValueError("every row must define a data source (DS) or an archive (RRA), and both are needed")
        if len({s.name for s in sources}) < len(sources) or len({(a.cf, a.steps) for a in archives}) < len(archives):
            raise ValueError("a data source or an archive is defined twice")
        return cls(tuple(sources), tuple(archives), rows[0].start, rows[0].step)

    @property
    def values(self) -> list[str]:
        return [s.name for s in self.sources]

    def limited(self, source: DataSource) -> Column:
        value = F.col(source.name).cast("double")
        if source.minimum is not None:
            value = F.when(value >= source.minimum, value)
        if source.maximum is not None:
            value = F.when(value <= source.maximum, value)
        return value

    def serving(self, cf: str, steps: int, first: int, newest: int) -> Archive:
        """The coarsest archive whose slots make up slots of ``steps`` points and that
        reaches back to the slot after ``first``; if none does, the one that reaches
        back farthest. Of equal ones, one of the same consolidation."""
        fitting = [a for a in self.archives if steps % a.steps == 0]
        if not fitting:
            raise ValueError(f"no archive has slots that make up {steps} points")

        def oldest(a: Archive) -> int:
            span = a.steps * self.step
            return newest // span * span - (a.rows - 1) * span

        reaching = [a for a in fitting if oldest(a) <= first + a.steps * self.step]
        if reaching:
            return max(reaching, key=lambda a: (a.steps, a.cf == cf.upper()))
        return min(fitting, key=lambda a: (oldest(a), -a.steps, a.cf != cf.upper()))


def _part(name: str) -> Column:
    """The parts of one point."""
    value = F.col(f"`{name}`")
    known = value.isNotNull()
    return F.struct(
        value.alias("total"), known.cast("long").alias("known"), value.alias("least"), value.alias("greatest"),
        value.alias("last"), F.when(known, F.col("ts")).alias("last_ts"),
    ).alias(name)


def _parts(name: str) -> Column:
    """The parts of many points, straight from their values."""
    value = F.col(f"`{name}`")
    known_ts = F.when(value.isNotNull(), F.col("ts"))
    return F.struct(
        F.sum(value).alias("total"), F.count(value).alias("known"), F.min(value).alias("least"), F.max(value).alias("greatest"),
        F.max_by(value, known_ts).alias("last"), F.max(known_ts).alias("last_ts"),
    ).alias(name)


def _merged(name: str) -> Column:
    part = lambda p: F.col(f"`{name}`.{p}")
    return F.struct(
        F.sum(part("total")).alias("total"), F.sum(part("known")).alias("known"), F.min(part("least")).alias("least"),
        F.max(part("greatest")).alias("greatest"), F.max_by(part("last"), part("last_ts")).alias("last"),
        F.max(part("last_ts")).alias("last_ts"),
    ).alias(name)


def _put_together(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[_merged(v) for v in values], F.max("upto").alias("upto"))


def _schema(definitions: Definitions, described: Sequence[T.StructField]) -> T.StructType:
    long, double = T.LongType(), T.DoubleType()
    kinds = {"known": long, "last_ts": long}
    value = T.StructType([T.StructField(p, kinds.get(p, double)) for p in PARTS])
    fields = [T.StructField("series_id", T.StringType()), *described]
    fields += [T.StructField(v, value) for v in definitions.values]
    return T.StructType([*fields, T.StructField("upto", long), T.StructField("steps", T.IntegerType()), T.StructField("slot", long)])


def read_archives(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored rows of all archives; None before the first update."""
    try:
        stored = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return stored.withColumns({"steps": F.col("steps").cast("int"), "slot": F.col("slot").cast("long")})


def update_archives(points: DataFrame, path: str, definitions: Definitions, rerun: bool = False) -> None:
    """Add the points of one or more snapshots to all archives in ``path``.

    ``points`` has ``series_id``, ``ts`` and the data sources; columns that describe a
    series are kept. Only the slots of these points are read, and only those with a new
    point are written again. A point that is not newer than what its slot holds of the
    series is refused, so nothing counts twice; with ``rerun`` such points are left out,
    which finishes an update that was interrupted. Points at or before the start are
    left out.
    """
    spark = points.sparkSession
    described = [f for f in points.schema.fields if f.name in DESCRIBED]
    names = [f.name for f in described]
    keys, values = ["steps", "slot", "series_id", *names], definitions.values
    widths = sorted({a.steps for a in definitions.archives})
    span = F.col("steps") * F.lit(definitions.step)
    slot = (F.ceil(F.col("ts") / span) * span).cast("long")
    dealt = points.where(F.col("ts") > definitions.start).select(
        "series_id", *names, F.col("ts").cast("long").alias("ts"),
        *[definitions.limited(s).alias(s.name) for s in definitions.sources], F.explode(F.array(*map(F.lit, widths))).alias("steps"),
    )
    dealt = dealt.withColumn("slot", slot)
    # One row for each slot, of the points' times alone.
    sizes = materialize(dealt.groupBy("steps", "slot").agg(F.count(F.lit(1)).alias("n")), "slots")
    stored, late = read_archives(spark, path), None
    if stored is not None:
        # Slots that hold rows already, by partition columns; only their points are compared.
        opened = materialize(sizes.join(stored.select("steps", "slot").distinct(), SLOT, "left_semi"), "open-slots")
        held = stored.join(opened, SLOT, "left_semi").groupBy(*SLOT, "series_id").agg(F.max("upto").alias("upto"))
        late = dealt.join(opened, SLOT, "left_semi").join(held, [*SLOT, "series_id"], "left")
        judged = late.groupBy(*SLOT).agg(
            F.count_if(_fresh()).alias("fresh"), F.min(F.when(~_fresh(), F.struct("ts", "series_id"))).alias("stale")
        )
        judged = materialize(judged, "judged")
        if not rerun:
            found = judged.where("stale IS NOT NULL").select("stale.*").first()
            if found:
                raise ValueError(f"{found.series_id} has a point at {found.ts} or later already; say rerun=True to leave it out")
        # A slot without a new point stays as it is.
        judged = judged.where("fresh > 0").select(*SLOT, "fresh")
        sizes = sizes.join(opened, SLOT, "left_anti")
        dealt = dealt.join(opened, SLOT, "left_anti")
    rows = _by_slot(dealt, sizes.agg(F.sum("n")).first()[0]).groupBy(*keys).agg(
        *[_parts(v) for v in values], F.max("ts").alias("upto")
    )
    if late is not None:
        # Written again below, over partitions that it reads.
        stored = materialize(stored.join(judged, SLOT, "left_semi"), "open-rows")
        n = (judged.agg(F.sum("fresh")).first()[0] or 0) + stored.count()
        if n:
            late = late.where(_fresh()).select(*keys, *[_part(v) for v in values], F.col("ts").alias("upto"))
            both = late.unionByName(stored.select(*late.columns))
            rows = rows.unionByName(_put_together(_by_slot(both, n), keys, values))
    rows = rows.select(*_schema(definitions, described).names).sortWithinPartitions("steps", "slot", "series_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("steps", "slot").parquet(path)


def _by_slot(rows: DataFrame, n: int | None) -> DataFrame:
    """``n`` rows by slot and series, in ranges of about ``TASK_ROWS``: the rows of a
    series in a slot stay together, so that they need no other shuffle, a task has a
    bounded number of groups, and a slot comes in few files."""
    return rows.repartitionByRange(max(1, -(-(n or 0) // TASK_ROWS)), *SLOT, "series_id")


def _fresh() -> Column:
    return F.col("upto").isNull() | (F.col("ts") > F.col("upto"))


def archived_range(
    spark: SparkSession,
    path: str,
    definitions: Definitions,
    start: int = STORE_START_TS,
    end: int | None = None,
    cf: str = "AVERAGE",
    steps: int | None = None,
    xff: float | None = None,
) -> DataFrame:
    """Slots of ``steps`` points that lie in ``start < ts <= end``, widened to whole slots.

    They are put together from the one archive that ``serving`` names; without
    ``steps`` its finest is asked, without ``xff`` the archive's own share counts. The
    archive serves its newest ``rows`` slots; older ones are left out.
    """
    stored = read_archives(spark, path)
    if stored is None:
        raise ValueError(f"there are no archives in {path}")
    steps = steps or min(a.steps for a in definitions.archives)
    span = steps * definitions.step
    finest = min(a.steps for a in definitions.archives)
    # Partition columns only.
    newest = stored.where(F.col("steps") == finest).agg(F.max("slot")).first()[0]
    first, last = start // span * span, -(-(newest if end is None else end) // span) * span
    archive = definitions.serving(cf, steps, first, newest)
    width = archive.steps * definitions.step
    oldest = -(-newest // width) * width - (archive.rows - 1) * width
    inside = (F.col("slot") > first) & (F.col("slot") <= last) & (F.col("slot") >= oldest)
    rows = stored.where((F.col("steps") == archive.steps) & inside)
    described = [c for c in DESCRIBED if c in stored.columns]
    rows = rows.withColumn("ts", (F.ceil(F.col("slot") / F.lit(span)) * F.lit(span)).cast("long"))
    whole = _put_together(rows, ["series_id", *described, "ts"], definitions.values)
    share = archive.xff if xff is None else xff

    def merged(name: str) -> Column:
        value = F.col(name)
        picked = {
            "AVERAGE": value["total"] / value["known"], "MIN": value["least"], "MAX": value["greatest"], "LAST": value["last"],
        }[cf.upper()]
        return F.when((value["known"] > 0) & (F.lit(steps) - value["known"] <= F.lit(share * steps)), picked).alias(name)

    return whole.select("series_id", *described, "ts", *[merged(v) for v in definitions.values])
