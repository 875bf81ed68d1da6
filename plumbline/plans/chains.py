"""The composed queries a user calls, from sources to results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import fetch, logs, series as store, tree, view as views
from plumbline.operators.metrics import code_metrics, filter_metric_ranges
from plumbline.operators.unchanged import metrics_of_changed
from plumbline.plans.session import materialize
from plumbline.schema import METRICS, NODES, STORE_START_TS
from plumbline.streaming.logs import read_parsed
from plumbline.sources.files import EXCLUDED_GLOBS, SOURCE_REGEX, read_logs, read_sources, select_sources


@dataclass(frozen=True)
class Ranges:
    """Metric ranges of a statistic, inclusive ``lo,hi`` with open ends."""

    mmcc: str = "1,"
    tmcc: str = "1,"
    sif: str = "1,"
    lif: str = "1,"

    @classmethod
    def from_args(cls, args: Mapping[str, str]) -> Ranges:
        """Ranges from request arguments such as ``{"-mmcc": "10,3000"}``; other
        arguments are for other queries and are passed over."""
        given = {m: args[f"-{m}"] for m in METRICS if f"-{m}" in args}
        return cls(**given)

    def apply(self, leaves: DataFrame) -> DataFrame:
        return filter_metric_ranges(leaves, self.mmcc, self.tmcc, self.sif, self.lif)


@dataclass(frozen=True)
class SeriesSpec:
    """Parameters of the series table."""

    start: int = STORE_START_TS
    step: int = 1
    heartbeat: int = 366 * 86400
    cf: str = "LAST"
    xff: float = 0.1
    steps: int = 1
    rows: int = 10_000


def series_parameters(
    spark: SparkSession, definitions: Sequence[str] = store.DEFAULT_DEFINITIONS, spec: SeriesSpec = SeriesSpec()
) -> DataFrame:
    """The store's definitions as typed rows."""
    texts = spark.createDataFrame([(d,) for d in definitions], "def string")
    return store.parse_series_spec(texts, start=spec.start, step=spec.step)


def watch_list(
    sources: DataFrame, regex: str = SOURCE_REGEX, exclude_globs: Sequence[str] = EXCLUDED_GLOBS
) -> DataFrame:
    """Source rows to analyse; works on listings and on texts alike."""
    return select_sources(sources, regex, exclude_globs)


def measured(
    sources: DataFrame, ranges: Ranges = Ranges(), keep: Sequence[str] = (), results: tuple[str, str] | None = None
) -> DataFrame:
    """Leaves of the selected sources, with their tree path. ``results``, a table of
    earlier results and the name of this run, has only changed texts measured."""
    listed = watch_list(sources)
    leaves = code_metrics(listed, keep) if results is None else metrics_of_changed(listed, *results, keep)
    return tree.with_leaf_path(ranges.apply(leaves))


def statistic(
    sources: DataFrame, ranges: Ranges = Ranges(), keep: Sequence[str] = (), results: tuple[str, str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, node statistics, leaf lists per node).

    Measuring is the one expensive pass over the texts, and three results use
    it, so the leaves are written once and read back.
    """
    leaves = materialize(measured(sources, ranges, keep, results), "leaves")
    return leaves, tree.rollup_stats(leaves, keys=keep), tree.leaf_params(leaves, keys=keep)


def view(sources: DataFrame, ranges: Ranges = Ranges(), attrs: str | Sequence[str] = METRICS) -> DataFrame:
    """Folded stacks of the selected sources."""
    return views.fold_stacks(measured(sources, ranges), attrs)


def flamegraph(
    sources: DataFrame,
    ranges: Ranges = Ranges(),
    attrs: str | Sequence[str] = ("mmcc",),
    width: float = 1200.0,
    height: float = 16.0,
    min_width: float = 0.0,
) -> DataFrame:
    """Frame geometry of the folded view."""
    folded = materialize(view(sources, ranges, attrs), "folded")
    return views.flame_frames(folded, width, height, min_width)


def tree_nodes(leaves: DataFrame, stats: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All nodes with their counters, by snapshot if ``keep`` names its key."""
    return tree.to_counter_row(leaves, stats, keep)


def collect(
    series: DataFrame, nodes: DataFrame, root: str | None = None, method: str = "update"
) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the store, status document) of one snapshot.

    ``update`` appends a row for every node, ``init`` only for new nodes. Nodes
    come from ``tree_nodes`` or from ``flatten_report``; they must lie below one
    package, which ``root`` may name as a check, and whose last snapshot gives
    the time of this one. Nodes of malformed reports are left out and the status
    says so. The nodes are stored once, as rows, root and status read them.
    """
    step = {"update": store.collect_update, "init": store.collect_init}[method]
    extra = [c for c in nodes.columns if c == "error"]
    nodes = materialize(nodes.select(*NODES.names, *extra), "nodes")
    sound = nodes.where("error IS NULL") if extra else nodes
    found = tree.root_package(sound)
    if root not in (None, found):
        raise ValueError(f"the nodes lie below {found!r}, not {root!r}")
    return step(series, sound.select(*NODES.names), found), tree.component_counts(nodes)


read_series = store.read_series


def maintained(series: DataFrame, values: Sequence[str], spec: SeriesSpec = SeriesSpec()) -> DataFrame:
    """Series on the regular grid, consolidated and cut to their retention.

    The grid starts at the oldest retained slot, so nothing is left to cut.
    """
    grid = store.normalize_gauge(
        series,
        values,
        start=spec.start,
        step=spec.step,
        heartbeat=spec.heartbeat,
        rows=spec.rows,
        steps=spec.steps,
    )
    return store.consolidate(grid, values, spec.cf, spec.xff, spec.steps, spec.step)


def selected(
    series: DataFrame,
    path: str = "*",
    name: str = "*",
    type: str = "d",
    prune: bool = True,
    base: str = "store",
) -> DataFrame:
    """Rows of the series a selection admits.

    Globs are matched on the distinct names only, which one scan of two columns
    gives; the store itself is read once.
    """
    # Both scans skip what cannot begin like the glob.
    series = series.where(fetch.in_prefix(F.col("series_id" if type == "f" else "parent_path"), path, base))
    names = materialize(series.select("series_id", "parent_path").distinct(), "names")
    chosen = fetch.select_series(names, path, name, type, prune, base)
    return series.join(fetch.chosen_ids(names, chosen), "series_id", "left_semi").select(*series.columns)


def view_points(
    series: DataFrame,
    counters: Sequence[str],
    start: int = STORE_START_TS,
    end: int | str | None = None,
    cf: str = "AVERAGE",
    steps: int = 1,
    **selection,
) -> DataFrame:
    """The view in long form, one row per time, series and counter: for any number
    of series. The selected rows are stored once, as range and trailing cut read
    them too."""
    chosen = selected(series, **selection)
    # What lies before the range is not stored; its end may depend on the rows.
    after = F.col("snapshot" if "snapshot" in series.columns else "ts") > start // steps * steps
    rows = fetch.fetch_range(materialize(chosen.where(after), "selected"), start, end, cf, steps)
    return fetch.trim_trailing_unknown(fetch.long_form(rows, counters))


def view_table(
    series: DataFrame, counters: Sequence[str], *args, headers: Sequence[str] | None = None, **options
) -> DataFrame:
    """The wide table of the selected series over a time range; takes what
    ``view_points`` takes."""
    return fetch.wide_view(view_points(series, counters, *args, **options), headers)


def plot_table(
    series: DataFrame,
    start: int = STORE_START_TS,
    end: int | str | None = None,
    package_counters: str = fetch.PACKAGE_COUNTERS,
    leaf_counters: str = fetch.LEAF_COUNTERS,
    width: int | None = None,
    cf: str = "AVERAGE",
    steps: int = 1,
    **selection,
) -> DataFrame:
    """Plot data of the selected series over a time range."""
    chosen = selected(series, **selection)
    if end is None or str(end).lower() in fetch.OPEN_ENDS:
        # The end is read off the rows, so these are stored.
        chosen = materialize(chosen, "selected")
    rows = fetch.fetch_range(chosen, start, end, cf, steps)
    return fetch.plot_series(rows, package_counters, leaf_counters, width)


class LogReport(Mapping):
    """Results of a log aggregation, by name; each is planned when it is asked for.

    The results read the parsed lines, so these are stored once, by the first.
    """

    def __init__(self, parsed: DataFrame, gap_ms: int):
        self._lines, self._stored = parsed, None
        self._build = {
            "stats": lambda lines: logs.outcome_stats(lines),
            "totals": lambda lines: logs.outcome_totals(logs.outcome_stats(lines)),
            "failures": lambda lines: logs.failure_log(lines),
            "malformed": lambda lines: logs.quarantine(lines)[1],
            "verdict": lambda lines: logs.run_verdict(logs.outcome_stats(lines)),
            "sessions": lambda lines: logs.activity_sessions(lines, gap_ms),
        }

    def __getitem__(self, name: str) -> DataFrame:
        build = self._build[name]
        if self._stored is None:
            self._stored = materialize(self._lines, "parsed")
        return build(self._stored)

    def __iter__(self):
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)


def log_report(
    lines: DataFrame, year: int, fmt: str = "raw", regex: str = logs.PRODUCER_REGEX, gap_ms: int = 60_000
) -> LogReport:
    """All results of a log aggregation; a session ends after ``gap_ms`` of silence."""
    return LogReport(logs.parse_log(lines, year, fmt, regex), gap_ms)


def statistic_of_tree(spark: SparkSession, root: str, ranges: Ranges = Ranges()):
    """``statistic`` over the files below a folder."""
    return statistic(read_sources(spark, root), ranges)


def log_report_of_folder(spark: SparkSession, folder: str, year: int, fmt: str = "raw", **options) -> LogReport:
    """``log_report`` over the files of a folder."""
    return log_report(read_logs(spark, folder), year, fmt, **options)


def log_report_of_stream(spark: SparkSession, path: str, gap_ms: int = 60_000) -> LogReport:
    """``log_report`` over what a stream (``start_log_report``) has kept so far."""
    return LogReport(read_parsed(spark, path), gap_ms)
