"""Queries over the time-series table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import archives, fetch, series, tree, unchanged
from plumbline.plans import chains
from plumbline.plans.session import materialize, new_folder
from plumbline.schema import COUNTERS, METRICS, SERIES
from plumbline.sources import sinks
from plumbline.workload.inputs import (
    HOUR,
    LEAVES_SQL,
    PARTS_SQL,
    SAMPLES_SQL,
    SERIES_START,
    STORED_SQL,
    customer_leaves,
    part_sources,
    plain,
    samples,
    stats_sql,
    stored_series,
    table,
)
from plumbline.workload.trees import COUNTER_SQL, SQL as TREE_SQL, q_to_counter_row

KEYS = ["series_id"]
DAY = 24 * HOUR
HEARTBEAT = 3 * DAY
SLOTS = 400
FIRST_TS = 1701154262


def q_parse_series_spec(spark, d):
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("m"))
    size = F.col("p_size").cast("string")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "s", "m", "h", "d", "w", "M", "y")]), F.col("p_size") % 8 + 1)
    ds = F.concat_ws(
        ":", F.lit("DS"), brand, F.lit("GAUGE"), F.concat(size, unit), F.lit("U"),
        F.when(F.col("p_size") > 25, size).otherwise("U"),
    )
    rra = F.concat_ws(":", F.lit("RRA"), F.lit("LAST"), F.lit("0.1"), size, (F.col("p_partkey") * 10).cast("string"))
    text = F.when(F.col("p_type") == "SMALL", rra).otherwise(ds)
    return plain(series.parse_series_spec(table(spark, d, "part").select("p_partkey", text.alias("def"))))


def _store(spark, d) -> DataFrame:
    """Two earlier snapshots: customers in credit, then the household segment too."""
    leaves = tree.with_leaf_path(customer_leaves(spark, d)).where("c_acctbal >= 0")
    nodes = materialize(tree.to_counter_row(leaves, tree.rollup_stats(leaves)), "nodes")
    first = nodes.withColumn("ts", F.lit(FIRST_TS).cast("long"))
    second = nodes.where("node_type <> 'item'").withColumn("ts", F.lit(FIRST_TS + 1).cast("long"))
    return first.unionByName(second).withColumnRenamed("node_path", "series_id").select(*SERIES.names)


def _nodes(spark, d) -> DataFrame:
    leaves = tree.with_leaf_path(customer_leaves(spark, d))
    return tree.to_counter_row(leaves, tree.rollup_stats(leaves))


def q_next_timestamp(spark, d):
    return series.next_timestamp(_store(spark, d), "world")


def q_next_timestamp_events(spark, d):
    return series.next_timestamp(stored_series(spark, d), "events")


def q_next_timestamp_empty(spark, d):
    return series.next_timestamp(stored_series(spark, d), "unknown root")


def q_collect_update(spark, d):
    return plain(series.collect_update(_store(spark, d), _nodes(spark, d), "world"))


def q_collect_init(spark, d):
    return plain(series.collect_init(_store(spark, d), _nodes(spark, d), "world"))


def q_collect_status(spark, d):
    """The status document of a composed collection."""
    return plain(chains.collect(_store(spark, d), _nodes(spark, d), "world")[1])


def q_append_series(spark, d):
    """Two snapshots through the partitioned store, one of them written twice."""
    folder = new_folder(spark, "store")
    nodes = q_to_counter_row(spark, d).withColumnRenamed("node_path", "series_id")
    first = nodes.withColumn("ts", F.lit(FIRST_TS).cast("long")).select(*SERIES.names)
    second = first.where("node_type <> 'item'").withColumn("ts", F.col("ts") + 1)
    for rows in (first, second):
        series.append_series(rows, folder)
    series.append_series(second, folder, rerun=True)
    stored = chains.read_series(spark, folder)
    return plain(fetch.fetch_range(stored, FIRST_TS - 1, FIRST_TS + 1).select(*SERIES.names))


def q_collect_series(spark, d):
    """Three snapshots of a growing project, collected into a store that does not
    exist at first."""
    folder = new_folder(spark, "store")
    for number in range(3):
        parts = part_sources(spark, d).where(F.length("path") % 3 <= number)
        project = parts.withColumn("path", F.concat(F.lit("project/"), "path"))
        leaves, stats, _ = chains.statistic(project)
        rows, _ = chains.collect(chains.read_series(spark, folder), chains.tree_nodes(leaves, stats))
        series.append_series(rows, folder)
    return plain(chains.read_series(spark, folder).select(*SERIES.names))


def q_collect_changed(spark, d):
    """Three collections of one project: all files new, every fifth changed, all moved.
    With how many texts each of them measured."""
    results, out = new_folder(spark, "results"), None
    sources = part_sources(spark, d)
    fifth = F.regexp_extract("path", r"_(\d+)\.", 1).cast("long") % 5 == 0
    changed = sources.withColumn("content", F.when(fifth, F.concat(F.lit("\n"), "content")).otherwise(F.col("content")))
    moved = changed.withColumn("path", F.concat(F.lit("moved/"), "path"))
    for number, project in enumerate((sources, changed, moved)):
        leaves, _, _ = chains.statistic(project, results=(results, f"c{number}"))
        fresh = spark.read.schema(unchanged.RESULTS).parquet(f"{results}/rules={unchanged.RULES}/run=c{number}").count()
        rows = leaves.select(
            F.lit(number).alias("number"), "path", "item", "line", *METRICS, F.lit(fresh).alias("n_measured")
        )
        out = rows if out is None else out.unionByName(rows)
    return plain(out)


def q_reject_stale(spark, d):
    e = table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id"),
        (F.floor(F.unix_micros("ts") / 1_000_000) + (F.col("event_id") * 37) % 11 * 7200).cast("long").alias("ts"),
        F.col("event_id").alias("arrival"),
    )
    return plain(series.reject_stale(e, width=1000))


def q_normalize_gauge(spark, d):
    return plain(_grid(samples(spark, d)))


def _grid(rows: DataFrame) -> DataFrame:
    return series.normalize_gauge(
        rows, ["value"], start=SERIES_START, step=HOUR, heartbeat=HEARTBEAT, maximum=100.0, rows=SLOTS, width=100 * HOUR
    )


def q_normalize_gauge_offgrid(spark, d):
    """Raw events: several samples fall in one step, some at one time."""
    raw = table(spark, d, "events").select(
        F.concat("event_type", F.lit("/u"), F.col("user_id").cast("string")).alias("series_id"),
        F.floor(F.unix_micros("ts") / 1_000_000).cast("long").alias("ts"),
        "value",
    )
    return plain(_grid(raw))


def q_consolidate(spark, d):
    rows = samples(spark, d)
    parts = [
        series.consolidate(rows, ["value"], cf, xff=0.95, steps=24, step=HOUR).withColumn("cf", F.lit(cf))
        for cf in ("AVERAGE", "MIN", "MAX", "LAST")
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return plain(merged)


#: Quarters of a day, days and weeks over the grid of hours.
ARCHIVES = ["RRA:LAST:1:6:1600", "RRA:AVERAGE:0.95:24:400", "RRA:MAX:1:168:100"]


def _definitions(spark, names) -> archives.Definitions:
    texts = spark.createDataFrame([(t,) for t in [f"DS:{n}:GAUGE:3d:U:U" for n in names] + ARCHIVES], "def string")
    return archives.Definitions.of(series.parse_series_spec(texts, start=SERIES_START, step=HOUR))


def _archived(spark, points, definitions, borders) -> str:
    """Archives that were updated by one stretch of time after another; the last
    update is repeated."""
    folder, borders = new_folder(spark, "archives"), [0, *borders, 1 << 40]
    for low, high in zip(borders, borders[1:]):
        part = points.where((F.col("ts") > low) & (F.col("ts") <= high))
        archives.update_archives(part, folder, definitions)
    archives.update_archives(part, folder, definitions, rerun=True)
    return folder


def q_archive_update(spark, d):
    """Daily slots by every consolidation, from archives updated in three steps that
    cut days and weeks."""
    definitions = _definitions(spark, ["value"])
    borders = [SERIES_START + 100 * HOUR, SERIES_START + 333 * HOUR]
    folder = _archived(spark, materialize(samples(spark, d), "samples"), definitions, borders)
    parts = [
        archives.archived_range(spark, folder, definitions, SERIES_START, cf=cf, steps=24).withColumn("cf", F.lit(cf))
        for cf in ("AVERAGE", "MIN", "MAX", "LAST")
    ]
    return plain(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


def q_archive_fetch(spark, d):
    """A range of days of all counters, read from the daily archive alone."""
    definitions = _definitions(spark, COUNTERS)
    folder = _archived(spark, stored_series(spark, d), definitions, [SERIES_START + 7 * DAY])
    return plain(archives.archived_range(spark, folder, definitions, SERIES_START, 1706000400, "MAX", 24, xff=1.0))


def q_retain_last(spark, d):
    return plain(series.retain_last(samples(spark, d), rows=10, steps=24, step=HOUR, width=50 * HOUR))


def q_maintained(spark, d):
    spec = chains.SeriesSpec(start=SERIES_START, step=HOUR, heartbeat=HEARTBEAT, cf="AVERAGE", xff=0.5, steps=12, rows=30)
    return plain(chains.maintained(samples(spark, d), ["value"], spec))


def q_select_series(spark, d):
    return fetch.select_series(stored_series(spark, d), "*events/*c*", "*[0-4]", prune=False)


def q_select_root(spark, d):
    return fetch.select_series(stored_series(spark, d), "store/*", "*", prune=True)


def q_select_directories(spark, d):
    return fetch.select_series(stored_series(spark, d), "*", "*s*", type="d", prune=False)


def q_series_in_dirs(spark, d):
    s = stored_series(spark, d)
    dirs = fetch.select_series(s, "store/events/*", "*", type="d", prune=False)
    root = fetch.select_series(s, "store/*", "*", prune=True)
    return plain(fetch.series_in_dirs(s, dirs.unionByName(root)).select("series_id", "ts", *COUNTERS))


def q_fetch_range(spark, d):
    rows = fetch.fetch_range(stored_series(spark, d), SERIES_START + 5 * DAY, "last")
    return plain(rows.select("series_id", "ts", *COUNTERS))


def q_fetch_range_daily(spark, d):
    rows = fetch.fetch_range(
        stored_series(spark, d), SERIES_START, 1706000400, "MAX", steps=24, step=HOUR, xff=1.0
    )
    return plain(rows)


TYPES = ["click", "error", "purchase", "signup", "view"]


def _files(spark, d) -> DataFrame:
    return stored_series(spark, d).where("parent_path = 'events'")


def q_wide_view(spark, d):
    return plain(fetch.wide_view(fetch.long_form(_files(spark, d))))


def q_view_table(spark, d):
    return plain(
        chains.view_table(
            stored_series(spark, d), COUNTERS, SERIES_START + DAY, path="store/events", type="d", prune=True
        )
    )


def q_write_view_csv(spark, d):
    """The wide view through the CSV sink and back, one row per cell."""
    folder = new_folder(spark, "view")
    table = q_wide_view(spark, d)
    sinks.write_view_csv(table, folder)
    back = spark.read.schema(table.schema).option("header", True).option("nullValue", "nan").option("escape", '"').csv(folder)
    return plain(back.unpivot(["TIME"], [f"`{h}`" for h in table.columns[1:]], "title", "value"))


def q_write_wide_csv(spark, d):
    """The wide view of all series as one CSV document, read back cell by cell: what is
    known, and how many cells its line has."""
    folder = new_folder(spark, "wide")
    sinks.write_wide_csv(fetch.long_form(stored_series(spark, d), ["mmcc", "sif"]), folder)
    cells = materialize(sinks.read_wide_csv(spark, folder), "cells")
    titles = cells.where("TIME = 'TIME'").select(
        "at", F.replace(F.btrim("cell", F.lit('"')), F.lit('""'), F.lit('"')).alias("title")
    )
    known = cells.where("TIME <> 'TIME'").join(titles, "at")
    return plain(known.select(F.col("TIME").cast("long"), "title", F.col("cell").cast("double").alias("value"), "n_cells"))


def q_titled_view(spark, d):
    """The view of the whole store in long form."""
    points = chains.view_points(stored_series(spark, d), COUNTERS, SERIES_START + DAY, path="*", type="d", prune=False)
    return plain(fetch.titled(points).select("TIME", "title", "value"))


def q_trim_trailing_unknown(spark, d):
    points = fetch.long_form(stored_series(spark, d)).withColumn(
        "value", F.when(F.col("ts") < SERIES_START + 20 * DAY, F.col("value"))
    )
    return plain(fetch.trim_trailing_unknown(points))


PACKAGE_LINES = "mmcc_mean:FF0000,mmcc_median:6E0000,lif_deviation:2D2D00"
LEAF_LINES = "mmcc:FF0000,lif:0000FF"


def q_plot_series(spark, d):
    return plain(fetch.plot_series(stored_series(spark, d), PACKAGE_LINES, LEAF_LINES))


def q_plot_table(spark, d):
    return plain(
        chains.plot_table(
            stored_series(spark, d),
            SERIES_START,
            SERIES_START + 10 * DAY,
            PACKAGE_LINES,
            LEAF_LINES,
            width=DAY,
            path="store/events/*",
            prune=False,
            type="f",
        )
    )


def q_series_kind(spark, d):
    s = stored_series(spark, d)
    kind = fetch.series_kind(F.col("node_type")).alias("kind")
    return plain(s.groupBy("depth", kind).agg(F.count(F.lit(1)).alias("n")))


def q_trend(spark, d):
    moves = series.counter_trend(stored_series(spark, d), width=100 * HOUR)
    return plain(moves.select("series_id", "counter", "ts", "value", "delta", "direction"))


def q_trend_summary(spark, d):
    points = fetch.long_form(stored_series(spark, d))
    return plain(series.trend_summary(series.trend(points, width=100 * HOUR)))


QUERIES = {
    "parse_series_spec": q_parse_series_spec,
    "next_timestamp": q_next_timestamp,
    "next_timestamp_events": q_next_timestamp_events,
    "next_timestamp_empty": q_next_timestamp_empty,
    "collect_update": q_collect_update,
    "collect_init": q_collect_init,
    "collect_status": q_collect_status,
    "append_series": q_append_series,
    "collect_series": q_collect_series,
    "collect_changed": q_collect_changed,
    "reject_stale": q_reject_stale,
    "normalize_gauge": q_normalize_gauge,
    "normalize_gauge_offgrid": q_normalize_gauge_offgrid,
    "consolidate": q_consolidate,
    "archive_update": q_archive_update,
    "archive_fetch": q_archive_fetch,
    "retain_last": q_retain_last,
    "maintained": q_maintained,
    "select_series": q_select_series,
    "select_root": q_select_root,
    "select_directories": q_select_directories,
    "series_in_dirs": q_series_in_dirs,
    "fetch_range": q_fetch_range,
    "fetch_range_daily": q_fetch_range_daily,
    "wide_view": q_wide_view,
    "view_table": q_view_table,
    "write_view_csv": q_write_view_csv,
    "write_wide_csv": q_write_wide_csv,
    "titled_view": q_titled_view,
    "trim_trailing_unknown": q_trim_trailing_unknown,
    "plot_series": q_plot_series,
    "plot_table": q_plot_table,
    "series_kind": q_series_kind,
    "trend": q_trend,
    "trend_summary": q_trend_summary,
}

CREDIT = LEAVES_SQL.replace("o_custkey = c_custkey)", "o_custkey = c_custkey WHERE c_acctbal >= 0)")
COUNTER_LIST = ", ".join(COUNTERS)

GRID_SQL = f"""
pairs AS (
  SELECT *, coalesce(lag(ts) OVER (PARTITION BY series_id ORDER BY ts), {SERIES_START}) AS prev,
         max(ts) OVER (PARTITION BY series_id) AS top FROM samples),
grid AS (
  SELECT series_id, CAST(slot AS BIGINT) AS ts,
         CASE WHEN ts - prev <= {HEARTBEAT} AND value <= {{maximum}} THEN value END AS value
  FROM pairs, unnest(generate_series(greatest(prev, top - {{rows}} * {HOUR}) + {HOUR}, ts, {HOUR})) AS u(slot))
"""


def _wide_columns() -> str:
    cells = []
    for t in TYPES:
        for c in COUNTERS:
            name = f'events/{t}[""{c}""]'
            cells.append(f"round(max({c}) FILTER (WHERE series_id = 'events/{t}'), 6) AS \"{name}\"")
    return ", ".join(cells)


_PLOT = (
    "SELECT series_id, regexp_extract(series_id, '([^/]*)$', 1) AS title, kind, ts, CAST(line_no AS BIGINT) AS line_no, "
    "counter, color, round(value, 6) AS value FROM ("
    "SELECT *, 'package' AS kind, 1 AS line_no, 'mmcc_mean' AS counter, 'FF0000' AS color, mmcc AS value FROM s WHERE node_type <> 'item' "
    "UNION ALL SELECT *, 'package', 2, 'mmcc_median', '6E0000', mmcc_median FROM s WHERE node_type <> 'item' "
    "UNION ALL SELECT *, 'package', 3, 'lif_deviation', '2D2D00', lif_deviation FROM s WHERE node_type <> 'item' "
    "UNION ALL SELECT *, 'leaf', 1, 'mmcc', 'FF0000', mmcc FROM s WHERE node_type = 'item' "
    "UNION ALL SELECT *, 'leaf', 2, 'lif', '0000FF', lif FROM s WHERE node_type = 'item')"
)

_LONG = " UNION ALL ".join(f"SELECT series_id, '{c}' AS counter, ts, {c} AS value FROM store" for c in COUNTERS)
_TREND = f"""
moves AS (
  SELECT series_id, counter, ts, value, value - lag(value) OVER (PARTITION BY series_id, counter ORDER BY ts) AS delta
  FROM ({_LONG}))
"""
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in COUNTERS)

SQL = {
    "parse_series_spec": """
SELECT p_partkey, CASE WHEN ra THEN 'RRA:LAST:0.1:' || p_size || ':' || p_partkey * 10
       ELSE 'DS:m' || substr(p_brand, 7) || ':GAUGE:' || p_size || u || ':U:' || CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE 'U' END
       END AS def, CASE WHEN ra THEN 'RRA' ELSE 'DS' END AS kind,
       CASE WHEN NOT ra THEN 'm' || substr(p_brand, 7) END AS ds, CASE WHEN NOT ra THEN 'GAUGE' END AS ds_type,
       CASE WHEN NOT ra THEN CAST(p_size * f AS BIGINT) END AS heartbeat_s, NULL::DOUBLE AS min,
       CASE WHEN NOT ra AND p_size > 25 THEN p_size::DOUBLE END AS max, CASE WHEN ra THEN 'LAST' END AS cf,
       CASE WHEN ra THEN 0.1::DOUBLE END AS xff, CASE WHEN ra THEN p_size::BIGINT END AS steps,
       CASE WHEN ra THEN p_partkey * 10 END AS rows, 1701154260::BIGINT AS start, 1::BIGINT AS step
FROM (SELECT *, p_type = 'SMALL' AS ra, list_extract(['', 's', 'm', 'h', 'd', 'w', 'M', 'y'], p_size % 8 + 1) AS u,
             list_extract([1, 1, 60, 3600, 86400, 604800, 2678400, 31622400], p_size % 8 + 1) AS f FROM part)
""",
    "next_timestamp": f"""
WITH {CREDIT}, stored AS (SELECT node_path, {FIRST_TS} + unnest([0, 1]) AS ts FROM up WHERE depth = 1)
SELECT CAST(max(ts) + 1 AS BIGINT) AS next_ts FROM stored WHERE node_path = 'world'
""",
    "next_timestamp_events": "SELECT CAST(floor(epoch_us(max(ts)) / 3600000000) * 3600 + 1 AS BIGINT) AS next_ts FROM events",
    "next_timestamp_empty": f"""
WITH {STORED_SQL} SELECT CAST(coalesce(max(ts), 1701154261) + 1 AS BIGINT) AS next_ts FROM store WHERE series_id = 'unknown root'
""",
    "collect_update": f"""
SELECT node_path AS series_id, parent_path, depth, node_type, CAST({FIRST_TS + 2} AS BIGINT) AS ts, {COUNTER_LIST}
FROM ({COUNTER_SQL})
""",
    "collect_init": f"""
WITH {LEAVES_SQL}, known AS (
  SELECT path || '/' || item AS id FROM leaves WHERE c_acctbal >= 0 UNION SELECT node_path FROM up WHERE c_acctbal >= 0)
SELECT node_path AS series_id, parent_path, depth, node_type, CAST({FIRST_TS + 2} AS BIGINT) AS ts, {COUNTER_LIST}
FROM ({COUNTER_SQL}) WHERE node_path NOT IN (SELECT id FROM known)
""",
    "collect_status": TREE_SQL["component_counts"],
    "append_series": f"""
WITH n AS ({COUNTER_SQL})
SELECT node_path AS series_id, parent_path, depth, node_type, CAST({FIRST_TS} AS BIGINT) AS ts, {COUNTER_LIST} FROM n
UNION ALL SELECT node_path, parent_path, depth, node_type, {FIRST_TS + 1}, {COUNTER_LIST} FROM n WHERE node_type <> 'item'
""",
    "collect_series": f"""
WITH {PARTS_SQL}, k AS (
  SELECT CAST(number AS BIGINT) AS number, 'project/' || path AS path, item, mmcc, tmcc, sif, lif
  FROM watched, (SELECT unnest([0, 1, 2]) AS number) WHERE length(path) % 3 <= number),
p AS (SELECT *, string_split(path, '/') AS parts FROM k),
u AS (
  SELECT number, array_to_string(parts[1:depth], '/') AS node_path, depth,
         CASE WHEN depth = len(parts) THEN 'file' ELSE 'package' END AS node_type, mmcc, tmcc, sif, lif
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS depth FROM p)),
s AS ({stats_sql('u', 'number, node_path, depth, node_type', METRICS)}),
n AS (
  SELECT number, node_path, depth, node_type, {', '.join(f'{m}_mean AS {m}' for m in METRICS)}, {', '.join(COUNTERS[4:])} FROM s
  UNION ALL SELECT number, path || '/' || replace(item, ':', '+'), len(parts) + 1, 'item',
         {', '.join(f'CAST({m} AS DOUBLE)' for m in METRICS)}, {', '.join(['NULL'] * 8)} FROM p)
SELECT node_path AS series_id, regexp_replace(node_path, '/?[^/]*$', '') AS parent_path, CAST(depth AS BIGINT) AS depth,
       node_type, {FIRST_TS} + number AS ts, {COUNTER_LIST} FROM n
""",
    "collect_changed": f"""
WITH {PARTS_SQL}, k AS (
  SELECT *, CAST(regexp_extract(path, '_(\\d+)[.]', 1) AS BIGINT) AS key FROM watched),
n AS (SELECT count(*) AS whole, count(*) FILTER (WHERE key % 5 = 0) AS changed FROM k)
SELECT CAST(number AS BIGINT) AS number, CASE WHEN number = 2 THEN 'moved/' ELSE '' END || path AS path,
       'f_' || key || ':' || (3 + CAST(number > 0 AND key % 5 = 0 AS INT)) AS item,
       CAST(3 + CAST(number > 0 AND key % 5 = 0 AS INT) AS BIGINT) AS line, mmcc, tmcc, sif, lif,
       CASE number WHEN 0 THEN whole WHEN 1 THEN changed ELSE 0 END AS n_measured
FROM k, n, (SELECT unnest([0, 1, 2]) AS number)
""",
    "reject_stale": """
WITH u AS (SELECT 'u' || user_id AS series_id,
                  CAST(floor(epoch_us(ts) / 1000000) + (event_id * 37) % 11 * 7200 AS BIGINT) AS ts, event_id AS arrival
           FROM events),
w AS (SELECT *, max(ts) OVER (PARTITION BY series_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             AS last_ts FROM u)
SELECT *, last_ts IS NULL OR ts > last_ts AS accepted FROM w
""",
    "normalize_gauge": f"WITH {SAMPLES_SQL}, {GRID_SQL.format(maximum=100.0, rows=SLOTS)} SELECT * FROM grid",
    "normalize_gauge_offgrid": f"""
WITH raw AS (
  SELECT event_type || '/u' || user_id AS series_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec, value FROM events),
samples AS (
  SELECT series_id, sec // {HOUR} * {HOUR} AS ts, value FROM raw WHERE sec // {HOUR} * {HOUR} > {SERIES_START}
  QUALIFY row_number() OVER (PARTITION BY series_id, sec // {HOUR} ORDER BY sec DESC, value DESC NULLS LAST) = 1),
{GRID_SQL.format(maximum=100.0, rows=SLOTS)} SELECT * FROM grid
""",
    "consolidate": f"""
WITH {SAMPLES_SQL}, s AS (SELECT *, CAST(ceil(ts / {DAY}.0) * {DAY} AS BIGINT) AS slot FROM samples),
g AS (SELECT series_id, slot AS ts, avg(value) AS a, min(value) AS lo, max(value) AS hi, arg_max(value, s.ts) AS l,
             count(*) >= 2 AS known FROM s GROUP BY series_id, slot)
SELECT series_id, ts, CASE WHEN known THEN round(a, 6) END AS value, 'AVERAGE' AS cf FROM g
UNION ALL SELECT series_id, ts, CASE WHEN known THEN lo END, 'MIN' FROM g
UNION ALL SELECT series_id, ts, CASE WHEN known THEN hi END, 'MAX' FROM g
UNION ALL SELECT series_id, ts, CASE WHEN known THEN l END, 'LAST' FROM g
""",
    "retain_last": f"""
WITH {SAMPLES_SQL} SELECT series_id, ts, value FROM (
  SELECT *, max(ts) OVER (PARTITION BY series_id) AS top FROM samples) WHERE ts > top - {10 * DAY}
""",
    "maintained": f"""
WITH {SAMPLES_SQL}, {GRID_SQL.format(maximum="1e300", rows=360)},
c AS (SELECT series_id, CAST(ceil(ts / {12 * HOUR}.0) * {12 * HOUR} AS BIGINT) AS slot,
             CASE WHEN 12 - count(value) <= 6 THEN round(avg(value), 6) END AS value FROM grid GROUP BY ALL)
SELECT series_id, slot AS ts, value FROM (SELECT *, max(slot) OVER (PARTITION BY series_id) AS top FROM c)
WHERE slot > top - {30 * 12 * HOUR}
""",
    "select_series": f"""
WITH {STORED_SQL} SELECT DISTINCT series_id AS path, 'f' AS type FROM store
WHERE series_id LIKE 'events/%c%' AND regexp_matches(series_id, '[0-4]$')
""",
    "select_root": f"WITH {STORED_SQL} SELECT DISTINCT series_id AS path, 'f' AS type FROM store WHERE parent_path = ''",
    "select_directories": f"""
WITH {STORED_SQL} SELECT DISTINCT parent_path AS path, 'd' AS type FROM store
WHERE regexp_extract(CASE parent_path WHEN '' THEN 'store' ELSE parent_path END, '([^/]*)$', 1) LIKE '%s%'
""",
    "series_in_dirs": f"WITH {STORED_SQL} SELECT series_id, ts, {ROUNDED} FROM store WHERE depth IN (1, 3)",
    "fetch_range": f"""
WITH {STORED_SQL} SELECT series_id, ts, {ROUNDED} FROM store
WHERE ts > {SERIES_START + 5 * DAY} AND ts <= (SELECT max(ts) FROM store WHERE series_id = 'events')
""",
    "fetch_range_daily": f"""
WITH {STORED_SQL} SELECT series_id, parent_path, CAST(depth AS BIGINT) AS depth, node_type,
       CAST(ceil(ts / {DAY}.0) * {DAY} AS BIGINT) AS ts, {', '.join(f'round(max({c}), 6) AS {c}' for c in COUNTERS)}
FROM store WHERE ts > {SERIES_START // DAY * DAY} AND ts <= {-(-1706000400 // DAY) * DAY} GROUP BY 1, 2, 3, 4, 5
""",
    "wide_view": f"WITH {STORED_SQL} SELECT ts AS \"TIME\", {_wide_columns()} FROM store WHERE depth = 2 GROUP BY ts",
    "view_table": f"""
WITH {STORED_SQL} SELECT ts AS "TIME", {_wide_columns()} FROM store
WHERE depth = 2 AND ts > {SERIES_START + DAY} AND ts <= (SELECT max(ts) FROM store WHERE series_id = 'events/click')
GROUP BY ts
""",
    "write_view_csv": f"""
WITH {STORED_SQL}, s AS MATERIALIZED (SELECT * FROM store WHERE depth = 2),
known AS (
  SELECT ts, series_id, unnest({COUNTERS}) AS counter, unnest([{COUNTER_LIST}]) AS value FROM s),
grid AS (
  SELECT ts, unnest((SELECT list(DISTINCT series_id) FROM s)) AS series_id FROM (SELECT DISTINCT ts FROM s)),
cells AS (SELECT ts, series_id, unnest({COUNTERS}) AS counter FROM grid)
SELECT ts AS "TIME", series_id || '["' || counter || '"]' AS title, round(value, 6) AS value
FROM cells LEFT JOIN known USING (ts, series_id, counter)
""",
    "write_wide_csv": f"""
WITH {STORED_SQL}, s AS MATERIALIZED (SELECT series_id, ts, mmcc, sif FROM store)
SELECT ts AS "TIME", series_id || '["' || counter || '"]' AS title, round(value, 6) AS value,
       (SELECT 2 * count(DISTINCT series_id) + 1 FROM s) AS n_cells
FROM (SELECT series_id, ts, unnest(['mmcc', 'sif']) AS counter, unnest([mmcc, sif]) AS value FROM s)
""",
    "titled_view": f"""
WITH {STORED_SQL}, p AS (
  SELECT ts, series_id, unnest({COUNTERS}) AS counter, unnest([{COUNTER_LIST}]) AS value FROM store
  WHERE ts > {SERIES_START + DAY} AND ts <= (SELECT max(ts) FROM store WHERE series_id = 'events'))
SELECT ts AS "TIME", series_id || '["' || counter || '"]' AS title, round(value, 6) AS value FROM p
WHERE ts <= (SELECT max(ts) FROM p WHERE value IS NOT NULL)
""",
    "trim_trailing_unknown": f"""
WITH {STORED_SQL}, p AS (
  SELECT series_id, node_type, ts, unnest({COUNTERS}) AS counter, unnest([{COUNTER_LIST}]) AS value FROM store),
c AS (SELECT series_id, node_type, ts, counter, CASE WHEN ts < {SERIES_START + 20 * DAY} THEN round(value, 6) END AS value FROM p)
SELECT * FROM c WHERE ts <= (SELECT max(ts) FROM c WHERE value IS NOT NULL)
""",
    "plot_series": f"WITH {STORED_SQL}, s AS (SELECT * FROM store) {_PLOT}",
    "plot_table": f"""
WITH {STORED_SQL}, s AS (
  SELECT series_id, node_type, CAST(ceil(ts / {DAY}.0) * {DAY} AS BIGINT) AS ts, avg(mmcc) AS mmcc, avg(lif) AS lif,
         avg(mmcc_median) AS mmcc_median, avg(lif_deviation) AS lif_deviation
  FROM store WHERE depth > 1 AND ts > {SERIES_START} AND ts <= {SERIES_START + 10 * DAY} GROUP BY 1, 2, 3) {_PLOT}
""",
    "series_kind": f"""
WITH {STORED_SQL} SELECT CAST(depth AS BIGINT) AS depth, CASE depth WHEN 3 THEN 'leaf' ELSE 'package' END AS kind,
       count(*) AS n FROM store GROUP BY ALL
""",
    "trend": f"""
WITH {STORED_SQL}, {_TREND}
SELECT series_id, counter, ts, round(value, 6) AS value, round(delta, 6) AS delta, CAST(sign(delta) AS BIGINT) AS direction
FROM moves
""",
    "trend_summary": f"""
WITH {STORED_SQL}, {_TREND}
SELECT series_id, counter, count(*) FILTER (WHERE delta > 0) AS ups, count(*) FILTER (WHERE delta < 0) AS downs,
       CAST(coalesce(sum(sign(delta)), 0) AS BIGINT) AS balance, round(sum(delta), 6) AS change FROM moves GROUP BY ALL
""",
}
SQL["archive_update"], SQL["archive_fetch"] = SQL["consolidate"], SQL["fetch_range_daily"]
