import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.operators import fetch, series, tree
from plumbline.plans import chains
from plumbline.schema import COUNTERS, METRICS, NODES, SERIES


def leaves_of(spark, data):
    df = spark.createDataFrame(data, "path string, item string, mmcc long, tmcc long, sif long, lif long")
    return tree.with_leaf_path(df)


def nodes_of(spark, data):
    leaves = leaves_of(spark, data)
    return tree.to_counter_row(leaves, tree.rollup_stats(leaves))


FIRST = [("r/x.c", "f:1", 1, 2, 3, 4), ("r/x.c", "g:5", 3, 4, 5, 6)]
SECOND = FIRST + [("r/y.c", "h:1", 9, 9, 9, 9)]


def empty(spark):
    return spark.createDataFrame([], SERIES)


def test_parse_series_spec(spark):
    specs = ["DS:mmcc:GAUGE:1y:U:U", "DS:lif:GAUGE:90:0:10.5", "RRA:LAST:0.1:1:10000", "DS:x:GAUGE:soon:U:U"]
    parsed = {r["def"]: r for r in series.parse_series_spec(spark.createDataFrame([(s,) for s in specs], "def string")).collect()}
    first, second, archive, odd = (parsed[s] for s in specs)
    assert (first.ds, first.ds_type, first.heartbeat_s, first.min, first.max) == ("mmcc", "GAUGE", 366 * 86400, None, None)
    assert (second.heartbeat_s, second.min, second.max, second.step) == (90, 0.0, 10.5, 1)
    assert (archive.cf, archive.xff, archive.steps, archive.rows, archive.ds) == ("LAST", 0.1, 1, 10000, None)
    assert odd.heartbeat_s is None


def test_parameters(spark):
    params = chains.series_parameters(spark)
    assert params.count() == 13 and params.where("heartbeat_s = 31622400").count() == 12
    assert chains.Ranges.from_args({"-mmcc": "10,3000", "-path": "x"}) == chains.Ranges(mmcc="10,3000")


def test_collect_over_three_snapshots(spark, tmp_path):
    """Empty store, then a new node, then ``init`` with another new node."""
    path = str(tmp_path / "store")
    nodes = nodes_of(spark, FIRST)
    added, status = chains.collect(empty(spark), nodes, "r")
    assert rows(added, "series_id", "ts")[0] == ("r", 1701154262) and added.count() == 4
    assert status.first().status == '{"error":0,"statistic":{"package":1,"file":1,"item":2}}'
    series.append_series(added, path)

    stored = chains.read_series(spark, path)
    added, _ = chains.collect(stored, nodes_of(spark, SECOND), "r")
    assert rows(added.select("ts").distinct()) == [(1701154263,)] and added.count() == 6
    series.append_series(added, path)
    with pytest.raises(ValueError, match="stored already"):
        series.append_series(added, path)
    series.append_series(added, path, rerun=True)  # a repeated run changes nothing

    stored = chains.read_series(spark, path)
    assert stored.count() == 10
    fresh, _ = chains.collect(stored, nodes_of(spark, SECOND + [("r/z.c", "k:1", 1, 1, 1, 1)]), "r", "init")
    assert rows(fresh, "series_id", "ts") == [("r/z.c", 1701154264), ("r/z.c/k+1", 1701154264)]
    plan = fetch.fetch_range(stored, 1701154262, 1701154263)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan


def test_counter_rows(spark):
    nodes = {r.node_path: r for r in nodes_of(spark, FIRST).collect()}
    leaf, inner = nodes["r/x.c/f+1"], nodes["r/x.c"]
    assert [leaf[c] for c in COUNTERS] == [1.0, 2.0, 3.0, 4.0] + [None] * 8
    assert [inner[c] for c in COUNTERS] == [2.0, 3.0, 4.0, 5.0, 2.0, 3.0, 4.0, 5.0, 1.0, 1.0, 1.0, 1.0]
    assert (leaf.parent_path, inner.parent_path, nodes["r"].parent_path) == ("r/x.c", "r", "")


def test_next_timestamp_wants_a_package(spark):
    store = spark.createDataFrame([("r", "file", 5), ("p", "package", 9)], "series_id string, node_type string, ts long")
    assert series.next_timestamp(store, "r").first().next_ts == 1701154262
    assert series.next_timestamp(store, "p").first().next_ts == 10


def test_reject_stale(spark):
    data = [("s", 10, 1), ("s", 12, 2), ("s", 12, 3), ("s", 11, 4), ("s", 13, 5), ("t", 1, 6)]
    updates = spark.createDataFrame(data, "series_id string, ts long, arrival long")
    assert rows(series.reject_stale(updates, width=2), "arrival", "last_ts", "accepted") == [
        (1, None, True), (2, 10, True), (3, 12, False), (4, 12, False), (5, 12, True), (6, None, True)]
    last = spark.createDataFrame([("s", 12), ("u", 1)], "series_id string, last_ts long")
    marked = series.reject_stale(updates, last=last)
    assert rows(marked, "arrival", "accepted") == [(1, False), (2, False), (3, False), (4, False), (5, True), (6, True)]


def test_normalize_gauge_by_hand(spark):
    data = [("s", 3, 1.0), ("s", 5, 2.0), ("s", 10, 50.0), ("s", 11, None), ("t", 2, 7.0)]
    samples = spark.createDataFrame(data, "series_id string, ts long, value double")
    grid = series.normalize_gauge(samples, ["value"], start=0, heartbeat=4, maximum=60, width=4)
    assert rows(grid.where("series_id = 's'"), "ts", "value") == sorted(
        [(1, 1.0), (2, 1.0), (3, 1.0), (4, 2.0), (5, 2.0)] + [(t, None) for t in range(6, 12)], key=repr)
    assert rows(grid.where("series_id = 't'"), "ts", "value") == [(1, 7.0), (2, 7.0)]
    limited = series.normalize_gauge(samples, ["value"], start=0, heartbeat=9, maximum=10, rows=3)
    assert rows(limited.where("series_id = 's'"), "ts", "value") == [(10, None), (11, None), (9, None)]


def test_off_grid_times_are_floored(spark):
    samples = spark.createDataFrame([("s", 25, 1.0), ("s", 47, 2.0)], "series_id string, ts long, value double")
    grid = series.normalize_gauge(samples, ["value"], start=0, step=10)
    assert rows(grid, "ts", "value") == [(10, 1.0), (20, 1.0), (30, 2.0), (40, 2.0)]


@pytest.mark.parametrize("cf, expected", [("AVERAGE", 2.0), ("MIN", 1.0), ("MAX", 3.0), ("LAST", 3.0)])
def test_consolidate(spark, cf, expected):
    points = spark.createDataFrame(
        [("s", 1, 1.0), ("s", 2, 3.0), ("s", 3, None), ("s", 4, 5.0)], "series_id string, ts long, value double")
    merged = series.consolidate(points, ["value"], cf, xff=0.5, steps=3)
    assert rows(merged, "ts", "value") == [(3, expected), (6, None)]
    assert rows(series.consolidate(points, ["value"], cf), "ts", "value") == rows(points, "ts", "value")


def test_one_step_consolidation_is_the_identity(spark):
    points = spark.createDataFrame([("s", t, float(t % 7)) for t in range(1, 400)], "series_id string, ts long, value double")
    grid = series.normalize_gauge(points, ["value"], start=0)
    assert rows(series.consolidate(grid, ["value"], steps=1), "ts", "value") == rows(grid, "ts", "value")
    assert series.retain_last(grid, rows=10, width=50).count() == 10


def test_retention_counts_slots(spark):
    points = spark.createDataFrame([("s", 1), ("s", 98), ("s", 100), ("t", 1)], "series_id string, ts long")
    assert rows(series.retain_last(points, rows=3, width=10), "series_id", "ts") == [("s", 100), ("s", 98), ("t", 1)]


def store_of(spark):
    data = []
    for ts in (11, 12, 13):
        data += [("r", "", 1, "package", ts), ("r/x.c", "r", 2, "file", ts), ("r/x.c/f+1", "r/x.c", 3, "item", ts)]
    data.append(("r/x.c", "r", 2, "file", 14))
    df = spark.createDataFrame(data, "series_id string, parent_path string, depth int, node_type string, ts long")
    inner = F.col("node_type") != "item"
    for i, counter in enumerate(COUNTERS):
        value = (F.col("ts") * 100 + i).cast("double")
        df = df.withColumn(counter, value if counter in METRICS else F.when(inner, value))
    return df


def test_selection(spark):
    store = store_of(spark)
    def pick(**kw):
        return [r[0] for r in rows(fetch.select_series(store, **kw), "path")]
    assert pick(path="store/*") == ["r"]
    assert pick(path="store/*", prune=False) == ["r", "r/x.c", "r/x.c/f+1"]
    assert pick(path="*", name="*.c", prune=False) == ["r/x.c"]
    assert pick(path="*") == []  # the store itself matches, nothing below is visited
    assert pick(path="*", type="d") == [""]
    assert pick(path="*", type="d", prune=False) == ["", "r", "r/x.c"]
    inside = fetch.series_in_dirs(store, fetch.select_series(store, "store/r", type="d"))
    assert rows(inside.select("series_id").distinct()) == [("r/x.c",)]
    default = fetch.series_in_dirs(store, fetch.select_series(store, "*", type="d"))
    assert rows(default.select("series_id").distinct()) == [("r",)]


def test_fetch_range(spark):
    store = store_of(spark)
    assert fetch.fetch_range(store, 11, 13).count() == 6
    assert fetch.fetch_range(store, 11, "last").agg(F.max("ts")).first()[0] == 13  # of the first series
    assert fetch.fetch_range(store, 0, None).count() == 9
    assert fetch.fetch_range(store.where("ts < 0"), 0, None).count() == 0
    coarse = fetch.fetch_range(store, 0, 14, "MAX", steps=2, xff=1.0, values=["mmcc"])
    assert rows(coarse.where("series_id = 'r'"), "ts", "mmcc") == [(12, 1200.0), (14, 1300.0)]


def test_view_table(spark):
    store = store_of(spark).withColumn("lif", F.when(F.col("ts") < 13, F.col("lif")))
    wide = chains.view_table(store, ["lif", "mmcc"], 0, 14, path="store/*", type="f", prune=False)
    assert wide.columns[0] == "TIME" and len(wide.columns) == 7
    found = {r.TIME: r for r in wide.collect()}
    assert set(found) == {11, 12, 13, 14}
    assert found[14]['r["mmcc"]'] is None and found[14]['r/x.c["mmcc"]'] == 1400.0
    only = chains.view_table(store, ["lif"], 0, 14, path="store/*", type="f", prune=False)
    assert sorted(r.TIME for r in only.collect()) == [11, 12]  # unknown tail dropped
    assert 'r/x.c/f+1["lif"]' in only.columns
    with pytest.raises(ValueError, match="not in headers"):
        fetch.wide_view(fetch.long_form(store, ["lif"]), ['r["lif"]'])


def test_series_of_one_title_stay_apart(spark):
    points = spark.createDataFrame(
        [("a/b", "lif", 1, 1.0), ("a%slash%b", "lif", 1, 2.0)], "series_id string, counter string, ts long, value double")
    wide = fetch.wide_view(points)
    assert sorted(v for c, v in wide.first().asDict().items() if c != "TIME") == [1.0, 2.0]
    assert fetch.titled(points).count() == 2


def test_trim_keeps_unknown_rows_inside(spark):
    points = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, None), (5, None)], "ts long, value double")
    assert rows(fetch.trim_trailing_unknown(points), "ts") == [(1,), (2,), (3,)]
    assert fetch.trim_trailing_unknown(points.where("value IS NULL")).count() == 0


def test_plot_series(spark):
    store = store_of(spark).where("ts = 11")
    plot = fetch.plot_series(store)
    assert plot.where("kind = 'leaf'").count() == 4 and plot.where("kind = 'package'").count() == 24
    leaf = plot.where("kind = 'leaf' AND line_no = 2").first()
    assert (leaf.title, leaf.counter, leaf.color, leaf.value) == ("f+1", "tmcc", "FFFF00", 1101.0)
    mean = plot.where("series_id = 'r' AND line_no = 1").first()
    assert (mean.counter, mean.value) == ("mmcc_mean", 1100.0)
    halved = fetch.plot_series(store_of(spark), leaf_counters="mmcc:000000", width=2)
    assert rows(halved.where("kind = 'leaf'"), "ts", "value") == [(12, 1150.0), (14, 1300.0)]
    with pytest.raises(ValueError):
        fetch.parse_counters("nonsense:FFFFFF")


def test_a_step_keeps_its_last_sample(spark):
    samples = spark.createDataFrame(
        [("s", 7200, 2.0), ("s", 7300, 50.0), ("s", 9000, 99.0), ("s", 9000, 98.0)], "series_id string, ts long, value double")
    grid = series.normalize_gauge(samples, ["value"], start=3600, step=3600)
    assert rows(grid, "ts", "value") == [(7200, 99.0)]


def test_nodes_need_one_root(spark, tmp_path):
    nodes = nodes_of(spark, FIRST).unionByName(nodes_of(spark, [("other/x.c", "f:1", 1, 1, 1, 1)]))
    with pytest.raises(ValueError, match="exactly one root"):
        chains.collect(empty(spark), nodes)
    with pytest.raises(ValueError, match="not 'project'"):
        chains.collect(empty(spark), nodes_of(spark, FIRST), root="project")
    assert chains.read_series(spark, str(tmp_path / "nothing")).count() == 0


def test_a_malformed_report_is_no_series(spark):
    good = nodes_of(spark, FIRST).withColumn("error", F.lit(None).cast("string"))
    bad = spark.createDataFrame([(None,) * 16], NODES).withColumn("error", F.lit("broken"))
    added, status = chains.collect(empty(spark), good.unionByName(bad))
    assert added.where("series_id IS NULL").count() == 0 and added.count() == 4
    assert status.first().status.startswith('{"error":-1,')


def test_trend(spark):
    points = spark.createDataFrame(
        [("s", "c", 1, 5.0), ("s", "c", 9, 7.0), ("s", "c", 10, 6.0), ("s", "c", 11, 6.0)],
        "series_id string, counter string, ts long, value double")
    moves = series.trend(points, width=4)
    assert rows(moves, "ts", "delta", "direction") == [(1, None, None), (10, -1.0, -1), (11, 0.0, 0), (9, 2.0, 1)]
    total = series.trend_summary(moves).first()
    assert (total.ups, total.downs, total.balance, total.change) == (1, 1, 0, 1.0)


def test_trend_of_all_counters_at_once(spark):
    """Equals the trend of the long form, unknown values and a single row included."""
    data = [(f"s{i % 3}", i * 7 % 50, float(i % 5) if i % 4 else None, float(i)) for i in range(40)] + [("alone", 3, 1.0, 2.0)]
    rows_ = spark.createDataFrame(data, "series_id string, ts long, mmcc double, lif double").dropDuplicates(["series_id", "ts"])
    long = rows_.unpivot(["series_id", "ts"], ["mmcc", "lif"], "counter", "value")
    columns = ("series_id", "counter", "ts", "value", "prev_value", "delta", "direction")
    expected = series.trend(long, width=9)
    assert rows(series.counter_trend(rows_, ["mmcc", "lif"], width=9), *columns) == rows(expected, *columns)
