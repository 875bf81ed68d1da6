"""Wide views of few and of many series, and globs as ranges."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.functions.patterns import literal_prefix
from plumbline.operators import fetch, series
from plumbline.plans import chains
from plumbline.schema import SERIES
from plumbline.sources import sinks


def long(spark, data):
    return spark.createDataFrame(data, "series_id string, counter string, ts long, value double")


def test_wide_view_keeps_every_value(spark):
    names = ["a", "a\x1fb", "a b", "a:1", 'a"b', "a`b.c", "é", "a\nb", "1:a"]
    points = long(spark, [(n, c, 5, float(i)) for i, n in enumerate(names) for c in ("mmcc", "lif")])
    row = fetch.wide_view(points).first().asDict()
    assert len(row) == 1 + 2 * len(names)
    assert sorted(v for k, v in row.items() if k != "TIME") == sorted(2 * [float(i) for i in range(len(names))])
    wanted = fetch.wide_view(points.where("series_id = 'a'"), ['z["x"]', 'a["lif"]', 'a["mmcc"]'])
    assert [tuple(r) for r in wanted.collect()] == [(5, None, 0.0, 0.0)] and wanted.columns[1] == 'z["x"]'


def read_document(folder):
    files = sorted(f for f in folder.iterdir() if f.name.startswith("part"))
    return list(csv.reader(io.StringIO("".join(f.read_text() for f in files))))


def test_wide_csv(spark, tmp_path):
    """Gaps, unknown values, quotes, commas, titles that two series share."""
    data = [("a", "mmcc", 1, 1.0), ("a", "mmcc", 3, 3.5), ("b,\"x", "mmcc", 2, None), ("b,\"x", "lif", 3, float("nan")),
            ("c%colon%d", "lif", 1, 7.0), ("c:d", "lif", 1, 8.0)]
    sinks.write_wide_csv(long(spark, data), str(tmp_path / "csv"))
    table = read_document(tmp_path / "csv")
    assert table == [
        ["TIME", 'a["mmcc"]', 'b,"x["lif"]', 'b,"x["mmcc"]', 'c%colon%d["lif"]', 'c:d["lif"]'],
        ["1", "1.0", "nan", "nan", "7.0", "8.0"], ["2", *["nan"] * 5], ["3", "3.5", *["nan"] * 4],
    ]
    few = fetch.wide_view(long(spark, data)).orderBy("TIME")
    assert few.columns == table[0]


def test_more_titles_than_a_plan_holds_columns(spark, tmp_path):
    n = 100_000
    points = spark.range(2 * n).select(
        F.concat(F.lit("p/f"), (F.col("id") % n).cast("string")).alias("series_id"), F.lit("mmcc").alias("counter"),
        F.floor(F.col("id") / n).cast("long").alias("ts"), F.col("id").cast("double").alias("value"),
    ).where("id % 3 <> 0")
    sinks.write_wide_csv(points, str(tmp_path / "csv"))
    head, *lines = read_document(tmp_path / "csv")
    known = {(int(line[0]), t): float(v) for line in lines for t, v in zip(head[1:], line[1:]) if v != "nan"}
    assert all(len(line) == len(head) for line in lines) and len(lines) == 2
    expected = {(i // n, f'p/f{i % n}["mmcc"]'): float(i) for i in range(2 * n) if i % 3}
    assert known == expected and head[1:] == sorted({t for _, t in expected})


@pytest.mark.parametrize(
    "glob, prefix", [("*", ""), ("store/ev*", "store/ev"), ("store/a?c", "store/a"), ("store/x[ab]", "store/x"), ("store/one", "store/one")]
)
def test_literal_prefix(glob, prefix):
    assert literal_prefix(glob) == prefix


def test_globs_reach_the_files(spark, tmp_path):
    nodes = spark.createDataFrame(
        [(n, n.rpartition("/")[0], n.count("/") + 1, "item", 7, *[1.0] * 12) for n in ("r", "r/a", "r/ab", "r/ab/x", "r/b", "r%")], SERIES
    )
    series.append_series(nodes, str(tmp_path / "s"))
    stored = chains.read_series(spark, str(tmp_path / "s"))
    for path, type_, wanted in (
        ("store/r/a*", "f", ["r/a", "r/ab", "r/ab/x"]), ("store/r/ab", "f", ["r/ab"]), ("store/r*", "f", ["r", "r%", "r/a", "r/ab", "r/ab/x", "r/b"]),
        ("store/r/?b", "f", ["r/ab"]), ("store/r/a*", "d", ["r/ab"]), ("store", "d", [""]), ("st*", "d", ["", "r", "r/ab"]),
    ):
        assert rows(fetch.select_series(stored, path, type=type_, prune=False), "path") == sorted(((w,) for w in wanted), key=repr)
    plan = fetch.select_series(stored, "store/r/a*", prune=False)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(series_id,r/a)" in plan
    chosen = chains.selected(stored, "store/r/a*", type="f", prune=False)
    assert rows(chosen, "series_id") == [("r/a",), ("r/ab",), ("r/ab/x",)]
    assert "StringStartsWith(series_id,r/a)" in chosen._jdf.queryExecution().executedPlan().toString()
    assert rows(chains.selected(stored, "store/r/ab", type="d", prune=False), "series_id") == [("r/ab/x",)]


def test_wide_csv_is_read_by_known_cells(spark, tmp_path):
    """Commas and quotes in titles; a value without a time takes the place of its title."""
    data = [("a", "mmcc", 1, 1.0), ('b,"x', "lif", 3, 2.5), ("c", "lif", None, 9.0)]
    sinks.write_wide_csv(long(spark, data), str(tmp_path / "csv"))
    assert rows(sinks.read_wide_csv(spark, str(tmp_path / "csv"))) == [
        ("1", 1, "1.0", 4), ("3", 2, "2.5", 4),
        ("TIME", 1, '"a[""mmcc""]"', 4), ("TIME", 2, '"b,""x[""lif""]"', 4), ("TIME", 3, "9.0", 4),
    ]


def test_a_line_is_read_in_pieces():
    """Only known cells leave a line, a bounded number at once, and the rest counts."""
    known = {3 * i + 1 for i in range(500)} | {90_000}
    line = ",".join(["17", *(str(i) if i in known else "nan" for i in range(1, 100_001))])
    batches = list(sinks.known_cells(line, size=100))
    assert all(b.num_rows <= 100 for b in batches)
    assert [p for b in batches for p in b["at"].to_pylist()] == sorted(known)
    assert all(b["cell"].to_pylist() == [str(p) for p in b["at"].to_pylist()] for b in batches)
    assert {n for b in batches for n in b["n_cells"].to_pylist()} == {100_001}
