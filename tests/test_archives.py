"""Archives from definitions, and collections that measure only what changed."""

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.operators import archives, series, unchanged
from plumbline.operators.metrics import code_metrics

START = 1_000_000


def definitions(spark, *texts, step=10):
    return archives.Definitions.of(series.parse_series_spec(spark.createDataFrame([(t,) for t in texts], "def string"), start=START, step=step))


@pytest.fixture(scope="module")
def three(spark):
    return definitions(spark, "DS:a:GAUGE:1d:U:U", "DS:b:GAUGE:1d:0:50", "RRA:LAST:0.5:1:1000", "RRA:AVERAGE:0.5:6:100", "RRA:MAX:0.9:30:20")


def test_definitions(spark, three):
    assert three.values == ["a", "b"] and (three.start, three.step) == (START, 10)
    assert three.sources[1] == archives.DataSource("b", 86400, 0.0, 50.0)
    assert three.archives[1] == archives.Archive("AVERAGE", 0.5, 6, 100)
    for texts in (["DS:a:GAUGE:1d:U:U"], ["RRA:LAST:0.5:1:10"], ["DS:a:GAUGE:1d:U:U", "what"], ["DS:a:GAUGE:1d:U:U"] * 2 + ["RRA:LAST:0.5:1:10"]):
        with pytest.raises(ValueError):
            definitions(spark, *texts)


def test_the_coarsest_archive_that_serves(three):
    newest = START + 10_000
    chosen = lambda steps, back, cf="AVERAGE": three.serving(cf, steps, newest - back, newest).steps
    assert chosen(60, 1000) == 30 and chosen(12, 1000) == 6 and chosen(7, 1000) == 1
    # The coarsest reaches back 20 * 300, the next 100 * 60, the finest 1000 * 10.
    assert chosen(30, 5000) == 30
    assert chosen(30, 9000) == 1
    assert chosen(30, 50_000) == 1  # none reaches back so far
    with pytest.raises(ValueError):
        archives.Definitions(three.sources, three.archives[1:]).serving("MAX", 7, START, newest)


@pytest.fixture(scope="module")
def points(spark):
    """Three series; gaps, unknown values, values out of the limits; one ends early."""
    i = F.col("id")
    n = F.pmod(F.xxhash64(i), F.lit(100))
    return (
        spark.range(900)
        .select(
            F.concat(F.lit("s"), (i % 3).cast("string")).alias("series_id"),
            F.lit("p").alias("parent_path"),
            (F.lit(START) + 10 * F.floor(i / 3) + 10).cast("long").alias("ts"),
            F.when(n > 10, n.cast("double")).alias("a"),
            n.cast("double").alias("b"),
        )
        .where((n != 7) & ((F.col("series_id") != "s2") | (i < 300)))
    )


@pytest.fixture(scope="module")
def folder(spark, three, points, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("archives") / "a")
    for low, high in ((0, 777), (777, 1800), (1800, 1 << 30)):  # cuts slots of all archives
        part = points.where((F.col("ts") - START > low) & (F.col("ts") - START <= high))
        archives.update_archives(part, folder, three)
    return folder


@pytest.mark.parametrize("cf", ["AVERAGE", "MIN", "MAX", "LAST"])
@pytest.mark.parametrize("steps", [1, 6, 30, 60])
def test_archives_equal_consolidation_of_everything(spark, three, points, folder, cf, steps):
    limited = points.withColumn("b", F.when(F.col("b").between(0, 50), F.col("b")))
    expected = series.consolidate(limited, ["a", "b"], cf, 0.5, steps, 10, keys=["series_id", "parent_path"])
    found = archives.archived_range(spark, folder, three, START, cf=cf, steps=steps, xff=0.5)
    rounded = lambda df: rows(df, "series_id", "ts", F.round("a", 9), F.round("b", 9))
    assert rounded(found) == rounded(expected)


def test_a_range_reads_its_slots_of_one_archive(spark, three, folder):
    found = archives.archived_range(spark, folder, three, START + 600, START + 1200, "MAX", 30)
    files = {f.split("/a/", 1)[1].split("/part")[0] for f in found.inputFiles()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(steps" in plan and "(steps#" in plan and " = 30)" in plan
    assert files  # inputFiles does not prune; the plan does
    assert rows(found.select("ts").distinct()) == [(START + 800,), (START + 1100,), (START + 1400,)] or all(
        START + 600 < r.ts <= START + 1200 + 300 for r in found.collect()
    )


def test_points_count_once(spark, three, points, folder, tmp_path):
    last = points.where(F.col("ts") > START + 2500)
    before = rows(archives.archived_range(spark, folder, three, START, cf="AVERAGE", steps=30))
    with pytest.raises(ValueError):
        archives.update_archives(last, folder, three)
    archives.update_archives(last, folder, three, rerun=True)
    assert rows(archives.archived_range(spark, folder, three, START, cf="AVERAGE", steps=30)) == before
    with pytest.raises(ValueError):
        archives.archived_range(spark, str(tmp_path / "none"), three)


def test_retention(spark, points, tmp_path):
    short = definitions(spark, "DS:a:GAUGE:1d:U:U", "DS:b:GAUGE:1d:U:U", "RRA:LAST:0.5:6:10")
    archives.update_archives(points, str(tmp_path / "a"), short)
    kept = archives.archived_range(spark, str(tmp_path / "a"), short, START, steps=6)
    assert kept.select("ts").distinct().count() == 10
    assert kept.agg(F.max("ts")).first()[0] == START // 60 * 60 + 3060


# Collections


def texts(spark, contents):
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def test_only_new_texts_are_measured(spark, tmp_path):
    results = str(tmp_path / "results")
    f, g = "int f() { if (a) b(); }", "int g() { return 1; } int h() { for (;;) ; }"
    first = {"a.c": f, "b.c": g, "copy/a.c": f, "empty.c": "", "null.c": None}

    def collected(contents, run, rules=1):
        sources = texts(spark, contents)
        found = unchanged.metrics_of_changed(sources, results, run, incomplete=True, rules=rules)
        assert rows(found) == rows(code_metrics(sources, incomplete=True))
        return spark.read.schema(unchanged.RESULTS).parquet(f"{results}/rules={rules}/run={run}").count()

    assert collected(first, "one") == 3  # two texts and the empty one
    assert collected(first, "one") == 3  # a repeated run writes the same part
    assert collected({"moved/a.c": f, "b.c": g + " int i() {}"}, "two") == 1
    assert collected(first, "three") == 0
    assert collected(first, "one", rules=2) == 3  # other rules measure anew
    assert unchanged.read_results(spark, str(tmp_path / "none")).count() == 0


def test_extra_columns_of_changed_texts(spark, tmp_path):
    sources = texts(spark, {"a.c": "int f() { }"}).withColumn("snapshot", F.lit(3)).withColumn("hash", F.lit("x"))
    found = unchanged.metrics_of_changed(sources, str(tmp_path / "r"), "one", ["snapshot"])
    assert rows(found, "snapshot", "path", "item") == [(3, "a.c", "f:1")]


def files_of(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def test_only_slots_with_new_points_are_written_again(spark, three, points, tmp_path, monkeypatch):
    """A repeated update leaves every file; an interrupted one is finished in its slots.
    A slot that is more than one task's share comes in several files."""
    folder = tmp_path / "a"
    monkeypatch.setattr(archives, "TASK_ROWS", 50)
    early, late = points.where(F.col("ts") <= START + 1000), points.where(F.col("ts") > START + 1000)
    archives.update_archives(early, str(folder), three)
    before = files_of(folder)
    assert max(sum(f.startswith(f"steps=30/slot={s}/") for f in before) for s in (START // 300 * 300 + 600,)) > 1
    archives.update_archives(early, str(folder), three, rerun=True)
    assert files_of(folder) == before
    archives.update_archives(late.where("series_id = 's1'"), str(folder), three)
    archives.update_archives(late, str(folder), three, rerun=True)
    whole = str(tmp_path / "b")
    archives.update_archives(points, whole, three)
    found = [rows(archives.archived_range(spark, f, three, START, cf="LAST", steps=6)) for f in (str(folder), whole)]
    assert found[0] == found[1] and found[0]
    assert {f for f in before if f.startswith("steps=1/")} <= files_of(folder)
