"""Segmented computations against plain windows, with one hot key."""

import random
import statistics

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from plumbline.operators import sketches, skew


@pytest.fixture(scope="module")
def hot(spark):
    """Half of all rows belong to one key; order numbers have wide gaps."""
    rng = random.Random(7)
    data, used = [], set()
    while len(data) < 3000:
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        order = rng.randrange(100_000) if rng.random() < 0.9 else rng.randrange(10**7)
        if (key, order) not in used:
            used.add((key, order))
            data.append((key, order, rng.randrange(-500, 500), rng.choice([None, rng.randrange(9)])))
    return spark.createDataFrame(data, "k string, o long, v long, w long").cache()


def test_previous_row_equals_lag(hot):
    along = Window.partitionBy("k").orderBy("o")
    expected = hot.select("*", F.lag("v").over(along), F.lag("w").over(along), F.max("o").over(Window.partitionBy("k")))
    actual = skew.previous_row(hot, ["k"], "o", ["v", "w"], 5000, last_order="top")
    assert rows(actual, "k", "o", "v", "w", "prev_v", "prev_w", "top") == rows(expected)


def test_running_max_equals_window(hot):
    along = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    expected = hot.select("*", F.max("v").over(along))
    assert rows(skew.running_max(hot, ["k"], "o", "v", 5000, "best")) == rows(expected)


def test_key_maximum(hot):
    expected = hot.select("*", F.max("o").over(Window.partitionBy("k")))
    assert rows(skew.key_maximum(hot, ["k"], "o", 5000, "top")) == rows(expected)


def test_run_starts(hot):
    spans = hot.select("k", "o", (F.col("o") * 10).alias("lo"), (F.col("o") * 10 + 5).alias("hi"))
    found = {(r.k, r.o): r.s for r in skew.run_starts(spans, ["k"], "o", "lo", "hi", 900, 5000, "s").collect()}
    by_key = {}
    for key, order in sorted(found):
        by_key.setdefault(key, []).append(order)
    for key, orders in by_key.items():
        start = previous = None
        for order in orders:
            if previous is None or order * 10 - (previous * 10 + 5) > 900:
                start = order
            assert found[key, order] == start
            previous = order


def test_global_prefix_sum(hot):
    along = Window.orderBy("o", "k").rowsBetween(Window.unboundedPreceding, -1)
    expected = hot.select("*", F.coalesce(F.sum("v").over(along), F.lit(0)))
    assert rows(skew.global_prefix_sum(hot, ["o", "k"], "v", "s", partitions=7)) == rows(expected)


@pytest.mark.parametrize("doubles", [False, True])
def test_distributions(spark, doubles):
    rng = random.Random(3)
    groups = {f"g{n}": [rng.gauss(0, 10) ** 3 if doubles else rng.randrange(-50, 3000) for _ in range(n)] for n in (1, 2, 3, 10, 501)}
    groups["same"] = [7] * 20
    groups["two"] = [1, 1000000]
    data = [(k, float(v) if doubles else int(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(data, f"k string, v {'double' if doubles else 'long'}")
    run = skew.distribution if doubles else skew.integer_distribution
    found = {r.k: r for r in run(df, ["k"], "v").collect()}
    for key, values in groups.items():
        assert found[key].n == len(values)
        assert found[key].median == statistics.median(values)
        assert found[key].mean == pytest.approx(statistics.fmean(values), rel=1e-9, abs=1e-9)
        assert found[key].deviation == pytest.approx(statistics.pstdev(values), rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("base, step", [(0.0, 1e-12), (1.7e9, 1e-4)])
def test_close_values_of_one_key_spread_over_partitions(spark, base, step, monkeypatch):
    """However close the values of a hot key are, no task orders all of them."""
    sizes = []
    written = skew.materialize

    def watched(df, name):
        stored = written(df, name)
        sizes.extend(r[0] for r in stored.groupBy("__part").count().select("count").collect())
        return stored

    monkeypatch.setattr(skew, "materialize", watched)
    values = [base + i * step for i in range(4001)]
    df = spark.createDataFrame([("hot", v) for v in values], "k string, v double").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if they were large
    try:
        found = skew.distribution(df, ["k"], "v").first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.n == 4001 and found.median == values[2000]
    assert found.deviation == pytest.approx(statistics.pstdev(values), rel=1e-5)
    assert max(sizes) < 0.6 * sum(sizes)


def test_unknown_values_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0)], "k string, v double")
    found = skew.distribution(df, ["k"], "v").first()
    assert (found.n, found.mean, found.median) == (2, 2.0, 2.0)



def test_join_whole_matches_nulls(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert rows(skew.join_whole(left, right, ["k"]), "k", "x", "y") == [("a", 2, 20), (None, 1, 10)]


def test_sketches_stay_within_their_rank_error(spark):
    """Medians of merged sketches have the middle ranks, but for the stated error."""
    n = 60_000
    leaves = spark.range(n).select(
        F.concat(F.lit("p/d"), (F.col("id") % 7).cast("string"), F.lit("/f"), (F.col("id") % 91).cast("string"), F.lit("/x"), F.col("id").cast("string")).alias("leaf_path"),
        F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("a"),
        F.when(F.col("id") % 3 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 7).alias("b"),
    )
    files = sketches.file_sketches(leaves, metrics=["a", "b"])
    assert files.count() == 91
    nodes = sketches.rollup_sketches(files, metrics=["a", "b"], doubles=["b"]).cache()
    for quantile in (0.1, 0.5, 0.99):
        found = {r.node_path: r for r in sketches.sketch_stats(nodes, metrics=["a", "b"], doubles=["b"], quantile=quantile).collect()}
        for path, rows_ in (("p", leaves), ("p/d3", leaves.where("leaf_path LIKE 'p/d3/%'"))):
            for m in ("a", "b"):
                known = rows_.where(F.col(m).isNotNull())
                rank = known.where(F.col(m) <= found[path][f"{m}_median"]).count() / known.count()
                assert abs(rank - quantile) <= sketches.RANK_ERROR + 0.001 + (m == "b") * 0.001
    exact = leaves.agg(F.avg("b"), F.stddev_pop("b")).first()
    root = sketches.sketch_stats(nodes, metrics=["a", "b"], doubles=["b"]).where("node_path = 'p'").first()
    assert root.n_leaves == n and (root.b_mean, root.b_deviation) == pytest.approx(tuple(exact))
    none = sketches.sketch_stats(sketches.rollup_sketches(sketches.file_sketches(leaves.where("a < 0"), metrics=["a"]), metrics=["a"]), metrics=["a"])
    assert none.count() == 0
