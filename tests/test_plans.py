"""Plans: what reaches the scan, and what must not appear."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.operators import metrics, series, tree
from plumbline.plans import chains
from plumbline.plans.session import materialize
from plumbline.workload.inputs import customer_leaves, samples

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def leaves(spark):
    return materialize(tree.with_leaf_path(customer_leaves(spark, FOLDER)), "leaves")


def test_ranges_and_columns_reach_the_scan(leaves):
    kept = metrics.filter_metric_ranges(leaves, mmcc="2,9").select("item")
    plan = plan_of(kept)
    pushed = kept._jdf.queryExecution().explainString(
        kept.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(mmcc,2), LessThanOrEqual(mmcc,9)" in pushed
    assert "ReadSchema: struct<item:string,mmcc:bigint,tmcc:bigint,sif:bigint,lif:bigint>" in plan


def test_statistics_scan_once_and_shuffle_reduced_rows(leaves):
    plan = plan_of(tree.rollup_stats(leaves))
    assert plan.count("FileScan") == 1
    # Counts by file, by node, and the statistics of a node.
    assert plan.count("Exchange hashpartitioning") == 3
    assert "c_acctbal" not in plan and "partial_sum" in plan


def test_stale_check_shuffles_rows_once(spark):
    rows = materialize(samples(spark, FOLDER).withColumn("arrival", F.col("ts")), "updates")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the summary were large
    try:
        plan = plan_of(series.reject_stale(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The rows, and three exchanges of one row per segment.
    assert plan.count("Exchange hashpartitioning") == 4
    assert plan.count("FileScan") == 2 and "ReadSchema: struct<series_id:string,ts:bigint,arrival:bigint>" in plan


def test_measuring_needs_no_shuffle(leaves):
    sources = materialize(leaves.select("path", F.col("item").alias("content")), "sources")
    assert "Exchange" not in plan_of(chains.measured(sources))


@pytest.mark.parametrize(
    "name", ["next_timestamp_events", "collect_update", "fetch_range", "trim_trailing_unknown", "flame_frames", "probe_timeouts"]
)
def test_no_cross_join(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
