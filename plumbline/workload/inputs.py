"""Operator inputs derived from the shared test tables.

Each Spark input has an SQL twin that computes the same rows from base columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.operators import tree
from plumbline.plans.session import materialize
from plumbline.schema import COUNTERS, METRICS

HOUR = 3600
SERIES_START = 1704063600  # one hour before the first event


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    # The files hold times without a zone; the operators work on instants.
    local = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else rows


def plain(df: DataFrame) -> DataFrame:
    """Result columns in the types SQL gives: BIGINT, DOUBLE with 6 decimals."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6)
        out.append(column.alias(field.name))
    return df.select(*out)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, as a corpus of many files would be; the small test
    tables come as one partition each."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


# --- leaves: customers as functions, nations as files, regions as packages ----

def customer_leaves(spark: SparkSession, folder: str, root: str = "world") -> DataFrame:
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_if(F.col("o_orderstatus") == "F").alias("done"),
        F.max("o_totalprice").alias("price"),
    )
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = customers.join(orders, "c_custkey", "left")
    zero = F.lit(0).cast("long")
    cnt, done = F.coalesce("cnt", zero), F.coalesce("done", zero)
    return joined.select(
        F.concat_ws("/", F.lit(root), "r_name", "n_name").alias("path"),
        F.col("c_name").alias("item"),
        (1 + cnt).alias("mmcc"),
        (1 + cnt + done).alias("tmcc"),
        (1 + F.col("c_custkey") % 97).alias("sif"),
        (1 + F.coalesce(F.floor(F.col("price") / 1000), zero)).cast("long").alias("lif"),
        "c_acctbal",
    )


LEAVES_SQL = """
o AS (SELECT o_custkey, count(*) AS cnt, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
             max(o_totalprice) AS price FROM orders GROUP BY o_custkey),
leaves AS (
  SELECT 'world/' || r_name || '/' || n_name AS path, c_name AS item,
         CAST(1 + coalesce(cnt, 0) AS BIGINT) AS mmcc,
         CAST(1 + coalesce(cnt, 0) + coalesce(done, 0) AS BIGINT) AS tmcc,
         CAST(1 + c_custkey % 97 AS BIGINT) AS sif,
         CAST(1 + coalesce(floor(price / 1000), 0) AS BIGINT) AS lif, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN o ON o_custkey = c_custkey),
up AS (
  SELECT 'world' AS node_path, 1 AS depth, 'package' AS node_type, * FROM leaves
  UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2, 'package', * FROM leaves
  UNION ALL SELECT path, 3, 'file', * FROM leaves)
"""


def stats_sql(source: str, keys: str, metrics: list[str]) -> str:
    """Columns ``<metric>_<statistic>`` as plain aggregates."""
    functions = {"mean": "avg", "median": "median", "deviation": "stddev_pop"}
    columns = [
        f"round(CAST({functions[s]}({m}) AS DOUBLE), 6) AS {m}_{s}" for s in functions for m in metrics
    ]
    return f"SELECT {keys}, count(*) AS n_leaves, {', '.join(columns)} FROM {source} GROUP BY ALL"


# --- sources: one C file per part ---------------------------------------------

def part_sources(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    key = F.col("p_partkey").cast("string")
    ifs, cases = size % 5, size % 3
    switch = F.concat(
        F.lit("    switch (a) {\n"), F.repeat(F.lit("        case 1: break;\n"), cases), F.lit("    }\n")
    )
    content = F.concat(
        F.lit("#include <x>\n\nint f_"),
        key,
        F.lit("(int a)\n{\n"),
        F.repeat(F.lit("    if (a > 1 && a < 9) { a++; }\n"), ifs),
        F.when(cases > 0, switch).otherwise(F.lit("")),
        F.lit('    // while (if) {\n    const char *s = "if (x) {";\n    return a;\n}\n'),
    )
    rows = table(spark, folder, "part").select(part_path().alias("path"), content.alias("content"))
    return spread(rows, "path")


def part_path() -> Column:
    extension = F.element_at(F.array(*[F.lit(e) for e in ("cpp", "hpp", "c", "h", "txt")]), F.col("p_size") % 5 + 1)
    middle = F.when(F.col("p_size") % 11 == 0, F.lit("build")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("_")))
    return F.concat(
        F.col("p_type"), F.lit("/"), middle, F.lit("/part_"), F.col("p_partkey").cast("string"), F.lit("."), extension
    )


PARTS_SQL = """
parts AS (
  SELECT p_type || '/' || CASE WHEN p_size % 11 = 0 THEN 'build' ELSE replace(p_brand, '#', '_') END
         || '/part_' || p_partkey || '.' || list_extract(['cpp', 'hpp', 'c', 'h', 'txt'], p_size % 5 + 1) AS path,
         'f_' || p_partkey || ':3' AS item, p_size % 5 AS ifs, p_size % 3 AS cases, p_size FROM part),
measured AS (
  SELECT path, item, CAST(1 + 2 * ifs + least(cases, 1) AS BIGINT) AS mmcc,
         CAST(1 + 2 * ifs + cases AS BIGINT) AS tmcc,
         CAST(2 * ifs + CASE WHEN cases > 0 THEN 1 + cases ELSE 0 END + 2 AS BIGINT) AS sif,
         CAST(6 + ifs + CASE WHEN cases > 0 THEN 2 + cases ELSE 0 END AS BIGINT) AS lif, p_size FROM parts),
watched AS (SELECT * FROM measured WHERE p_size % 11 <> 0 AND p_size % 5 <> 4)
"""


# --- samples: hourly series per event type and user -----------------------------

def samples(spark: SparkSession, folder: str) -> DataFrame:
    hour = F.floor(F.unix_micros("ts") / F.lit(HOUR * 1_000_000)) * HOUR
    return table(spark, folder, "events").groupBy(
        F.concat("event_type", F.lit("/u"), F.col("user_id").cast("string")).alias("series_id"),
        hour.cast("long").alias("ts"),
    ).agg(F.max("value").alias("value"))


SAMPLES_SQL = """
samples AS (
  SELECT event_type || '/u' || user_id AS series_id,
         CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS ts, max(value) AS value
  FROM events GROUP BY 1, 2)
"""


def stored_series(spark: SparkSession, folder: str) -> DataFrame:
    """A stored table: root ``events``, one file node per type, one item per user."""
    events = table(spark, folder, "events").select(
        F.concat_ws("/", F.lit("events"), "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias(
            "leaf_path"
        ),
        (F.floor(F.unix_micros("ts") / F.lit(HOUR * 1_000_000)) * HOUR).cast("long").alias("ts"),
        "value",
    )
    nodes = tree.explode_ancestors(events).select("node_path", "depth", "node_type", "ts", "value").unionByName(
        events.select(
            F.col("leaf_path").alias("node_path"), F.lit(3).alias("depth"), F.lit("item").alias("node_type"), "ts", "value"
        )
    )
    grouped = nodes.groupBy("node_path", "depth", "node_type", "ts").agg(
        F.count(F.lit(1)).cast("double").alias("cnt"), F.max("value").alias("hi"), F.min("value").alias("lo")
    )
    inner = F.col("node_type") != "item"
    counters = {
        "mmcc": F.col("cnt"),
        "tmcc": F.col("hi"),
        "sif": F.col("lo"),
        "lif": F.col("hi") + F.col("cnt"),
    }
    for i, metric in enumerate(METRICS):
        counters[f"{metric}_median"] = F.when(inner, F.col("hi") + (i + 1))
        counters[f"{metric}_deviation"] = F.when(inner, F.col("lo") + (i + 1))
    rows = grouped.select(
        F.col("node_path").alias("series_id"),
        F.regexp_replace("node_path", "/?[^/]*$", "").alias("parent_path"),
        "depth",
        "node_type",
        "ts",
        *[counters[c].alias(c) for c in COUNTERS],
    )
    return materialize(rows, "series")


def _stored_sql() -> str:
    inner = ", ".join(
        [f"CASE WHEN depth < 3 THEN hi + {i + 1} END AS {m}_median" for i, m in enumerate(METRICS)]
        + [f"CASE WHEN depth < 3 THEN lo + {i + 1} END AS {m}_deviation" for i, m in enumerate(METRICS)]
    )
    return f"""
hourly AS (
  SELECT event_type, user_id, CAST(floor(epoch_us(ts) / 3600000000) * 3600 AS BIGINT) AS ts, value FROM events),
levels AS (
  SELECT 'events' AS series_id, '' AS parent_path, 1 AS depth, 'package' AS node_type, ts, value FROM hourly
  UNION ALL SELECT 'events/' || event_type, 'events', 2, 'file', ts, value FROM hourly
  UNION ALL SELECT 'events/' || event_type || '/u' || user_id, 'events/' || event_type, 3, 'item', ts, value
  FROM hourly),
raw AS (
  SELECT series_id, parent_path, depth, node_type, ts, CAST(count(*) AS DOUBLE) AS cnt, max(value) AS hi,
         min(value) AS lo FROM levels GROUP BY ALL),
store AS (
  SELECT series_id, parent_path, CAST(depth AS BIGINT) AS depth, node_type, ts, cnt AS mmcc, hi AS tmcc,
         lo AS sif, hi + cnt AS lif, {inner} FROM raw)
"""


STORED_SQL = _stored_sql()


# --- log lines: one per event ----------------------------------------------------

def log_input(spark: SparkSession, folder: str) -> DataFrame:
    """Stored lines of ten testers; the event id decides on broken ones."""
    e = table(spark, folder, "events")
    kind = F.col("event_id") % 50
    n = (F.col("event_id") % 7 + 1).cast("string")
    m = (F.col("event_id") % 3 + 1).cast("string")
    message = (
        F.when(F.col("event_type") == "signup", F.concat(F.lit("collected "), n, F.lit(" items")))
        .when(F.col("event_type") == "view", F.concat(F.lit("===== "), n, F.lit(" passed in 0.51s =====")))
        .when(F.col("event_type") == "click", F.concat(F.lit("= "), n, F.lit(" failed, "), m, F.lit(" passed in 2s =")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("== "), n, F.lit(" skipped in 1.00s ==")))
        .when(F.col("event_id") % 2 == 0, F.concat(F.lit("=== "), n, F.lit(" failed in 3.20s ===")))
        .otherwise(F.concat(F.lit("step "), n, F.lit(" : a : b  ")))
    )
    stamp = F.when(kind == 3, F.lit("Foo 99 10:00:00")).otherwise(F.date_format("ts", "MMM d HH:mm:ss"))
    prefix = F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("<13")).otherwise(F.lit("<13>"))
    tester = F.when(kind == 4, F.lit("daemon")).otherwise(
        F.concat(F.lit("unit_tester_"), (F.col("user_id") % 10).cast("string"))
    )
    line = F.concat(prefix, stamp, F.lit(" host1 "), tester, F.lit("[42]: "), message)
    rows = e.select(
        F.when(kind == 2, F.lit("   ")).otherwise(line).alias("value"),
        F.lit("events").alias("file"),
        F.lit(0).cast("long").alias("block"),
        F.col("event_id").alias("line_no"),
    )
    return materialize(spread(rows, "line_no"), "lines")


LOG_SQL = """
base AS (
  SELECT event_id, event_type, event_id % 50 AS kind, CAST(event_id % 7 + 1 AS BIGINT) AS n,
         CAST(event_id % 3 + 1 AS BIGINT) AS m, date_trunc('second', ts) AS sec,
         'unit_tester_' || (user_id % 10) AS producer FROM events),
owned AS (SELECT * FROM base WHERE kind NOT IN (2, 4)),
parsed AS (
  SELECT *, CASE kind WHEN 0 THEN 'no_priority'
                      WHEN 1 THEN 'open_priority'
                      WHEN 3 THEN 'bad_time' END AS reason,
         CASE event_type WHEN 'signup' THEN 'collected ' || n || ' items'
              WHEN 'view' THEN '===== ' || n || ' passed in 0.51s ====='
              WHEN 'click' THEN '= ' || n || ' failed, ' || m || ' passed in 2s ='
              WHEN 'purchase' THEN '== ' || n || ' skipped in 1.00s =='
              ELSE CASE WHEN event_id % 2 = 0 THEN '=== ' || n || ' failed in 3.20s ==='
                        ELSE 'step ' || n || ':a:b' END END AS message
  FROM owned),
outcome AS (
  SELECT *, CASE WHEN reason IS NULL AND event_type = 'signup' THEN n ELSE 0 END AS total,
         CASE WHEN reason IS NOT NULL THEN 0 WHEN event_type = 'view' THEN n
              WHEN event_type = 'click' THEN m ELSE 0 END AS passed,
         CASE WHEN reason IS NOT NULL THEN 0 WHEN event_type = 'click' THEN n
              WHEN event_type = 'error' AND event_id % 2 = 0 THEN n ELSE 0 END AS failed,
         CASE WHEN reason IS NULL AND event_type = 'purchase' THEN n ELSE 0 END AS skipped
  FROM parsed),
stats AS (
  SELECT producer, CAST(sum(total) AS BIGINT) AS total, CAST(sum(passed) AS BIGINT) AS passed,
         CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(skipped) AS BIGINT) AS skipped
  FROM outcome GROUP BY producer)
"""
