"""Queries over request lines, catalogs, probes and update streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.operators import catalog
from plumbline.plans.session import new_folder
from plumbline.streaming import ended
from plumbline.streaming.probes import read_timeouts, start_probes, start_responses
from plumbline.streaming.updates import start_reject_stale
from plumbline.workload.inputs import plain, table
from plumbline.workload.store import SQL as STORE_SQL

TIMEOUT_MS = 20 * 60 * 1000


def _requests(spark, d) -> DataFrame:
    """``SESSION_ID=.. mmcc=.. ..`` lines; ``k`` comes from the JSON properties."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    user = F.col("user_id").cast("string")
    line = F.concat(
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("SESSION_ID=u"), user, F.lit(" "))).otherwise(F.lit("SESSION_IDX=no ")),
        F.lit("mmcc="), k, F.lit(",9=x -lif=1, mmcc=7"), k,
        F.when(F.col("event_type") == "view", F.lit(" tmcc= NO_NAME_PARAM.0=z")).otherwise(F.lit("  sif:3")),
    )
    return e.select(
        "event_id", F.col("event_type").alias("query"), F.concat(F.lit("u"), user).alias("session"), "ts", line.alias("line")
    )


def q_extract_attr(spark, d):
    found = catalog.extract_attr(_requests(spark, d), "SESSION_ID", "nobody", name="session_id")
    found = catalog.extract_attr(found, "mmcc", name="mmcc")
    found = catalog.extract_attr(found, "sif", "none", ":", name="sif")
    return found.select("event_id", "session_id", "mmcc", "sif")


def q_effective_params(spark, d):
    types = table(spark, d, "events").select(F.col("event_type").alias("query")).distinct()
    entries = [("mmcc", "1,"), ("tmcc", "2,"), ("lif", "3,"), ("NO_NAME_PARAM.0", "AVERAGE")]
    declared = F.create_map(*[F.lit(x) for pair in entries for x in pair])
    params = catalog.effective_params(_requests(spark, d), types.withColumn("params", declared))
    return params.select("event_id", *[F.col("params")[name].alias(alias) for name, alias in (
        ("mmcc", "mmcc"), ("tmcc", "tmcc"), ("lif", "lif"), ("NO_NAME_PARAM.0", "cf"))])


def q_latest_request(spark, d):
    last = catalog.latest_request(_requests(spark, d), order=["ts", "event_id"])
    return last.select("query", "session", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def q_pair_args(spark, d):
    line = F.concat_ws(" ", F.lit("-mmcc"), "p_brand", F.lit("-lif"), F.col("p_size").cast("string"), F.when(
        F.col("p_size") % 2 == 0, F.lit("tail")))
    rows = table(spark, d, "part").select("p_partkey", line.alias("line"))
    return catalog.pair_lines(rows).select("p_partkey", "paired")


def _required(spark, d) -> DataFrame:
    """Parts required per order: service = order, query = part."""
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("service"),
        F.col("l_linenumber").cast("string").alias("name"),
        F.concat(F.lit("api/part/"), F.col("l_partkey").cast("string")).alias("query"),
    )


def _available(spark, d) -> DataFrame:
    parts = table(spark, d, "part").where("p_size <= 40")
    return parts.select(F.concat(F.lit("api/part/"), F.col("p_partkey").cast("string")).alias("query"))


def q_dependencies(spark, d):
    return catalog.dependencies(_required(spark, d), "order_1[0-9]*5")


def q_unmet_dependencies(spark, d):
    return catalog.unmet_dependencies(_required(spark, d), _available(spark, d))


def q_resolve_queries(spark, d):
    rows = table(spark, d, "part").select(
        "p_partkey",
        F.concat(F.lit("api/"), "p_brand", F.when(F.col("p_size") % 3 == 0, F.lit("/")).otherwise(F.lit(""))).alias("service"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("+/"), "p_name")).otherwise(F.col("p_name")).alias("query"),
    )
    return catalog.resolve_queries(rows).select("p_partkey", "query")


def _catalogs(spark, d) -> tuple[DataFrame, DataFrame]:
    items = table(spark, d, "lineitem")
    old = items.where("l_shipdate < '1998-01-01'").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    new = items.where("l_shipdate >= '1997-01-01'").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    return old, new


def q_snapshot_diff(spark, d):
    return catalog.snapshot_diff(*_catalogs(spark, d))


def q_same_set(spark, d):
    return catalog.same_set(catalog.snapshot_diff(*_catalogs(spark, d)))


def _probes(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clicks as probes, views of the same user as responses."""
    tagged = events.withColumn("tag", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return (
        tagged.where("event_type = 'click'").select("event_id", "tag", "ts"),
        tagged.where("event_type = 'view'").select("tag", "ts"),
    )


def q_probe_timeouts(spark, d):
    unmet = catalog.probe_timeouts(*_probes(table(spark, d, "events")), timeout_ms=TIMEOUT_MS)
    return unmet.select("event_id", "tag")


def q_probe_timeouts_stream(spark, d):
    """Files of mixed times, one read in every batch, by two streams."""
    folder = new_folder(spark, "events")
    events = table(spark, d, "events")
    events.repartition(3, F.xxhash64("event_id")).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    probes, responses = _probes(stream)
    sent, answered = new_folder(spark, "probes"), new_folder(spark, "responses")
    running = [
        start_probes(probes, sent, new_folder(spark, "state")),
        start_responses(responses, answered, new_folder(spark, "state"), TIMEOUT_MS),
    ]
    for query in running:
        query.awaitTermination()
    return read_timeouts(spark, sent, answered, TIMEOUT_MS).select("event_id", "tag")


def q_unanswered_probes_stream(spark, d):
    """Files of mixed times, one read in every batch; a probe is told when its deadline
    has passed, and corrected by a late response. The last file only moves the clock on."""
    events = table(spark, d, "events").where("event_type IN ('click', 'view')").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag"),
        F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).alias("probe"),
        "ts",
    )
    folder, out, state = (new_folder(spark, n) for n in ("events", "unanswered", "state"))
    late = F.pmod(F.xxhash64("tag", "ts"), F.lit(4)) * (2 * TIMEOUT_MS * 1000)
    events.repartitionByRange(4, F.unix_micros("ts") + late).write.parquet(folder)
    clock = events.agg((F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts")).select(
        F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("probe"), "ts"
    )
    for rows in (None, clock):
        if rows is not None:
            rows.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        told = ended.unanswered_stream(stream, TIMEOUT_MS, keep_ms=30 * ended.KEEP_MS)
        ended.start_told(told, out, state).awaitTermination()
    found = ended.current_unanswered(spark.read.schema(ended.PROBES).parquet(out))
    return found.select(F.col("probe").cast("long").alias("event_id"), "tag")


def q_reject_stale_stream(spark, d):
    """Updates in several micro-batches, in order of arrival."""
    folder = new_folder(spark, "updates")
    updates = table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("series_id"),
        (F.floor(F.unix_micros("ts") / 1_000_000) + (F.col("event_id") * 37) % 11 * 7200).cast("long").alias("ts"),
        F.col("event_id").alias("arrival"),
    )
    # One range of arrivals after another arrives as the files of one folder.
    half = updates.agg(F.floor(F.max("arrival") / 2)).scalar()
    out, last, state = (new_folder(spark, n) for n in ("marked", "last", "state"))
    for arrived in (F.col("arrival") <= half, F.col("arrival") > half):
        updates.where(arrived).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(updates.schema).parquet(folder)
        start_reject_stale(stream, out, last, state).awaitTermination()
    return plain(spark.read.parquet(out).select("series_id", "ts", "arrival", "last_ts", "accepted"))


QUERIES = {
    "extract_attr": q_extract_attr,
    "effective_params": q_effective_params,
    "latest_request": q_latest_request,
    "pair_args": q_pair_args,
    "dependencies": q_dependencies,
    "unmet_dependencies": q_unmet_dependencies,
    "resolve_queries": q_resolve_queries,
    "snapshot_diff": q_snapshot_diff,
    "same_set": q_same_set,
    "probe_timeouts": q_probe_timeouts,
    "probe_timeouts_stream": q_probe_timeouts_stream,
    "unanswered_probes_stream": q_unanswered_probes_stream,
    "reject_stale_stream": q_reject_stale_stream,
}

REQUIRED = """
r AS (SELECT 'order_' || l_orderkey AS service, l_linenumber::VARCHAR AS name, 'api/part/' || l_partkey AS query, l_partkey
      FROM lineitem)
"""
DIFF = """
o AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
n AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'),
d AS (SELECT part, supplier, CASE WHEN n.part IS NULL THEN 'removed' WHEN o.part IS NULL THEN 'added' ELSE 'same' END AS status
      FROM o FULL JOIN n USING (part, supplier))
"""
UNMET_SQL = f"""
SELECT event_id, 'u' || user_id AS tag FROM events p WHERE event_type = 'click' AND NOT EXISTS (
  SELECT 1 FROM events r WHERE r.event_type = 'view' AND r.user_id = p.user_id AND r.ts >= p.ts
         AND r.ts <= p.ts + INTERVAL {TIMEOUT_MS} MILLISECONDS)
"""

SQL = {
    "extract_attr": """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE 'nobody' END AS session_id,
       json_extract_string(props, '$.k') || ',9' AS mmcc, CASE WHEN event_type = 'view' THEN 'none' ELSE '3' END AS sif
FROM events
""",
    "effective_params": """
SELECT event_id, '7' || json_extract_string(props, '$.k') AS mmcc, CASE WHEN event_type = 'view' THEN '' ELSE '2,' END AS tmcc,
       '3,' AS lif, 'AVERAGE' AS cf FROM events
""",
    "latest_request": """
SELECT event_type AS query, 'u' || user_id AS session, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY events.ts DESC, event_id DESC) = 1
""",
    "pair_args": """
SELECT p_partkey, '-mmcc=' || p_brand || ' -lif=' || p_size || CASE WHEN p_size % 2 = 0 THEN ' tail' ELSE '' END AS paired
FROM part
""",
    "dependencies": f"WITH {REQUIRED} SELECT service, name, query FROM r WHERE regexp_matches(service, '^order_1[0-9]*5')",
    "unmet_dependencies": f"""
WITH {REQUIRED} SELECT service, name, query, 'query is not available' AS reason FROM r
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40)
""",
    "resolve_queries": """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'api/' || p_brand || '/' || p_name ELSE p_name END AS query FROM part
""",
    "snapshot_diff": f"WITH {DIFF} SELECT * FROM d",
    "same_set": f"WITH {DIFF} SELECT count(*) FILTER (WHERE status <> 'same') = 0 AS same_set FROM d",
    "probe_timeouts": UNMET_SQL,
    "probe_timeouts_stream": UNMET_SQL,
    "unanswered_probes_stream": UNMET_SQL,
    "reject_stale_stream": STORE_SQL["reject_stale"],
}
