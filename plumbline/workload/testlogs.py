"""Queries over test-run logs, one line per event."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from plumbline.operators import logs
from plumbline.plans import chains
from plumbline.plans.session import materialize, new_folder
from plumbline.sources.files import read_logs
from plumbline.sources.growing import filesystem, follow_logs
from plumbline.streaming import ended
from plumbline.streaming.logs import (
    read_log_stream,
    read_outcome_stats,
    read_sessions,
    start_log_report,
    start_outcome_stats,
    start_sessions,
)
from plumbline.workload.inputs import LOG_SQL, log_input, plain

YEAR = 2024
GAP_MS = 30 * 60 * 1000


def _parsed(spark, d) -> DataFrame:
    return logs.parse_log(log_input(spark, d), YEAR, "pcap")


def _shown(ts: str = "ts"):
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def q_strip_priority(spark, d):
    owned = logs.extract_producer(logs.drop_blank(log_input(spark, d)))
    stripped = logs.strip_priority(owned, "pcap")
    return stripped.select("line_no", F.col("record").isNull().alias("broken"), "reason", "record")


def q_extract_producer(spark, d):
    return logs.extract_producer(log_input(spark, d)).select("line_no", "producer")


def q_parse_log_time(spark, d):
    return _parsed(spark, d).select("line_no", _shown().alias("ts"), "reason")


def q_rebuild_message(spark, d):
    return _parsed(spark, d).select("line_no", "message")


def q_classify_outcome(spark, d):
    return _parsed(spark, d).select("line_no", "form", *logs.OUTCOMES)


def q_outcome_stats(spark, d):
    return logs.outcome_stats(_parsed(spark, d))


def q_outcome_totals(spark, d):
    return logs.outcome_totals(logs.outcome_stats(_parsed(spark, d)))


def q_failure_log(spark, d):
    return plain(logs.failure_log(materialize(_parsed(spark, d), "parsed"), lines_per_segment=500))


def q_verdict(spark, d):
    return logs.verdict(logs.outcome_stats(_parsed(spark, d)))


def q_run_verdict(spark, d):
    return plain(logs.run_verdict(logs.outcome_stats(_parsed(spark, d))))


def q_quarantine(spark, d):
    valid, malformed = logs.quarantine(_parsed(spark, d))
    good = valid.groupBy("producer").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("valid"))
    bad = malformed.groupBy("producer", "reason").agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad)


def q_activity_sessions(spark, d):
    sessions = logs.activity_sessions(_parsed(spark, d), GAP_MS)
    return sessions.select("producer", _shown("first_ts").alias("first_ts"), _shown("last_ts").alias("last_ts"), "n_lines")


def q_log_report(spark, d):
    """Totals of the composed report."""
    return chains.log_report(log_input(spark, d), YEAR, "pcap")["totals"]


def q_log_report_verdict(spark, d):
    """Verdict of the composed report."""
    return plain(chains.log_report(log_input(spark, d), YEAR, "pcap")["verdict"])


def _log_folder(spark, d) -> str:
    folder = new_folder(spark, "logs")
    log_input(spark, d).select("value").write.text(folder)
    return folder


def q_read_logs(spark, d):
    """The lines as files, read back in batch."""
    return logs.outcome_stats(logs.parse_log(read_logs(spark, _log_folder(spark, d)), YEAR, "pcap"))


def q_log_report_failures(spark, d):
    """Failure logs of the composed report, put together per producer."""
    pieces = chains.log_report(log_input(spark, d), YEAR, "pcap")["failures"]
    return plain(pieces.groupBy("producer", "severity").agg(
        F.sum("n_lines").alias("n_lines"), F.sum(F.length("log") - F.col("n_lines") + 1).alias("n_chars")
    ))


def q_log_report_malformed(spark, d):
    bad = chains.log_report(log_input(spark, d), YEAR, "pcap")["malformed"]
    return plain(bad.groupBy("producer", "reason").agg(F.count(F.lit(1)).alias("n")))


def q_log_report_sessions(spark, d):
    """Sessions of the composed report, with a silence of its own."""
    return _as_shown(chains.log_report(log_input(spark, d), YEAR, "pcap", gap_ms=GAP_MS)["sessions"])


def _as_shown(sessions: DataFrame) -> DataFrame:
    return sessions.select("producer", _shown("first_ts").alias("first_ts"), _shown("last_ts").alias("last_ts"), "n_lines")


def _shuffled_folder(spark, d) -> str:
    """The lines as several files, with lines of all times in each."""
    folder = new_folder(spark, "logs")
    log_input(spark, d).repartition(4, F.xxhash64("line_no")).select("value").write.text(folder)
    return folder


def q_outcome_stats_stream(spark, d):
    """The lines as files, one read in every batch."""
    lines = read_log_stream(spark, _shuffled_folder(spark, d), max_files=1)
    out = new_folder(spark, "outcomes")
    start_outcome_stats(lines, YEAR, out, new_folder(spark, "state"), "pcap").awaitTermination()
    return read_outcome_stats(spark, out)


def q_activity_sessions_stream(spark, d):
    """Files of mixed times, one read in every batch: no line is too late."""
    lines = read_log_stream(spark, _shuffled_folder(spark, d), max_files=1)
    parsed = logs.parse_log(lines, YEAR, "pcap").where("reason IS NULL")
    out = new_folder(spark, "slots")
    start_sessions(parsed, out, new_folder(spark, "state"), GAP_MS).awaitTermination()
    return _as_shown(read_sessions(spark, out, GAP_MS))


#: Lines of a growing file when it is whole, and of the one that is truncated.
FILE_LINES, LEFT_LINES = 5000, 100


def _written(lines: DataFrame, folder: str) -> None:
    """One file for each ``number``, replaced as a whole: its lines in order, and the
    half of its ``cut`` line without an end."""

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("line_no")
        text = "".join(v + "\n" for v in table.filter(pc.invert(table["cut"]))["value"].to_pylist())
        for v in table.filter(table["cut"])["value"].to_pylist():
            text += v[: len(v) // 2]
        files, root = filesystem(folder)
        files.create_dir(root)
        name = f"{root}/run-{table['number'][0].as_py()}.log"
        with files.open_output_stream(f"{root}/.{table['number'][0].as_py()}.part") as out:
            out.write(text.encode())
        files.move(f"{root}/.{table['number'][0].as_py()}.part", name)
        return pa.table({"lines": [table.num_rows]})

    lines.groupBy("number").applyInArrow(write, "lines long").write.format("noop").mode("overwrite").save()


def q_growing_logs_stream(spark, d):
    """Files that grow from batch to batch, cut within a line; the first is truncated
    in the end, and what is left of it is read again."""
    place = F.col("line_no") % FILE_LINES
    lines = log_input(spark, d).select(
        "value", "line_no", F.floor(F.col("line_no") / FILE_LINES).alias("number"), place.alias("place"), F.lit(False).alias("cut")
    )
    half = FILE_LINES // 2
    versions = [
        lines.where(F.col("place") <= half).withColumn("cut", F.col("place") == half),
        lines,
        lines.where((F.col("number") == 0) & (F.col("place") < LEFT_LINES)),
    ]
    folder, out, state = (new_folder(spark, n) for n in ("growing", "outcomes", "state"))
    for version in versions:
        _written(version, folder)
        start_outcome_stats(follow_logs(spark, folder), YEAR, out, state, "pcap").awaitTermination()
    return read_outcome_stats(spark, out)


def q_log_report_failures_stream(spark, d):
    """Failure logs of a stream over growing files: the text itself, by file."""
    place = F.col("line_no") % FILE_LINES
    lines = log_input(spark, d).select(
        "value", "line_no", F.floor(F.col("line_no") / FILE_LINES).alias("number"), place.alias("place"), F.lit(False).alias("cut")
    )
    half = FILE_LINES // 3
    folder, out, state = (new_folder(spark, n) for n in ("growing", "parsed", "state"))
    for version in (lines.where(F.col("place") <= half).withColumn("cut", F.col("place") == half), lines):
        _written(version, folder)
        start_log_report(follow_logs(spark, folder), YEAR, out, state, "pcap").awaitTermination()
    pieces = chains.log_report_of_stream(spark, out)["failures"]
    number = F.regexp_extract("file", r"run-(\d+)\.log$", 1).cast("long").alias("number")
    whole = pieces.groupBy("producer", "severity", number).agg(
        F.sum("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.struct("block", "segment", "log"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["log"]), "\n")
    return plain(whole.select("producer", "severity", "number", "n_lines", F.md5(text).alias("log_md5")))


def q_ended_sessions_stream(spark, d):
    """Files of mixed times, one read in every batch; sessions are told as they end
    and corrected by late lines. The last file only moves the clock on."""
    parsed = _parsed(spark, d).where("reason IS NULL").select("producer", "ts")
    folder, out, state = (new_folder(spark, n) for n in ("lines", "sessions", "state"))
    disordered = parsed.repartitionByRange(6, F.unix_micros("ts") + F.pmod(F.xxhash64("producer", "ts"), F.lit(5)) * (3 * GAP_MS * 1000))
    disordered.write.parquet(folder)
    clock = parsed.agg((F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    for rows in (None, clock.select(F.lit(None).cast("string").alias("producer"), "ts")):
        if rows is not None:
            rows.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(parsed.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        ended.start_told(ended.ended_sessions(stream, GAP_MS, keep_ms=30 * ended.KEEP_MS), out, state).awaitTermination()
    return _as_shown(ended.current_sessions(spark.read.schema(ended.SESSIONS).parquet(out)))


QUERIES = {
    "growing_logs_stream": q_growing_logs_stream,
    "log_report_failures_stream": q_log_report_failures_stream,
    "ended_sessions_stream": q_ended_sessions_stream,
    "log_report_failures": q_log_report_failures,
    "log_report_malformed": q_log_report_malformed,
    "log_report_sessions": q_log_report_sessions,
    "strip_priority": q_strip_priority,
    "extract_producer": q_extract_producer,
    "parse_log_time": q_parse_log_time,
    "rebuild_message": q_rebuild_message,
    "classify_outcome": q_classify_outcome,
    "outcome_stats": q_outcome_stats,
    "outcome_totals": q_outcome_totals,
    "failure_log": q_failure_log,
    "verdict": q_verdict,
    "run_verdict": q_run_verdict,
    "quarantine": q_quarantine,
    "activity_sessions": q_activity_sessions,
    "log_report": q_log_report,
    "log_report_verdict": q_log_report_verdict,
    "read_logs": q_read_logs,
    "outcome_stats_stream": q_outcome_stats_stream,
    "activity_sessions_stream": q_activity_sessions_stream,
}

STATS_SQL = f"WITH {LOG_SQL} SELECT * FROM stats"
TOTALS_SQL = f"""
WITH {LOG_SQL} SELECT * FROM stats
UNION ALL SELECT NULL, CAST(sum(total) AS BIGINT), CAST(sum(passed) AS BIGINT), CAST(sum(failed) AS BIGINT),
                 CAST(sum(skipped) AS BIGINT) FROM stats
"""
VERDICT_SQL = f"""
WITH {LOG_SQL}, a AS (
  SELECT CAST(sum(passed) AS BIGINT) AS passed, CAST(sum(total) AS BIGINT) AS total,
         bool_or(failed <> 0 OR total <> failed + passed + skipped) AS bad FROM stats)
SELECT passed, total, NOT bad AND (passed = 0 OR total = 0) AS nothing_ran,
       CAST(CASE WHEN bad OR passed = 0 OR total = 0 THEN -1 ELSE 0 END AS BIGINT) AS code FROM a
"""
SESSIONS_SQL = f"""
WITH {LOG_SQL},
marked AS (SELECT producer, sec, CASE WHEN sec - lag(sec) OVER w <= INTERVAL {GAP_MS} MILLISECONDS THEN 0 ELSE 1 END AS opens
           FROM parsed WHERE reason IS NULL WINDOW w AS (PARTITION BY producer ORDER BY sec)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY producer ORDER BY sec ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT producer, strftime(min(sec), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(sec), '%Y-%m-%d %H:%M:%S') AS last_ts,
       count(*) AS n_lines FROM numbered GROUP BY producer, run
"""

SQL = {
    "growing_logs_stream": STATS_SQL.replace(
        "FROM events)", f"FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id < {LEFT_LINES}))"
    ),
    "log_report_failures_stream": f"""
WITH {LOG_SQL}
SELECT p.producer, CASE WHEN s.failed > 0 THEN 'error' ELSE 'warning' END AS severity, event_id // {FILE_LINES} AS number,
       count(*) AS n_lines, md5(string_agg(message, chr(10) ORDER BY event_id)) AS log_md5
FROM parsed p JOIN stats s ON s.producer = p.producer AND (s.failed > 0 OR s.skipped > 0)
WHERE reason IS NULL GROUP BY ALL
""",
    "ended_sessions_stream": SESSIONS_SQL,
    "strip_priority": f"""
WITH {LOG_SQL}, raw AS (
  SELECT *, CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'step ' || n || ' : a : b  ' ELSE message END AS written,
         CASE kind WHEN 3 THEN 'Foo 99 10:00:00' ELSE strftime(sec, '%b %-d %H:%M:%S') END AS stamp FROM parsed)
SELECT event_id AS line_no, kind IN (0, 1) AS broken, CASE WHEN kind IN (0, 1) THEN reason END AS reason,
       CASE WHEN kind NOT IN (0, 1) THEN stamp || ' host1 ' || producer || '[42]: ' || written END AS record
FROM raw
""",
    "extract_producer": f"WITH {LOG_SQL} SELECT event_id AS line_no, producer FROM owned",
    "parse_log_time": f"""
WITH {LOG_SQL} SELECT event_id AS line_no, CASE WHEN reason IS NULL THEN strftime(sec, '%Y-%m-%d %H:%M:%S') END AS ts,
                      reason FROM parsed
""",
    "rebuild_message": f"""
WITH {LOG_SQL} SELECT event_id AS line_no, CASE WHEN reason IS NULL THEN message END AS message FROM parsed
""",
    "classify_outcome": f"""
WITH {LOG_SQL} SELECT event_id AS line_no,
  CASE WHEN reason IS NOT NULL THEN NULL WHEN event_type = 'signup' THEN 'collected' WHEN event_type = 'view' THEN 'passed'
       WHEN event_type = 'click' THEN 'failed_passed' WHEN event_type = 'purchase' THEN 'skipped'
       WHEN event_id % 2 = 0 THEN 'failed' END AS form,
  CAST(total AS BIGINT) AS total, CAST(passed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed,
  CAST(skipped AS BIGINT) AS skipped FROM outcome
""",
    "outcome_stats": STATS_SQL,
    "outcome_totals": TOTALS_SQL,
    "failure_log": f"""
WITH {LOG_SQL}
SELECT p.producer, CASE WHEN s.failed > 0 THEN 'error' ELSE 'warning' END AS severity, 'events' AS file,
       CAST(0 AS BIGINT) AS block, CAST(event_id // 500 AS BIGINT) AS segment, count(*) AS n_lines,
       string_agg(message, chr(10) ORDER BY event_id) AS log
FROM parsed p JOIN stats s ON s.producer = p.producer AND (s.failed > 0 OR s.skipped > 0)
WHERE reason IS NULL GROUP BY ALL
""",
    "verdict": f"""
WITH {LOG_SQL} SELECT *, failed <> 0 AS is_failed, total <> failed + passed + skipped AS is_inconsistent FROM stats
""",
    "run_verdict": VERDICT_SQL,
    "quarantine": f"""
WITH {LOG_SQL} SELECT producer, count(*) AS n, coalesce(reason, 'valid') AS reason FROM parsed GROUP BY ALL
""",
    "activity_sessions": SESSIONS_SQL,
    "log_report": TOTALS_SQL,
    "log_report_verdict": VERDICT_SQL,
    "log_report_failures": f"""
WITH {LOG_SQL}
SELECT p.producer, CASE WHEN s.failed > 0 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n_lines,
       CAST(sum(length(message)) AS BIGINT) AS n_chars
FROM parsed p JOIN stats s ON s.producer = p.producer AND (s.failed > 0 OR s.skipped > 0)
WHERE reason IS NULL GROUP BY ALL
""",
    "log_report_malformed": f"""
WITH {LOG_SQL} SELECT producer, reason, count(*) AS n FROM parsed WHERE reason IS NOT NULL GROUP BY ALL
""",
    "log_report_sessions": SESSIONS_SQL,
    "read_logs": STATS_SQL,
    "outcome_stats_stream": STATS_SQL,
    "activity_sessions_stream": SESSIONS_SQL,
}
