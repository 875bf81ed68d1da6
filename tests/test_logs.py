import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.operators import logs
from plumbline.plans import chains
from plumbline.sources.files import read_logs
from plumbline.streaming.logs import (
    read_log_stream,
    read_outcome_stats,
    read_sessions,
    start_outcome_stats,
    start_quarantine,
    start_sessions,
)

HOST = "host1 a_tester[7]:"
LINES = [
    f"<13>Jan  5 10:00:00 {HOST} collected 5 items",
    f"<13>Jan  5 10:00:01 {HOST} ==== 2 failed, 1 passed in 3.1s ====",
    f"<13>Jan  5 10:00:02 {HOST} === 1 failed in 1s ===",
    f"<13>Jan  5 10:00:03 {HOST} === 1 passed in 1s ===",
    f"<13>Jan 05 10:05:00 {HOST} === 1 skipped in 1s ===",
    f"<13>Jan  5 10:05:01 {HOST} === 1 passed, 1 skipped in 1s ===",
    f"<13>Jan  5 10:05:02 {HOST} step :  a : b\t",
    f"Jan  5 10:05:03 {HOST} no prefix",
    f"<13Jan  5 10:05:03 {HOST} open prefix",
    f"<13>Foo  5 10:05:03 {HOST} bad time",
    f"<13>Feb 30 10:05:03 {HOST} no such day",
    "<13>Jan  5 10:05:03 host1 daemon[7]: ignored",
    "   ",
    "<13>Jan  5 10:06:00 host1 b_tester[9]: collected 1 item",
    "<13>Jan  5 10:06:01 host1 b_tester[9]: = 1 passed in 1s =",
]


def lines_of(spark, lines=LINES):
    data = [(v, "log", 0, i) for i, v in enumerate(lines)]
    return spark.createDataFrame(data, "value string, file string, block long, line_no long")


@pytest.fixture()
def parsed(spark):
    return logs.parse_log(lines_of(spark), 2024, "pcap")


def test_parse(parsed):
    found = {r.line_no: r for r in parsed.collect()}
    assert set(found) == set(range(11)) | {13, 14}
    assert found[0].producer == "a_tester" and found[0].ts == datetime.datetime(2024, 1, 5, 10, 0, 0)
    assert found[6].message == "step:a:b"
    assert [found[i].reason for i in (7, 8, 9, 10)] == [logs.NO_PREFIX, logs.OPEN_PREFIX, logs.BAD_TIME, logs.BAD_TIME]
    assert [(found[i].total, found[i].passed, found[i].failed, found[i].skipped) for i in range(7)] == [
        (5, 0, 0, 0), (0, 1, 2, 0), (0, 0, 1, 0), (0, 1, 0, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_raw_lines_have_no_prefix(spark):
    raw = lines_of(spark, [f"Jan 15 10:00:00 {HOST} collected 3 items", f"<13>Jan 15 10:00:00 {HOST} x"])
    assert rows(logs.parse_log(raw, 2024), "total", "reason") == [(0, logs.BAD_TIME), (3, None)]
    with pytest.raises(ValueError):
        logs.strip_priority(raw, "other")


def test_stats_and_verdict(parsed):
    stats = logs.outcome_stats(parsed)
    assert rows(stats) == [("a_tester", 5, 2, 3, 1), ("b_tester", 1, 1, 0, 0)]
    assert rows(logs.outcome_totals(stats)) == [("a_tester", 5, 2, 3, 1), ("b_tester", 1, 1, 0, 0), (None, 6, 3, 3, 1)]
    assert rows(logs.verdict(stats), "producer", "is_failed", "is_inconsistent") == [
        ("a_tester", True, True), ("b_tester", False, False)]
    assert logs.run_verdict(stats).first().code == -1
    good = logs.run_verdict(stats.where("producer = 'b_tester'")).first()
    assert (good.code, good.nothing_ran) == (0, False)
    nothing = logs.run_verdict(stats.where("total > 99")).first()
    assert (nothing.code, nothing.nothing_ran) == (-1, True)


def test_producer_with_malformed_lines_only_is_reported(spark):
    parsed = logs.parse_log(lines_of(spark, [f"Jan 5 10:00:00 {HOST} x"]), 2024, "pcap")
    assert rows(logs.outcome_stats(parsed)) == [("a_tester", 0, 0, 0, 0)]


def test_failure_log(parsed):
    pieces = logs.failure_log(parsed, lines_per_segment=3)
    assert rows(pieces.select("producer", "severity").distinct()) == [("a_tester", "error")]
    texts = [r.log for r in pieces.orderBy("file", "block", "segment").collect()]
    assert len(texts) == 3 and "\n".join(texts).split("\n")[0] == "collected 5 items"
    assert "\n".join(texts).split("\n")[-1] == "step:a:b"


def test_quarantine(parsed):
    valid, malformed = logs.quarantine(parsed)
    assert (valid.count(), malformed.count()) == (9, 4)


def test_sessions(spark, parsed):
    sessions = logs.activity_sessions(parsed, 60_000)
    assert rows(sessions, "producer", F.date_format("first_ts", "mm:ss"), F.date_format("last_ts", "mm:ss"), "n_lines") == [
        ("a_tester", "00:00", "00:03", 4), ("a_tester", "05:00", "05:02", 3), ("b_tester", "06:00", "06:01", 2)]


def test_folder_report(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "one.log").write_text("\n".join(LINES[:7]) + "\n")
    (folder / "two.log").write_text("\n".join(LINES[7:]) + "\n")
    report = chains.log_report_of_folder(spark, str(folder), 2024, "pcap")
    assert rows(report["stats"]) == [("a_tester", 5, 2, 3, 1), ("b_tester", 1, 1, 0, 0)]
    assert report["malformed"].count() == 4 and report["verdict"].first().code == -1
    assert report["failures"].first().log.split("\n")[0] == "collected 5 items"
    assert read_logs(spark, str(folder)).select("file").distinct().count() == 2


def test_streams_equal_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    closing = "<13>Jan  9 00:00:00 host1 z_tester[1]: end"
    (folder / "one.log").write_text("\n".join(LINES[:6]) + "\n")
    (folder / "two.log").write_text("\n".join(LINES[6:] + [closing]) + "\n")
    batch = logs.parse_log(lines_of(spark, LINES), 2024, "pcap")
    lines = read_log_stream(spark, str(folder), max_files=1)

    counts = str(tmp_path / "counts")
    start_outcome_stats(lines, 2024, counts, str(tmp_path / "c1"), "pcap").awaitTermination()
    assert rows(read_outcome_stats(spark, counts).where("producer <> 'z_tester'")) == rows(logs.outcome_stats(batch))

    valid, bad = str(tmp_path / "valid"), str(tmp_path / "bad")
    start_quarantine(lines, 2024, valid, bad, str(tmp_path / "c2"), "pcap").awaitTermination()
    assert rows(spark.read.parquet(bad), "value", "reason") == rows(logs.quarantine(batch)[1], "value", "reason")
    assert spark.read.parquet(valid).count() == 10

    (folder / "three.log").write_text(LINES[13] + "\n")  # a restart reads only the new file
    start_quarantine(lines, 2024, valid, bad, str(tmp_path / "c2"), "pcap").awaitTermination()
    assert spark.read.parquet(valid).count() == 11

    parsed = logs.parse_log(read_log_stream(spark, str(folder)), 2024, "pcap").where("reason IS NULL")
    slots = str(tmp_path / "slots")
    start_sessions(parsed, slots, str(tmp_path / "c3"), 60_000).awaitTermination()
    # Lines older than all that were read before count like any others.
    late = "<13>Jan  1 00:00:00 host1 a_tester[1]: early"
    (folder / "four.log").write_text(late + "\n")
    start_sessions(parsed, slots, str(tmp_path / "c3"), 60_000).awaitTermination()
    again = logs.parse_log(lines_of(spark, LINES + [LINES[13], late]), 2024, "pcap")
    found = read_sessions(spark, slots, 60_000)
    assert rows(found.where("producer <> 'z_tester'")) == rows(logs.activity_sessions(again))
