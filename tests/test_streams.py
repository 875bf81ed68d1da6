"""Growing files, and what is told when its time is up."""

import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.operators import catalog, logs
from plumbline.operators.series import reject_stale
from plumbline.plans import chains
from plumbline.sources.growing import GrowingFilesReader, follow_logs
from plumbline.streaming import ended
from plumbline.streaming.logs import start_log_report
from plumbline.streaming.updates import WHOLE_EVERY, start_reject_stale

GAP_MS = 60_000


# Growing files


def read_once(spark, folder, out, state, part=5):
    lines = follow_logs(spark, folder, part=part)
    writer = lines.writeStream.format("parquet").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()


def test_lines_of_growing_files(spark, tmp_path):
    """Appended, cut in mid-line, truncated and replaced files; ranges of a few bytes;
    every read is a restart."""
    folder, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    (folder / "deep").mkdir(parents=True)
    long = "x" * 50
    (folder / "a.log").write_text("one\ntwo\nthr")
    (folder / "deep" / "b.log").write_bytes(f"x1\r\n\n{long}\nbad \xff\n".encode("latin1"))
    (folder / "c.log").write_text("never finished")
    (folder / ".hidden").write_text("no\n")

    def found():
        got = spark.read.parquet(out).select(F.element_at(F.split("file", "/"), -1), "line_no", "value").collect()
        return sorted(map(tuple, got))

    read_once(spark, str(folder), out, state)
    first = [("a.log", 0, "one"), ("a.log", 4, "two"), ("b.log", 0, "x1"), ("b.log", 4, ""), ("b.log", 5, long), ("b.log", 56, "bad �")]
    assert found() == first
    with (folder / "a.log").open("a") as file:
        file.write("ee\nfour\nfi")
    read_once(spark, f"file:{folder}", out, state)
    second = first + [("a.log", 8, "three"), ("a.log", 14, "four")]
    assert found() == sorted(second)
    (folder / "a.log").write_text("one\n")  # truncated
    (folder / "deep" / "b.log").write_text("another file\n" * 20)  # replaced by a longer one
    read_once(spark, str(folder), out, state)
    third = second + [("a.log", 0, "one")] + [("b.log", 13 * i, "another file") for i in range(20)]
    assert found() == sorted(third)
    read_once(spark, str(folder), out, state)
    assert found() == sorted(third)


def test_long_lines_belong_to_one_range(tmp_path):
    (tmp_path / "a.log").write_text("ab\n" + "y" * 300_000 + "\nend\n")
    reader = GrowingFilesReader(str(tmp_path), part=70_000)
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) == 5
    got = [line for part in parts for batch in reader.read(part) for line in batch.column(0).to_pylist()]
    assert [len(line) for line in got] == [2, 300_000, 3]


def test_folder_without_files(tmp_path):
    assert GrowingFilesReader(str(tmp_path / "none")).latestOffset() == {}
    (tmp_path / "a.log").write_text("")
    assert GrowingFilesReader(str(tmp_path)).latestOffset() == {}


# Sessions and probes


def put(spark, folder, data, schema):
    """One more file; times are seconds."""
    df = spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_micros((F.col("sec") * 1_000_000).cast("long")))
    df.drop("sec").coalesce(1).write.mode("append").parquet(folder)


def told(spark, build, folder, out, state, schema):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = ended.start_told(build(stream), out, state)
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_are_told_once_and_corrected(spark, tmp_path, seed):
    rng = random.Random(seed)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    data = [(f"p{rng.randrange(3)}", 1_700_000_000 + rng.randrange(40_000) / 4) for _ in range(400)]
    data.append((None, 1_700_000_500.0))
    data.sort(key=lambda r: r[1] + rng.choice([0, 0, 0, 4000]))
    for i in range(0, len(data), 80):
        put(spark, folder, data[i : i + 80], "producer string, sec double")

    def run():
        build = lambda s: ended.ended_sessions(s, GAP_MS)
        return told(spark, build, folder, out, state, "producer string, ts timestamp")

    assert run() > 0
    put(spark, folder, [(None, 1_800_000_000.0)], "producer string, sec double")
    assert run() == 0, "no state is left once the clock has moved on"
    rows_told = spark.read.schema(ended.SESSIONS).parquet(out)
    assert rows_told.where("revision > 0").count() > 0, "late lines corrected something"
    batch = spark.read.parquet(folder).where("producer IS NOT NULL")
    assert rows(ended.current_sessions(rows_told)) == rows(logs.activity_sessions(batch, GAP_MS))
    assert rows_told.groupBy("producer", "first_ts", "revision").count().where("count > 1").count() == 0


def test_a_session_is_told_when_its_silence_has_passed(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "producer string, sec double"
    seen = []
    # The clock of a batch is what the batches before have seen.
    for part in ([("a", 0.0), ("a", 60.0)], [("b", 119.0)], [("b", 120.0)], [("b", 121.0)], [("a", 61.0)]):
        put(spark, folder, part, schema)
        told(spark, lambda s: ended.ended_sessions(s, GAP_MS), folder, out, state, "producer string, ts timestamp")
        seen.append(spark.read.schema(ended.SESSIONS).parquet(out).count())
    assert seen == [0, 0, 0, 1, 1]
    put(spark, folder, [(None, 1000.0)], schema)
    told(spark, lambda s: ended.ended_sessions(s, GAP_MS), folder, out, state, "producer string, ts timestamp")
    final = spark.read.schema(ended.SESSIONS).parquet(out)
    assert rows(final, "producer", F.unix_seconds("last_ts"), "n_lines", "revision", F.size("replaces")) == [
        ("a", 60, 2, 0, 0), ("a", 61, 3, 1, 1), ("b", 121, 3, 0, 0)]
    assert rows(ended.current_sessions(final), "producer", "n_lines") == [("a", 3), ("b", 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_unanswered_probes(spark, tmp_path, seed):
    rng = random.Random(seed)
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    data = [
        (f"t{rng.randrange(3)}", str(i) if rng.random() < 0.6 else None, 1_700_000_000 + rng.randrange(4_000) / 4)
        for i in range(300)
    ]
    data.sort(key=lambda r: r[2] + rng.choice([0, 0, 300]))
    schema = "tag string, probe string, sec double"
    for i in range(0, len(data), 75):
        put(spark, folder, data[i : i + 75], schema)

    def run():
        build = lambda s: ended.unanswered_stream(s, 5000)
        return told(spark, build, folder, out, state, "tag string, probe string, ts timestamp")

    run()
    put(spark, folder, [(None, None, 1_800_000_000.0)], schema)
    assert run() == 0
    rows_told = spark.read.schema(ended.PROBES).parquet(out)
    assert rows_told.where("answered").count() > 0, "late responses corrected something"
    both = spark.read.parquet(folder).where("tag IS NOT NULL")
    expected = catalog.probe_timeouts(both.where("probe IS NOT NULL"), both.where("probe IS NULL"), 5000)
    assert rows(ended.current_unanswered(rows_told), "tag", "probe", "ts") == rows(expected, "tag", "probe", "ts")


def test_settings_stay(spark):
    before = spark.conf.get(ended.PROVIDER)
    with ended.setting(spark, ended.PROVIDER, "x"), ended.setting(spark, "plumbline.none", "y"):
        assert spark.conf.get(ended.PROVIDER) == "x"
    assert spark.conf.get(ended.PROVIDER) == before and spark.conf.get("plumbline.none", None) is None


def test_versions_of_a_stream_do_not_pile_up(spark, tmp_path):
    """Many batches: a bounded number of folders, and marks as one batch gives them."""
    folder, out, state, check = (str(tmp_path / n) for n in ("in", "out", "state", "check"))
    data = [(f"s{i % 3}", (i * 7) % 23, i) for i in range(76)]
    schema = "series_id string, ts long, arrival long"
    for i in range(0, len(data), 2):
        spark.createDataFrame(data[i : i + 2], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    start_reject_stale(stream, out, state, check).awaitTermination()
    assert len(os.listdir(out)) >= 38
    assert len([f for f in os.listdir(state) if f.startswith("version")]) <= 2 * WHOLE_EVERY
    marked = spark.read.parquet(out)
    assert rows(marked, "series_id", "arrival", "accepted") == rows(
        reject_stale(spark.createDataFrame(data, schema)), "series_id", "arrival", "accepted"
    )


def test_failures_of_a_running_stream(spark, tmp_path):
    """What a stream has kept gives the whole report, in the order of the lines."""
    folder, out, state = tmp_path / "logs", str(tmp_path / "parsed"), str(tmp_path / "state")
    folder.mkdir()
    host = "<13>Jan  5 10:00:0{} host1 a_tester[7]: {}\n"
    texts = ["collected 3 items", "step : a", "= 1 failed, 2 passed in 1s =", "bye"]
    for number, text in enumerate(texts):
        with (folder / "one.log").open("a") as file:
            file.write(host.format(number, text) + "<13>Jan  5 10:00:00 host1 a_tes")
        start_log_report(follow_logs(spark, str(folder)), 2024, out, state, "pcap").awaitTermination()
        with (folder / "one.log").open("a") as file:
            file.write("ter[7]: more\n")
    report = chains.log_report_of_stream(spark, out)
    pieces = report["failures"].orderBy("file", "block", "segment").collect()
    assert "\n".join(p.log for p in pieces).split("\n") == [
        "collected 3 items", "more", "step:a", "more", "= 1 failed, 2 passed in 1s =", "more", "bye"]
    assert rows(report["stats"]) == [("a_tester", 3, 2, 1, 0)]


def test_probes_of_many_tags_share_a_state(spark, tmp_path):
    """More tags than shares: each is answered by its own responses, early, late or never,
    a tag's repeated probe counts once, and the state has no key for each tag."""
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema, start = "tag string, probe string, sec double", 1_700_000_000
    n = 200
    put(spark, folder, [(f"t{i}", str(i), start + i / n) for i in range(n)] * 2, schema)
    put(spark, folder, [(f"t{i}", None, start + i / n + 4) for i in range(0, n, 4)], schema)
    for tick in (100.0, 101.0):  # the rest is told, as the clock of a batch is what those before have seen
        put(spark, folder, [(None, None, start + tick)], schema)
    put(spark, folder, [(f"t{i}", None, start + i / n + 4) for i in range(1, n, 4)], schema)  # late, but given in time
    put(spark, folder, [(f"t{i}", None, start + i / n + 6) for i in range(2, n, 4)], schema)  # no answers in time

    def run():
        build = lambda s: ended.unanswered_stream(s, 5000)
        return told(spark, build, folder, out, state, "tag string, probe string, ts timestamp")

    run()
    keys = spark.read.format("statestore").option("stateVarName", "held").load(state).select("key.share", "key.slot")
    assert 0 < keys.distinct().count() <= 3 * 16 < n
    put(spark, folder, [(None, None, start + 1e6)], schema)
    assert run() == 0
    rows_told = spark.read.schema(ended.PROBES).parquet(out)
    assert rows(rows_told.where("answered"), "probe") == sorted([(str(i),) for i in range(1, n, 4)], key=repr)
    left = [(f"t{i}", str(i)) for i in range(n) if i % 4 in (2, 3)]
    assert rows(ended.current_unanswered(rows_told), "tag", "probe") == sorted(left, key=repr)
