import datetime
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from plumbline.operators import catalog
from plumbline.streaming.probes import read_timeouts, start_probes, start_responses
from plumbline.streaming.updates import start_reject_stale

ATTRIBUTES = [
    ("the string that has no parameters", "=", "dflt", "dflt"),
    ("SESSION_ID=FOUND", "=", "", "FOUND"),
    ("SESSION_ID_VALUE=NOT", "=", "dflt", "dflt"),
    ("SESSION_ID:with_colon", ":", "", "with_colon"),
    ("SESSION_ID=first OTHER=x", "=", "", "first"),
    ("OTHER=x SESSION_ID=second", "=", "", "second"),
    ("OTHER:x SESSION_ID:mixed", ":", "", "mixed"),
    ("OTHER=x SESSION_ID:v", "-", "dflt", "dflt"),
    ("SESSION_ID= SESSION_ID=late", "=", "dflt", "dflt"),
    ("SESSION_ID=a=b", "=", "", "a"),
    ("SESSION_ID=one SESSION_ID=two", "=", "", "one"),
]


@pytest.mark.parametrize("line, delim, default, expected", ATTRIBUTES)
def test_extract_attr(spark, line, delim, default, expected):
    df = spark.createDataFrame([(line,)], "line string")
    assert catalog.extract_attr(df, "SESSION_ID", default, delim).first().attr == expected


def test_effective_params(spark):
    documents = spark.createDataFrame(
        [("q", {"-a": "1", "--b": "2", "c": "x y", "NO_NAME_PARAM.0": "pos"})], "query string, params map<string,string>")
    lines = {
        "bbb": ("1", "2", "x y", "pos"),
        "-a=9 --b=8 -a=7 unknown=1": ("7", "8", "x y", "pos"),
        "x-a=9 NO_NAME_PARAM.0=z c=": ("1", "2", "", "pos"),
        "-a=5=6": ("5", "2", "x y", "pos"),
    }
    requests = spark.createDataFrame([("q", line) for line in lines] + [("other", "-a=1")], "query string, line string")
    done = catalog.effective_params(requests, documents)
    assert rows(done.where("reason IS NOT NULL"), "query", "params", "reason") == [("other", None, "undeclared")]
    found = {r.line: r.params for r in done.where("reason IS NULL").collect()}
    assert {k: tuple(v[n] for n in ("-a", "--b", "c", "NO_NAME_PARAM.0")) for k, v in found.items()} == lines


@pytest.mark.parametrize("line, expected", [("a b c d", "a=b c=d"), ("a b c", "a=b c"), ("a", "a"), ("a  b", "a= b"), ("", "")])
def test_pair_args(spark, line, expected):
    df = spark.createDataFrame([(line,)], "line string")
    assert catalog.pair_lines(df).first().paired == expected
    assert "".join(_even_blanks(line)) == expected


def _even_blanks(line):
    blanks = 0
    for char in line:
        if char == " ":
            char, blanks = ("=" if blanks % 2 == 0 else " "), blanks + 1
        yield char


def test_dependencies_and_unmet(spark):
    required = spark.createDataFrame(
        [("svc_a", "r1", "+/x"), ("svc_a", "r2", "root/y"), ("svc_b", "r1", "root/z")], "service string, name string, query string")
    assert catalog.dependencies(required, "svc_a").count() == 2
    assert catalog.dependencies(required, "svc").count() == 3  # matches from the start of the name
    assert catalog.dependencies(required, "b").count() == 0
    resolved = catalog.resolve_queries(required)
    assert rows(resolved, "query") == [("root/y",), ("root/z",), ("svc_a/x",)]
    available = spark.createDataFrame([("svc_a/x",), ("svc_a/x",), ("root/z",)], "query string")
    assert rows(catalog.unmet_dependencies(resolved, available), "service", "name") == [("svc_a", "r2")]


def test_latest_request(spark):
    data = [("q", "s", 1, "old"), ("q", "s", 3, "new"), ("q", "t", 2, "only"), ("p", "s", 9, "p")]
    df = spark.createDataFrame(data, "query string, session string, ts long, line string")
    assert rows(catalog.latest_request(df), "query", "session", "line") == [("p", "s", "p"), ("q", "s", "new"), ("q", "t", "only")]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a",), ("b",), ("b",)], "q string")
    new = spark.createDataFrame([("b",), ("c",)], "q string")
    diff = catalog.snapshot_diff(old, new)
    assert rows(diff) == [("a", "removed"), ("b", "same"), ("c", "added")]
    assert not catalog.same_set(diff).first().same_set
    assert catalog.same_set(catalog.snapshot_diff(new, new)).first().same_set


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def test_probe_timeouts_against_brute_force(spark):
    rng = random.Random(5)
    probes = [(i, f"t{rng.randrange(4)}", rng.randrange(200_000)) for i in range(300)]
    answers = [(f"t{rng.randrange(4)}", rng.randrange(200_000)) for _ in range(120)]
    probes += [(900, "edge", 1000), (901, "edge", 999), (902, "none", 5)]
    answers += [("edge", 6000)]
    expected = {i for i, tag, t in probes if not any(a == tag and t <= r <= t + 5000 for a, r in answers)}
    sent = spark.createDataFrame([(i, tag, at(t)) for i, tag, t in probes], "id long, tag string, ts timestamp")
    got = spark.createDataFrame([(tag, at(t)) for tag, t in answers], "tag string, ts timestamp")
    assert {r.id for r in catalog.probe_timeouts(sent, got, 5000).collect()} == expected
    assert 901 in expected and 900 not in expected


def test_probe_stream(spark, tmp_path):
    sent = spark.createDataFrame([(1, "a", at(9_000_000)), (2, "b", at(0)), (3, "a", at(0))], "id long, tag string, ts timestamp")
    got = spark.createDataFrame([("a", at(9_004_000)), ("b", at(6000)), ("a", at(4000))], "tag string, ts timestamp")
    names = {n: str(tmp_path / n) for n in ("sent", "got", "probes", "slots", "c1", "c2")}
    for n in range(3):  # the latest come first
        sent.where(F.col("id") == n + 1).write.mode("append").parquet(names["sent"])
        got.limit(n + 1).write.mode("append").parquet(names["got"])
        stream = spark.readStream.schema(sent.schema).parquet(names["sent"])
        start_probes(stream, names["probes"], names["c1"]).awaitTermination()
        stream = spark.readStream.schema(got.schema).parquet(names["got"])
        start_responses(stream, names["slots"], names["c2"]).awaitTermination()
    assert rows(read_timeouts(spark, names["probes"], names["slots"]), "id") == [(2,)]


def test_stale_stream_keeps_state_over_restarts(spark, tmp_path):
    folder, out, state, check = (str(tmp_path / n) for n in ("in", "out", "state", "check"))
    schema = "series_id string, ts long, arrival long"

    def send(*data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        start_reject_stale(stream, out, state, check).awaitTermination()

    send(("s", 10, 1), ("s", 9, 2))
    send(("s", 10, 3), ("t", 1, 4))
    send(("s", 11, 5), ("t", 1, 6), ("t", 2, 7))
    assert rows(spark.read.parquet(out), "arrival", "accepted") == [
        (1, True), (2, False), (3, False), (4, True), (5, True), (6, False), (7, True)]
