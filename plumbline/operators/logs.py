"""Test-run logs: parsing, outcome statistics, verdicts and activity sessions.

Input rows carry ``value`` (the line) and, where order matters, the columns
``file, block, line_no``. All parsing is by column expressions, so the same
functions serve batch and streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.skew import run_starts
from plumbline.plans.session import materialize

# The producer is the tester's name in front of its process id.
PRODUCER_REGEX = r"^.*\s.*\s(.*tester.*)\[\d+\]:.*$"

# Summary lines of a test run, tried in this order.
OUTCOME_PATTERNS = {
    "collected": r"^collected (\d+) item[s]?$",
    "failed": r"^=+\s+(\d+)\s+failed\s+in\s+.*=+$",
    "failed_passed": r"^=+\s+(\d+)\s+failed,\s+(\d+)\s+passed\s+in\s+.*=+$",
    "passed": r"^=+\s+(\d+)\s+passed\s+in\s+.*=+$",
    "skipped": r"^=+\s+(\d+)\s+skipped\s+in\s+.*=+$",
}

OUTCOMES = ["total", "passed", "failed", "skipped"]
ORDER = ("file", "block", "line_no")

# Slots of one gap each per segment of a key when sessions are put together.
SLOTS_PER_SEGMENT = 100_000

# Reasons of malformed lines.
NO_PREFIX = "no_priority"
OPEN_PREFIX = "open_priority"
BAD_TIME = "bad_time"

TIME_PREFIX = r"^([A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2})"


def extract_producer(df: DataFrame, regex: str = PRODUCER_REGEX, value: str = "value") -> DataFrame:
    """Lines that match the regex, with its first group as ``producer``."""
    # One anchored match at most, so one evaluation both filters and extracts.
    return df.withColumn("producer", F.explode(F.regexp_extract_all(value, F.lit(f"^(?:{regex})"), F.lit(1))))


def strip_priority(df: DataFrame, fmt: str = "raw", value: str = "value") -> DataFrame:
    """Adds ``record`` (the line without its ``<pri>`` prefix) and ``reason``.

    ``raw`` lines have no prefix. A ``pcap`` line without one, or with an
    unclosed one, keeps a NULL record and gets the reason.
    """
    line = F.col(value)
    if fmt == "raw":
        return df.withColumn("record", line).withColumn("reason", F.lit(None).cast("string"))
    if fmt != "pcap":
        raise ValueError("fmt must be 'raw' or 'pcap'")
    reason = F.when(~line.startswith("<"), NO_PREFIX).when(~line.contains(">"), OPEN_PREFIX)
    record = F.when(reason.isNull(), F.regexp_extract(line, r"(?s)^<[^>]*>(.*)$", 1))
    return df.withColumn("record", record).withColumn("reason", reason)


def drop_blank(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(F.col(value).rlike(r"\S"))


def parse_log_time(df: DataFrame, year: int, record: str = "record") -> DataFrame:
    """Adds ``ts`` and ``remainder``. Log times have no year, so it is given;
    a log over New Year needs one call per year."""
    stamped = df.withColumn("__stamp", F.regexp_extract(record, TIME_PREFIX, 1))
    stamp = F.col("__stamp")
    text = F.concat(F.lit(f"{year} "), F.initcap(F.regexp_replace(stamp, r"\s+", " ")))
    ts = F.when(stamp != "", F.try_to_timestamp(text, F.lit("yyyy MMM d H:m:s")))
    earlier = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    late = F.when(F.col(record).isNotNull() & F.col("ts").isNull(), BAD_TIME)
    remainder = F.when(F.col("ts").isNotNull(), F.substr(F.col(record), F.length(stamp) + 1))
    parsed = stamped.withColumn("ts", ts).withColumns(
        {"remainder": remainder, "reason": F.coalesce(earlier, late)}
    )
    return parsed.drop("__stamp")


def rebuild_message(df: DataFrame, remainder: str = "remainder") -> DataFrame:
    """Adds ``message``: colon-separated parts, trimmed, without the first one
    (host and producer)."""
    parts = F.transform(F.split(remainder, ":"), lambda p: F.btrim(p, F.lit(" \t\n\r\f\x0b")))
    rest = F.slice(parts, F.lit(2), F.length(remainder) + 1)  # longer than any part list
    return df.withColumn("message", F.array_join(rest, ":"))


def classify_outcome(df: DataFrame, message: str = "message") -> DataFrame:
    """Adds the counts a summary line reports: ``total, passed, failed, skipped``.

    The first matching form decides; other lines count nothing.
    """

    def group(form: str, i: int) -> Column:
        found = F.regexp_extract(message, OUTCOME_PATTERNS[form], i)
        return F.coalesce(found.try_cast("long"), F.lit(0).cast("long"))

    def matches(form: str) -> Column:
        return F.col(message).rlike(OUTCOME_PATTERNS[form])

    form = F.lit(None).cast("string")
    for name in reversed([n for n in OUTCOME_PATTERNS if n != "collected"]):
        form = F.when(matches(name), name).otherwise(form)
    # Ordinary messages are told apart by their first character.
    form = F.when(F.col(message).startswith("="), form).when(matches("collected"), "collected")
    zero = F.lit(0).cast("long")
    formed = df.withColumn("form", form)
    is_form = F.col("form")
    return formed.withColumns(
        {
            "total": F.when(is_form == "collected", group("collected", 1)).otherwise(zero),
            "passed": F.when(is_form == "passed", group("passed", 1))
            .when(is_form == "failed_passed", group("failed_passed", 2))
            .otherwise(zero),
            "failed": F.when(is_form == "failed", group("failed", 1))
            .when(is_form == "failed_passed", group("failed_passed", 1))
            .otherwise(zero),
            "skipped": F.when(is_form == "skipped", group("skipped", 1)).otherwise(zero),
        }
    )


def parse_log(
    lines: DataFrame, year: int, fmt: str = "raw", regex: str = PRODUCER_REGEX
) -> DataFrame:
    """All parsing steps in order. Malformed lines stay, with a ``reason``."""
    owned = extract_producer(drop_blank(lines), regex)
    return classify_outcome(rebuild_message(parse_log_time(strip_priority(owned, fmt), year)))


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and malformed lines with their reason."""
    bad = parsed.where(F.col("reason").isNotNull())
    return parsed.where(F.col("reason").isNull()), bad.select("producer", "value", "reason")


def outcome_stats(parsed: DataFrame) -> DataFrame:
    """Counts per producer. A producer with malformed lines only still shows."""
    return parsed.groupBy("producer").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in OUTCOMES])


def outcome_totals(stats: DataFrame) -> DataFrame:
    """The per-producer rows plus one with ``producer`` NULL for all of them."""
    return stats.rollup("producer").agg(*[F.sum(c).alias(c) for c in OUTCOMES])


def failure_log(
    parsed: DataFrame, lines_per_segment: int = 1000, order: Sequence[str] = ORDER
) -> DataFrame:
    """Messages of the producers that failed (``error``) or skipped (``warning``).

    One row per stretch of at most ``lines_per_segment`` input lines, in order
    of ``file, block, segment``; concatenated they are the producer's whole log.
    """
    file, block, line_no = order
    stats = outcome_stats(parsed)
    bad = stats.where("failed > 0 or skipped > 0").select(
        "producer", F.when(F.col("failed") > 0, "error").otherwise("warning").alias("severity")
    )
    segment = F.floor(F.col(line_no) / F.lit(lines_per_segment)).cast("long")
    # Only the messages of these producers are shuffled and gathered.
    valid = parsed.where(F.col("reason").isNull()).join(bad.select("producer"), "producer", "left_semi")
    pieces = (
        valid.groupBy("producer", file, block, segment.alias("segment"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col("message")))).alias("m"))
    )
    text = F.array_join(F.transform("m", lambda m: m["message"]), "\n")
    return pieces.join(bad, "producer").select(
        "producer", "severity", file, block, "segment", F.size("m").alias("n_lines"), text.alias("log")
    )


def verdict(stats: DataFrame) -> DataFrame:
    """Per-producer flags: failed tests, and a total that does not add up."""
    return stats.withColumns(
        {
            "is_failed": F.col("failed") != 0,
            "is_inconsistent": F.col("total") != F.col("failed") + F.col("passed") + F.col("skipped"),
        }
    )


def run_verdict(stats: DataFrame) -> DataFrame:
    """One row for the run: it fails on any failed or inconsistent producer, and
    when no test passed or none was collected."""
    flagged = verdict(stats)
    summed = flagged.agg(
        F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.bool_or(F.col("is_failed") | F.col("is_inconsistent")), F.lit(False)).alias("any_bad"),
    )
    nothing = (F.col("passed") == 0) | (F.col("total") == 0)
    code = F.when(F.col("any_bad") | nothing, -1).otherwise(0)
    return summed.select("passed", "total", (~F.col("any_bad") & nothing).alias("nothing_ran"), code.alias("code"))


def activity_slots(
    parsed: DataFrame, gap_ms: int = 60_000, keys: Sequence[str] = ("producer",), ts: str = "ts"
) -> DataFrame:
    """Lines folded into slots one gap wide: ``slot, low, high, n_lines`` per key.

    Lines of one slot are always closer than the gap, so only slot boundaries can
    split a session. Slots of several batches may be put together in any order.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(micros / F.lit(gap_ms * 1000)).cast("long").alias("slot")
    return (
        parsed.where(F.col(ts).isNotNull())
        .groupBy(*keys, slot)
        .agg(F.min(micros).alias("low"), F.max(micros).alias("high"), F.count(F.lit(1)).alias("n_lines"))
    )


def sessions_of_slots(slots: DataFrame, gap_ms: int = 60_000, keys: Sequence[str] = ("producer",)) -> DataFrame:
    """Runs of activity that end after more than ``gap_ms`` of silence."""
    keys = list(keys)
    whole = slots.groupBy(*keys, "slot").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_lines").alias("n_lines")
    )
    whole = materialize(whole, "slots")
    marked = run_starts(whole, keys, "slot", "low", "high", gap_ms * 1000, SLOTS_PER_SEGMENT, "__session")
    folded = marked.groupBy(*keys, "__session").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_lines").alias("n_lines")
    )
    return folded.select(
        *keys,
        F.timestamp_micros("low").alias("first_ts"),
        F.timestamp_micros("high").alias("last_ts"),
        "n_lines",
    )


def activity_sessions(
    parsed: DataFrame, gap_ms: int = 60_000, keys: Sequence[str] = ("producer",), ts: str = "ts"
) -> DataFrame:
    """Runs of activity per key. A busy producer shrinks to one row per slot
    before anything is ordered."""
    return sessions_of_slots(activity_slots(parsed, gap_ms, keys, ts), gap_ms, keys)
