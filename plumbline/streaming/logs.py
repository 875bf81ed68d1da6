"""Log folders as streams.

Files must appear whole and not grow: a logger that rotates its files fits. The
checkpoint of the query remembers which files were read, so a restart resumes
there; truncated or rewritten files count only under a new name.

A folder that is read from the start holds old files in any order, so nothing
here depends on a watermark and no line comes too late: a batch writes what its
lines add (counts, slots of activity) into a part of its own, and the readers put
the parts together. A repeated batch overwrites its part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.logs import OUTCOMES, activity_slots, outcome_stats, parse_log, quarantine, sessions_of_slots
from plumbline.sources.files import log_lines


def read_log_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of the files that appear in ``folder``: ``value, file, block``."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return log_lines(reader.text(folder))


def each_part(
    df: DataFrame, part: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict
) -> StreamingQuery:
    """Writes ``part(batch)`` of every micro-batch into its own subfolder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return each_batch(df, write, checkpoint, trigger)


def start_sessions(parsed: DataFrame, path: str, checkpoint: str, gap_ms: int, **trigger) -> StreamingQuery:
    """Keeps the slots of activity of a stream in ``path``; see ``read_sessions``."""
    return each_part(parsed, lambda batch: activity_slots(batch, gap_ms), path, checkpoint, trigger)


def read_sessions(spark: SparkSession, path: str, gap_ms: int) -> DataFrame:
    """The sessions of all lines that the stream has read."""
    return sessions_of_slots(spark.read.parquet(path).drop("batch"), gap_ms)


def start_outcome_stats(
    lines: DataFrame, year: int, path: str, checkpoint: str, fmt: str = "raw", **trigger
) -> StreamingQuery:
    """Keeps counts per producer in ``path``; see ``read_outcome_stats``."""
    return each_part(parse_log(lines, year, fmt), outcome_stats, path, checkpoint, trigger)


def read_outcome_stats(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all lines that the stream has read."""
    return spark.read.parquet(path).groupBy("producer").agg(*[F.sum(c).alias(c) for c in OUTCOMES])


def start_log_report(
    lines: DataFrame, year: int, path: str, checkpoint: str, fmt: str = "raw", **trigger
) -> StreamingQuery:
    """Keeps the parsed lines of a stream (``follow_logs`` gives their place) in
    ``path``, a part for each batch; see ``chains.log_report_of_stream``."""
    return each_part(parse_log(lines, year, fmt), lambda batch: batch, path, checkpoint, trigger)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """The parsed lines that a stream has read so far. Lines of a file come by batch and
    place, which is their order even if the file was truncated in between."""
    return spark.read.parquet(path).withColumn("block", F.col("batch").cast("long")).drop("batch")


def start_quarantine(
    lines: DataFrame,
    year: int,
    valid_path: str,
    malformed_path: str,
    checkpoint: str,
    fmt: str = "raw",
    **trigger,
) -> StreamingQuery:
    """Splits a stream into valid records and malformed lines, two folders."""

    def split(batch: DataFrame, batch_id: int) -> None:
        valid, malformed = quarantine(batch)
        valid.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        malformed.write.mode("overwrite").parquet(f"{malformed_path}/batch={batch_id}")

    return each_batch(parse_log(lines, year, fmt), split, checkpoint, trigger)


def each_batch(
    df: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
