"""Keep-alive probes and their responses as two streams.

Either may be late or out of order: the streams only keep what arrived, probes as
they are and responses as one row per tag and slot of time, and the check reads
both. A hot tag is spread over its slots, and no probe is paired with every
response.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.catalog import response_slots, unanswered_probes
from plumbline.streaming.logs import each_part


def start_probes(probes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the probes in ``path``."""
    return each_part(probes, lambda batch: batch, path, checkpoint, trigger)


def start_responses(responses: DataFrame, path: str, checkpoint: str, timeout_ms: int = 5000, **trigger) -> StreamingQuery:
    """Keeps the slots of the responses in ``path``."""
    return each_part(responses, lambda batch: response_slots(batch, timeout_ms), path, checkpoint, trigger)


def read_timeouts(spark: SparkSession, probes_path: str, responses_path: str, timeout_ms: int = 5000) -> DataFrame:
    """Probes without a response of the same tag within the timeout, among all
    that the streams have read."""
    probes = spark.read.parquet(probes_path).drop("batch")
    return unanswered_probes(probes, spark.read.parquet(responses_path), timeout_ms)
