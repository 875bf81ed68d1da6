"""Series updates as a stream: stale ones are told apart from fresh ones."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.series import reject_stale
from plumbline.sources.growing import filesystem
from plumbline.streaming.logs import each_batch

#: Batches whose changes are read together; then one version holds all series.
WHOLE_EVERY = 16


def start_reject_stale(
    updates: DataFrame,
    out_path: str,
    state_path: str,
    checkpoint: str,
    key: str = "series_id",
    ts: str = "ts",
    arrival: str = "arrival",
    **trigger,
) -> StreamingQuery:
    """Writes every update with ``accepted`` and keeps each series' last timestamp.

    The last timestamps are a table in ``state_path``, one version per batch: the
    series that it changed, and every ``WHOLE_EVERY`` batches all of them, so that
    a batch reads a bounded number of versions; older ones are removed. A batch uses the same code as ``reject_stale``: within it a busy series
    is cut into segments instead of being sorted by one task. Results and state
    of a batch are overwritten when it is repeated, which makes it idempotent.
    ``checkpoint`` and ``state_path`` belong together: renew both or neither.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Batches are numbered without gaps, and one starts after the last is done.
        last = None
        if batch_id:
            first = (batch_id - 1) // WHOLE_EVERY * WHOLE_EVERY
            versions = [f"{state_path}/version={n}" for n in range(first, batch_id)]
            last = spark.read.parquet(*versions).groupBy(key).agg(F.max("last_ts").alias("last_ts"))
        marked = reject_stale(batch, key, ts, arrival, last)
        marked.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        seen = batch.select(key, F.col(ts).alias("last_ts"))
        if last is not None and batch_id % WHOLE_EVERY == 0:
            seen = seen.unionByName(last)
        forget_versions(state_path, (batch_id - 1) // WHOLE_EVERY * WHOLE_EVERY)
        newest = seen.groupBy(key).agg(F.max("last_ts").alias("last_ts"))
        newest.write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")

    return each_batch(updates, apply, checkpoint, trigger)


def forget_versions(state_path: str, before: int) -> None:
    """Remove the versions that no batch will read again, not even a repeated one."""
    files, root = filesystem(state_path)
    for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        number = info.base_name.removeprefix("version=")
        if info.type == fs.FileType.Directory and number.isdigit() and int(number) < before:
            files.delete_dir(info.path)
