"""Runs of activity and probes whose time is up, as they happen.

Keyed state with timers on the event-time watermark. A session is told once its
silence has lasted longer than the gap, an unanswered probe once its deadline has
passed. Rows that come later than that correct what was told, as long as it is
remembered (``keep_ms``); then its state is removed, so an idle stream holds none.

Before the state, every task of a batch folds its rows into slots of one gap or one
timeout. A busy producer or tag then costs one row per task and slot, and probes are
keyed by slot and share of the tags.

A row without a key only moves the clock on; send one to close what is open.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.plans.session import by_value

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SESSIONS = (
    "producer string, first_ts timestamp, last_ts timestamp, n_lines long, revision int, "
    "replaces array<struct<first_ts: timestamp, revision: int>>"
)
PROBES = "tag string, probe string, ts timestamp, answered boolean"
_FOLDED_PROBES = "tag string, slot long, probe string, at long, first long, last long"
#: What is remembered after it was told.
KEEP_MS = 24 * 3600 * 1000


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for the streams that are started inside; the session keeps its own."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _next_timer(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """One timer for each key, at the earliest time that matters."""
    for timer in list(handle.listTimers()):
        if timer != at_ms:
            handle.deleteTimer(timer)
    if at_ms is not None:
        handle.registerTimer(at_ms)


def _time(micros: int) -> datetime:
    """The instant as Spark's rows take it."""
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros)


class Sessions(StatefulProcessor):
    """Intervals of one producer: open ones, and told ones that may be corrected.

    An interval has its first and last instant, its lines, the revision that was told
    (-1: none since it last changed) and what it replaces.
    """

    def __init__(self, gap_ms: int, keep_ms: int):
        self.gap, self.keep = gap_ms * 1000, keep_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("intervals", "first long", "last long, lines long, told int, replaces string")

    def close(self) -> None:
        pass

    def _load(self) -> list[list]:
        return sorted([k[0], v[0], v[1], v[2], v[3]] for k, v in self.state.iterator())

    def _merged(self, intervals: list[list]) -> list[list]:
        out: list[list] = []
        for first, last, lines, told, replaces in sorted(intervals):
            if out and first - out[-1][1] <= self.gap:
                before = out[-1]
                for side in (before, (first, last, lines, told, replaces)):
                    if side[3] >= 0:
                        replaces, side = f"{replaces},{side[0]}:{side[3]}", side
                before[1], before[2] = max(before[1], last), before[2] + lines
                before[4] = ",".join(sorted({r for r in f"{before[4]},{replaces}".split(",") if r}))
                before[3] = -1
            else:
                out.append([first, last, lines, told, replaces])
        return out

    def _settled(self, key, intervals: list[list], before: set[int], watermark_ms: int) -> Iterator[Row]:
        """Tells what has ended, forgets what is old, and keeps the rest."""
        kept, wake = [], []
        for interval in intervals:
            first, last, lines, told, replaces = interval
            ends = (last + self.gap) // 1000 + 1
            if told < 0 and ends <= watermark_ms:
                old = [tuple(map(int, r.split(":"))) for r in replaces.split(",") if r]
                told = max([revision + 1 for _, revision in old], default=0)
                yield Row(
                    producer=key[0], first_ts=_time(first), last_ts=_time(last), n_lines=lines, revision=told,
                    replaces=[Row(first_ts=_time(f), revision=r) for f, r in old],
                )
                replaces = ""
            forget = ends + self.keep // 1000
            if told < 0 or forget > watermark_ms:
                kept.append([first, last, lines, told, replaces])
                wake.append(ends if told < 0 else forget)
        for first in before - {k[0] for k in kept}:
            self.state.removeKey((first,))
        for first, last, lines, told, replaces in kept:
            self.state.updateValue((first,), (last, lines, told, replaces))
        _next_timer(self.handle, min(wake, default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._load()
        fresh = [[r.low, r.high, r.n_lines, -1, ""] for r in rows]
        if key[0] is not None:
            watermark = timerValues.getCurrentWatermarkInMs()
            yield from self._settled(key, self._merged(held + fresh), {i[0] for i in held}, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._load()
        yield from self._settled(key, held, {i[0] for i in held}, timerValues.getCurrentWatermarkInMs())


def _folded_lines(gap_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for batch in batches:
            slot = pc.floor(pc.divide(pc.cast(batch["at"], pa.float64()), float(gap_ms * 1000)))
            table = pa.table({"producer": batch["producer"], "slot": slot, "at": batch["at"]})
            tables.append(table.group_by(["producer", "slot"]).aggregate([("at", "min"), ("at", "max"), ("at", "count")]))
        if tables:
            whole = pa.concat_tables(tables).group_by(["producer", "slot"])
            whole = whole.aggregate([("at_min", "min"), ("at_max", "max"), ("at_count", "sum")])
            names = ("producer", "at_min_min", "at_max_max", "at_count_sum")
            out = pa.table([whole[n] for n in names], names=["producer", "low", "high", "n_lines"])
            yield from out.to_batches()

    return run


def ended_sessions(
    parsed: DataFrame, gap_ms: int = 60_000, delay: str = "0 seconds", keep_ms: int = KEEP_MS, ts: str = "ts"
) -> DataFrame:
    """The sessions of a stream (``producer``, ``ts``) as they end.

    ``delay`` is how much disorder is waited for before a session counts as ended.
    ``replaces`` names the rows told before that a correction stands for. Rows without
    a time are left out.
    """
    # The clock is kept by the marked column; folded rows do not carry the mark, so
    # that rows behind the clock reach the state and correct it.
    timed = parsed.where(F.col(ts).isNotNull()).select("producer", F.col(ts).alias("clock"))
    marked = timed.withWatermark("clock", delay).select("producer", F.unix_micros("clock").alias("at"))
    by_value(__name__)
    folded = marked.mapInArrow(_folded_lines(gap_ms), "producer string, low long, high long, n_lines long")
    return folded.groupBy("producer").transformWithState(
        Sessions(gap_ms, keep_ms), SESSIONS, outputMode="append", timeMode="eventTime"
    )


def current_sessions(told: DataFrame) -> DataFrame:
    """The sessions that no later row replaces."""
    gone = told.select("producer", F.explode("replaces").alias("r")).select(
        "producer", F.col("r.first_ts").alias("first_ts"), F.col("r.revision").alias("revision")
    )
    kept = told.join(gone, ["producer", "first_ts", "revision"], "left_anti")
    return kept.select("producer", "first_ts", "last_ts", "n_lines")


class Probes(StatefulProcessor):
    """The probes of one slot and share of the tags, and the responses that can answer
    them: of each tag the last one of the slot and the first one of the next.

    All of a key is one value, read and written once for each batch that touches it: a
    call of the state costs far more than a probe.
    """

    HELD = (
        "tags array<string>, probes array<string>, ats array<long>, told array<boolean>, "
        "answering array<string>, lasts array<long>, firsts array<long>, timer long"
    )

    def __init__(self, timeout_ms: int, keep_ms: int):
        self.width, self.keep = timeout_ms * 1000, keep_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.HELD)

    def close(self) -> None:
        pass

    def _load(self) -> tuple[dict, dict, int | None]:
        """Whether each probe was told, the responses of each tag, and the timer."""
        held = self.state.get()
        if held is None:
            return {}, {}, None
        tags, probes, ats, told, answering, lasts, firsts, timer = held
        return dict(zip(zip(tags, probes, ats), told)), dict(zip(answering, zip(lasts, firsts))), timer

    def _settled(self, key, probes: dict, responses: dict, timer: int | None, watermark_ms: int) -> Iterator[Row]:
        kept, wake = {}, []
        for (tag, probe, at), told in probes.items():
            last, first = responses.get(tag, (None, None))
            deadline = (at + self.width) // 1000 + 1
            if (last is not None and last >= at) or (first is not None and first <= at + self.width):
                if told:
                    yield Row(tag=tag, probe=probe, ts=_time(at), answered=True)
                continue
            if not told and deadline <= watermark_ms:
                told = True
                yield Row(tag=tag, probe=probe, ts=_time(at), answered=False)
            elif not told:
                wake.append(deadline)
            kept[tag, probe, at] = told
        forget = ((key[1] + 2) * self.width + self.keep) // 1000 + 1
        wake = min([*wake, forget]) if forget > watermark_ms else None
        if timer is not None and timer != wake:
            self.handle.deleteTimer(timer)
        if wake is None:
            self.state.clear()
            return
        if timer != wake:
            self.handle.registerTimer(wake)
        sides = [list(side) for side in zip(*kept)] or [[], [], []]
        answers = [[last for last, _ in responses.values()], [first for _, first in responses.values()]]
        self.state.update((*sides, list(kept.values()), list(responses), *answers, wake))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            return
        probes, responses, timer = self._load()
        for r in rows:
            if r.probe is not None:
                probes.setdefault((r.tag, r.probe, r.at), False)
                continue
            last, first = responses.get(r.tag, (None, None))
            if r.last is not None:
                last = r.last if last is None else max(last, r.last)
            if r.first is not None:
                first = r.first if first is None else min(first, r.first)
            responses[r.tag] = (last, first)
        yield from self._settled(key, probes, responses, timer, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._settled(key, *self._load(), timerValues.getCurrentWatermarkInMs())


def _folded_probes(timeout_ms: int):
    """Probes by slot; responses as the last of their slot and the first after the one before."""
    width = float(timeout_ms * 1000)
    schema = pa.schema(
        [("tag", pa.string()), ("slot", pa.int64()), ("probe", pa.string())]
        + [(n, pa.int64()) for n in ("at", "first", "last")]
    )

    def row_set(tag, slot, **given) -> pa.RecordBatch:
        columns = {"tag": tag, "slot": slot, **given}
        n = len(tag)
        arrays = [
            pc.cast(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema
        ]
        arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            slot = pc.cast(pc.floor(pc.divide(pc.cast(batch["at"], pa.float64()), width)), pa.int64())
            table = pa.table({"tag": batch["tag"], "slot": slot, "probe": batch["probe"], "at": batch["at"]})
            sent = table.filter(pc.is_valid(table["probe"]))
            if sent.num_rows:
                yield row_set(sent["tag"], sent["slot"], probe=sent["probe"], at=sent["at"])
            answers = table.filter(pc.is_null(table["probe"])).group_by(["tag", "slot"])
            held.append(answers.aggregate([("at", "min"), ("at", "max")]))
        if held:
            whole = pa.concat_tables(held).group_by(["tag", "slot"]).aggregate([("at_min", "min"), ("at_max", "max")])
            if whole.num_rows:
                yield row_set(whole["tag"], whole["slot"], last=whole["at_max_max"])
                yield row_set(whole["tag"], pc.subtract(whole["slot"], 1), first=whole["at_min_min"])

    return run


def unanswered_stream(
    events: DataFrame,
    timeout_ms: int = 5000,
    delay: str = "0 seconds",
    keep_ms: int = KEEP_MS,
    ts: str = "ts",
    shares: int = 16,
) -> DataFrame:
    """Probes of a stream that got no response of their tag within the timeout, told
    when their deadline has passed.

    A row (``tag, probe, ts``) with a ``probe`` is a probe, one without is a response.
    A response that comes later but was given in time is told with ``answered``. The
    state is keyed by slot and by one of ``shares`` of the tags, so that the number of
    its calls does not grow with the tags; so many tasks can work on one slot.
    """
    by_value(__name__)
    timed = events.where(F.col(ts).isNotNull()).select("tag", F.col("probe").cast("string").alias("probe"), F.col(ts).alias("clock"))
    marked = timed.withWatermark("clock", delay).select("tag", "probe", F.unix_micros("clock").alias("at"))
    folded = marked.mapInArrow(_folded_probes(timeout_ms), _FOLDED_PROBES)
    share = F.when(F.col("tag").isNotNull(), F.pmod(F.xxhash64("tag"), F.lit(shares)))
    return folded.withColumn("share", share).groupBy("share", "slot").transformWithState(
        Probes(timeout_ms, keep_ms), PROBES, outputMode="append", timeMode="eventTime"
    )


def current_unanswered(told: DataFrame) -> DataFrame:
    """``tag, probe, ts`` of the probes told that no response corrected."""
    answered = told.where("answered").select("tag", "probe", "ts")
    return told.where("NOT answered").select("tag", "probe", "ts").join(answered, ["tag", "probe", "ts"], "left_anti")


def start_told(told: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends what is told to a table in ``path``, each row once."""
    with setting(told.sparkSession, PROVIDER, ROCKSDB):
        writer = told.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start(path)
