"""Numpy columns packed into a few binary rows per task.

Per-token records (hashes, positions) number in the billions, so a Spark row for
each would cost more than the work on it. A task packs its records by bucket
into one binary row per bucket and lets Spark shuffle those; the reducer reads
them back as numpy arrays. Hashing is vectorised over whole record batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text handled at once, so that the working arrays stay in cache.
CHUNK = 1 << 18
#: Records that a task holds before it hands them on.
FLUSH = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd hash base and of its inverse, modulo 2**64."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(n + 1, 2 * CHUNK)
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a polynomial hash so that all its bits are usable."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA24BAED4963EE407)
    x ^= x >> np.uint64(32)
    return x


#: A random-looking 64-bit value for every byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Rolling:
    """Prefix sums that give the hash of any stretch of ``values``."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n])

    def spans(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        raw = (self.sums[high] - self.sums[low]) * self.down[low]
        return mix(raw + (high - low).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows whose sizes add up to about ``limit``, as ranges."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and the n + 1 word offsets of the rows."""
    solid = ~SPACE[data]
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    low, high = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, high, np.searchsorted(low, offsets)


def word_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return Rolling(BYTE_VALUES[data]).spans(low, high)


def to_bytes(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of 64-bit values, one row each."""
    raw = np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(raw[:, :width])


def from_bytes(blob: bytes | memoryview | np.ndarray, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def rows_by_bucket(bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray], key: str = "bucket") -> pa.RecordBatch:
    """One row per bucket that has records; every column becomes one binary value."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    bucket = bucket.astype(kind, copy=False)
    order = np.argsort(bucket, kind="stable")
    placed = bucket[order]
    present, first = np.unique(placed, return_index=True)
    arrays = [pa.array(present.astype(np.int32))]
    for values in columns.values():
        sorted_values = np.ascontiguousarray(values[order])
        raw = sorted_values.view(np.uint8).reshape(-1)
        width = sorted_values.dtype.itemsize * (sorted_values.shape[1] if sorted_values.ndim > 1 else 1)
        offsets = np.append(first, len(placed)).astype(np.int64) * width
        arrays.append(
            pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(present), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]
            ).cast(pa.binary())
        )
    return pa.RecordBatch.from_arrays(arrays, names=[key, *columns])


def joined(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a binary column, one after the other, as bytes."""
    return utf8(column)[0]


def counts(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Records in every row of a binary column."""
    return np.diff(utf8(column)[1]) // width


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1``, one range after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def place(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a mixed 64-bit hash, taken from its upper half."""
    return ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def bucket_count(spark: SparkSession, times: int = 4) -> int:
    """Follows the shuffle partitions, which a cluster sets by the data's size."""
    return times * int(spark.conf.get("spark.sql.shuffle.partitions")) | 1


def release() -> None:
    """Give freed memory back at the end of a task: Python workers are used again
    by the next stages, next to the JVM of their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Texts differ by orders of magnitude, so Python gets them in batches bounded
    by bytes; workers then need little memory next to the JVM."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def with_block(docs: DataFrame, blocks: int, key: str = "doc_id") -> DataFrame:
    """Rows with the block of their id; rows without one go to the first block."""
    x = F.col(key).cast("long")
    x = x.bitwiseXOR(F.shiftright(x, 7)).bitwiseXOR(F.shiftright(x, 19))
    return docs.withColumn("__block", F.coalesce(F.pmod(x, F.lit(blocks)), F.lit(0)).cast("int"))


def block_of_ids(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The same placement in numpy."""
    x = ids.astype(np.int64)
    return np.mod(x ^ (x >> 7) ^ (x >> 19), blocks)


class Held:
    """Records of a task, waiting to be packed."""

    def __init__(self, names: Iterable[str]):
        self.parts: dict[str, list[np.ndarray]] = {n: [] for n in names}
        self.size = 0

    def add(self, **columns: np.ndarray) -> None:
        for name, values in columns.items():
            self.parts[name].append(values)
        self.size += len(next(iter(columns.values())))

    def take(self) -> dict[str, np.ndarray]:
        out = {n: np.concatenate(p) if p else np.empty(0) for n, p in self.parts.items()}
        self.parts, self.size = {n: [] for n in self.parts}, 0
        return out
