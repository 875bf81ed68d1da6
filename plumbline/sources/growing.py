"""Log files that grow while they are read, as a streaming data source.

The offset of the stream is the place in every file behind its last whole line, so a
batch holds the lines that were finished since the one before, and a restart goes on
from the checkpoint. A line without its end is held back until it is finished. A file
that became shorter, or that begins with another line than before, was truncated or
replaced and is read from its start.

The driver lists the folder and looks at both ends of the files that changed since
it last did; tasks read ranges of bytes. Files are reached through Arrow, by path or
URI, from the driver and the executors alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from plumbline.plans.session import by_value

#: Bytes of one task, and of one look for the end of a line.
PART, LOOK = 32 << 20, 64 << 10
#: Bytes that tell a file's beginning, at most.
HEAD = 1024
LINES = "value string, file string, block long, line_no long"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    # A local URI may be written with one slash.
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def whole_lines(file, size: int) -> int:
    """The place behind the last line end among the first ``size`` bytes."""
    high = size
    while high > 0:
        low = max(0, high - LOOK)
        file.seek(low)
        at = file.read(high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return 0


class Range(InputPartition):
    """Lines that start in ``low .. high`` of a file whose new lines lie in ``begin .. end``."""

    def __init__(self, path: str, begin: int, end: int, low: int, high: int):
        super().__init__((path, low))
        self.path, self.begin, self.end, self.low, self.high = path, begin, end, low, high


class GrowingFilesReader(DataSourceStreamReader):
    def __init__(self, folder: str, part: int = PART):
        self.folder, self.part = folder, part
        #: What the last look found of each file, by size and time.
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, root = filesystem(self.folder)
        listed = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        listed = [f for f in listed if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]

        def look(info: fs.FileInfo) -> tuple:
            stamp = (info.size, info.mtime_ns)
            if info.path in self.known and self.known[info.path][0] == stamp:
                return self.known[info.path]
            try:
                with files.open_input_file(info.path) as file:
                    end = whole_lines(file, info.size)
                    file.seek(0)
                    head = file.read(min(HEAD, end)).split(b"\n")[0]
            except FileNotFoundError:  # gone since it was listed
                return stamp, None
            return stamp, {"end": end, "head": zlib.crc32(head)} if end else None

        with ThreadPoolExecutor(16) as pool:
            found = dict(zip((f.path for f in listed), pool.map(look, listed)))
        self.known = found
        return {path: place for path, (_, place) in sorted(found.items()) if place}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        parts = []
        for path, place in end.items():
            before = start.get(path, {"end": 0, "head": place["head"]})
            same = before["head"] == place["head"] and before["end"] <= place["end"]
            begin = before["end"] if same else 0
            parts += [
                Range(path, begin, place["end"], low, min(low + self.part, place["end"]))
                for low in range(begin, place["end"], self.part)
            ]
        return parts

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.folder)
        with files.open_input_file(partition.path) as file:
            low = partition.low
            # A line that started before belongs to the range before.
            skip = low > partition.begin
            file.seek(low - skip)
            data = file.read(partition.high - low + skip)
            if skip and b"\n" not in data:
                return
            while data[-1:] != b"\n" and file.tell() < partition.end:
                more = file.read(min(LOOK, partition.end - file.tell()))
                at = more.find(b"\n")
                data += more[: at + 1] if at >= 0 else more
        if skip:
            first = data.find(b"\n") + 1
            low, data = low - 1 + first, data[first:]
            if low >= partition.high:
                return
        if data:
            yield _batch(partition.path, low, data)


def _batch(path: str, low: int, data: bytes) -> pa.RecordBatch:
    """Lines with the place where they start; ends of lines (also CR LF) are left out."""
    lines = data.removesuffix(b"\n").split(b"\n")
    places, at = [], low
    for line in lines:
        places.append(at)
        at += len(line) + 1
    text = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
    columns = [pa.array(text, pa.string()), pa.array([path] * len(text)), pa.array([0] * len(text)), pa.array(places)]
    return pa.RecordBatch.from_arrays(columns, names=["value", "file", "block", "line_no"])


class GrowingFiles(DataSource):
    """Options: ``path`` (a folder) and ``part`` (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "growing-files"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> GrowingFilesReader:
        return GrowingFilesReader(self.options["path"], int(self.options.get("part", PART)))


def follow_logs(spark: SparkSession, folder: str, part: int = PART) -> DataFrame:
    """The lines of all files below ``folder`` as they are finished, as a stream of
    ``value, file, block, line_no``; ``line_no`` is the byte where a line starts, in
    the order of the file, and ``block`` is 0.

    Empty files and files whose only line is not finished give nothing. Hidden files
    are left out. Bytes that are not UTF-8 are replaced.
    """
    by_value(__name__)
    spark.dataSource.register(GrowingFiles)
    return spark.readStream.format(GrowingFiles.name()).option("path", folder).option("part", part).load()
