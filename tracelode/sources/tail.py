"""Growing text files as a stream: every whole line once, over appends, rotation and truncation.

A Python data source named ``tail``. An offset holds, per file, the bytes of whole lines read so far; what stands behind the
last newline waits until its line ends. A file is known by its device, inode and a checksum of its first line, not by its name:
renamed, it goes on where it was; cut back and written anew, it starts again. The pattern should match rotated names too
(``/logs/*/*.log*``), else what was written just before a rename is not found any more. Cut back and written anew with the
same first line to more than its old length between two looks, a file cannot be told from one that grew.

Files must be reachable under the same path from the driver and all executors. Ranges of a batch are cut into parts of
``part_bytes``, so a large file is many tasks; a line belongs to the part in which it starts. A file that no name of the
pattern leads to is forgotten.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file_path string, file_id string, line_start bigint"
#: Bytes of a first line that tell files apart.
HEAD = 1024
BLOCK = 1 << 20


class Part(InputPartition):
    """Lines that start in bytes [start, end) of a file."""

    def __init__(self, path: str, file_id: str, start: int, end: int) -> None:
        self.path, self.file_id, self.start, self.end = path, file_id, start, end


def file_id(path: str) -> str | None:
    """Device, inode and checksum of the first line; None while there is no whole line, or the file is gone."""
    try:
        with open(path, "rb") as file:
            head, stat = file.read(HEAD), os.fstat(file.fileno())
    except OSError:
        return None
    end = head.find(b"\n")
    if end < 0 and len(head) < HEAD:
        return None
    return f"{stat.st_dev}-{stat.st_ino}-{zlib.crc32(head[: end + 1] if end >= 0 else head):08x}"


def whole_lines(path: str, known: int = 0) -> int:
    """Bytes up to and with the last newline, looked for from the end back to `known`."""
    with open(path, "rb") as file:
        end = file.seek(0, os.SEEK_END)
        while end > known:
            start = max(known, end - BLOCK)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self._pattern = options["path"]
        self._part = int(options.get("part_bytes", 64 << 20))
        self._last: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Of every file its id, path and the end of its last whole line."""
        now: dict[str, list] = {}
        for path in glob.glob(self._pattern):
            known = file_id(path)
            if known is None:
                continue
            # What was read before has no half line at its end, so only what follows is looked through.
            before = self._last.get(known, [path, 0])[1]
            try:
                now[known] = [path, whole_lines(path, before if os.path.getsize(path) >= before else 0)]
            except OSError:
                continue
        self._last = now
        return now

    def partitions(self, start: dict, end: dict) -> Sequence[Part]:
        parts = []
        for known, (path, at) in end.items():
            begin = start.get(known, [path, 0])[1]
            begin = begin if begin <= at else 0
            parts += [Part(path, known, low, min(low + self._part, at)) for low in range(begin, at, self._part)]
        return parts

    def _open(self, part: Part):
        """The file, under another name if it was renamed since the batch was planned."""
        for path in (part.path, *glob.iglob(self._pattern)):
            if file_id(path) == part.file_id:
                return open(path, "rb")
        raise FileNotFoundError(f"{part.path} was removed or cut back before it was read")

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        with self._open(partition) as file:
            at = partition.start
            if at:
                # A line that starts before this part is the part before's.
                file.seek(at - 1)
                at += len(file.readline()) - 1
            lines, starts, size = [], [], 0
            while at < partition.end:
                line = file.readline()
                if not line.endswith(b"\n"):
                    break
                lines.append(line[:-1].removesuffix(b"\r").decode("utf-8", "replace"))
                starts.append(at)
                at, size = at + len(line), size + len(line)
                if size > BLOCK:
                    yield self._rows(partition, lines, starts)
                    lines, starts, size = [], [], 0
            yield self._rows(partition, lines, starts)

    @staticmethod
    def _rows(part: Part, lines: list[str], starts: list[int]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays(
            [pa.array(lines, pa.string()), pa.array([part.path] * n, pa.string()), pa.array([part.file_id] * n, pa.string()), pa.array(starts, pa.int64())],
            ["value", "file_path", "file_id", "line_start"])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, pattern: str, **options: int):
    """Lines of growing files: value, file_path, file_id and the byte a line starts at."""
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("tail").option("path", pattern)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
