"""Lines of append-only files with their byte ranges: a Python data source for batch and streaming reads.

``format("sparkseek_lines")``, options ``path``, ``start`` (byte offset), ``split`` (bytes per task), ``end``, ``invalid``. Columns: ``_offset``, ``_length``
(bytes, without the line end) and ``value``. ``end`` bounds the read; ``invalid``: a line that is no UTF-8 is an ``error``, or has the
broken bytes replaced by U+FFFD (``replace``). A last line without ``\\n`` is held back until it is complete. A stream's offset is the byte
position up to which lines were read, so a restart goes on where the last committed batch ended.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "_offset bigint, _length int, value string"
BLOCK = 1 << 20


@dataclass
class Range(InputPartition):
    """Lines that start in [start, end)."""

    start: int
    end: int


def _open(path: str):
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path, "rb")


def _size(f) -> int:
    f.seek(0, 2)
    return f.tell()


def complete_end(path: str, start: int = 0) -> int:
    """Byte position after the last line end; ``start`` if there is none after it."""
    with _open(path) as f:
        at = _size(f)
        if at < start:
            raise ValueError(f"{path} has {at} bytes, fewer than the {start} already read: it was cut or replaced")
        while at > start:
            low = max(start, at - BLOCK)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


def _ranges(start: int, end: int, split: int) -> list[Range]:
    return [Range(a, min(a + split, end)) for a in range(start, end, split)]


def _text(line: bytes, at: int, invalid: str) -> str:
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        if invalid == "replace":
            return line.decode("utf-8", "replace")
        raise ValueError(f"not UTF-8 in the line at byte {at}") from None


def _lines(path: str, part: Range, first: int, end: int, invalid: str = "error") -> Iterator[pa.RecordBatch]:
    """Batches of the lines that start in the range; ``first``: where the file's first line of this read starts."""
    with _open(path) as f:
        at = part.start
        if at > first:  # a line that began before belongs to the task before
            f.seek(at - 1)
            at = at - 1 + len(f.readline())
        f.seek(at)
        offsets, lengths, values, size = [], [], [], 0
        while at < part.end and at < end:
            line = f.readline()
            offsets.append(at)
            lengths.append(len(line) - 1)
            values.append(_text(line[:-1], at, invalid))
            at += len(line)
            size += len(line)
            if size > 4 * BLOCK:
                yield _batch(offsets, lengths, values)
                offsets, lengths, values, size = [], [], [], 0
        if offsets:
            yield _batch(offsets, lengths, values)


def _batch(offsets: list, lengths: list, values: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32()), pa.array(values, pa.string())], ["_offset", "_length", "value"])


class LinesReader(DataSourceReader):
    def __init__(self, path: str, start: int, split: int, end: int | None, invalid: str):
        self.path, self.start, self.split, self.invalid = path, start, split, invalid
        self.end = complete_end(path, start) if end is None else end

    def partitions(self):
        return _ranges(self.start, self.end, self.split) or [Range(self.start, self.start)]

    def read(self, partition: Range):
        return _lines(self.path, partition, self.start, self.end, self.invalid)


class LinesStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, start: int, split: int, end: int | None, invalid: str):
        self.path, self.start, self.split, self.invalid = path, start, split, invalid
        self.seen = start

    def initialOffset(self) -> dict:
        return {"o": self.start}

    def latestOffset(self) -> dict:
        self.seen = complete_end(self.path, self.seen)
        return {"o": self.seen}

    def partitions(self, start: dict, end: dict):
        return [_Bounded(r.start, r.end, start["o"], end["o"]) for r in _ranges(start["o"], end["o"], self.split)]

    def read(self, partition: _Bounded):
        return _lines(self.path, partition, partition.first, partition.last, self.invalid)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Bounded(Range):
    first: int = 0
    last: int = 0


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkseek_lines"

    def schema(self) -> str:
        return SCHEMA

    def _args(self) -> tuple[str, int, int, int | None, str]:
        end = self.options.get("end")
        return self.options["path"], int(self.options.get("start", 0)), int(self.options.get("split", 64 << 20)), None if end is None else int(end), self.options.get("invalid", "error")

    def reader(self, schema) -> LinesReader:
        return LinesReader(*self._args())

    def streamReader(self, schema) -> LinesStreamReader:
        return LinesStreamReader(*self._args())


def register(spark: SparkSession) -> None:
    """Make the format known. The source's processes get its classes by value, since they don't see the files shipped to workers."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LinesSource)


SPLIT = 64 << 20
LEAST_SPLIT = 1 << 20


def read_lines(spark: SparkSession, path: str, split: int | None = None, **options):
    """The file's complete lines. Without ``split`` a task gets SPLIT bytes, or less where the file is too small to keep all cores busy with that."""
    register(spark)
    if split is None:
        with _open(path) as f:
            size = _size(f) - int(options.get("start", 0))
        split = min(SPLIT, max(LEAST_SPLIT, -(-size // (2 * spark.sparkContext.defaultParallelism))))
    options["split"] = split
    return spark.read.format("sparkseek_lines").option("path", path).options(**options).load()
