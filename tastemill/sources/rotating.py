"""A growing, rotating log as a streaming source.

The event logger appends lines to one file and, at a size limit, renames it (``data.json`` becomes ``data.json.1``) and begins a
new one. Spark's file source reads a name once, so it would miss what is appended and read a renamed file again. Here a
file is known by what it begins with, not by its name: its identity is a digest of its first complete line (the logger stamps
lines with user and time, so that no two files begin alike). The stream's offset maps every identity to the bytes
read, always up to a line end, so that an unfinished line waits for its rest and a restarted query goes on where it stopped.

New bytes are cut into ranges that tasks read in parallel; a task looks a file up by its identity again if it was renamed in
the meantime, and fails if it is gone, for its lines would be lost. Rows are (line, file, at): the text, the file's identity and
the line's first byte. The folder must be readable from the driver and all executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .schemas import EVENTS

SCHEMA = "line string, file string, at long"
#: Bytes of a range, and of a piece read at a time.
RANGE = 32 << 20
PIECE = 1 << 20


@dataclass
class Bytes(InputPartition):
    """Lines that begin in bytes ``first`` .. ``last`` - 1 of a file; ``opens``: whether a line begins at ``first``."""

    path: str
    file: str
    first: int
    last: int
    opens: bool


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def identity(store: fs.FileSystem, path: str) -> str | None:
    """Digest of the first complete line; None while there is none."""
    head = b""
    with store.open_input_file(path) as file:
        while b"\n" not in head:
            piece = file.read(1 << 14)
            if not piece:
                return None
            head += piece
    return hashlib.md5(head[: head.index(b"\n")]).hexdigest()


def last_line_end(store: fs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the end of the last complete line among the first ``size``."""
    with store.open_input_file(path) as file:
        end = size
        while end > 0:
            start = max(0, end - PIECE)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return 0


def log_files(folder: str, prefix: str) -> dict[str, tuple[str, int]]:
    """identity -> (path, size) of the log's files: names that begin with ``prefix``."""
    store, path = _store(folder)
    out = {}
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.type == fs.FileType.File and info.base_name.startswith(prefix) and info.size:
            try:
                own = identity(store, info.path)
            except FileNotFoundError:  # renamed after it was listed: seen under its new name by the next batch
                continue
            if own is None:
                continue
            if own in out and out[own][0] != info.path and identity(store, out[own][0]) == own:
                raise ValueError(f"{out[own][0]} and {info.path} begin with the same line and cannot be told apart")
            out[own] = (info.path, info.size)
    return out


class RotatingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.prefix = options.get("prefix", "")
        self.range = int(options.get("range", RANGE))

    def initialOffset(self) -> dict:
        return {"read": "{}"}

    def latestOffset(self) -> dict:
        store, _ = _store(self.folder)
        ends = {}
        for own, (path, size) in log_files(self.folder, self.prefix).items():
            try:
                ends[own] = last_line_end(store, path, size)
            except FileNotFoundError:
                continue
        return {"read": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["read"]), json.loads(end["read"])
        found = log_files(self.folder, self.prefix)
        out: list[InputPartition] = []
        for own, last in sorted(after.items()):
            first = before.get(own, 0)
            if first < last and own not in found:
                raise FileNotFoundError(f"a log file with unread lines is gone (identity {own})")
            for a in range(first, last, self.range):
                out.append(Bytes(found[own][0], own, a, min(last, a + self.range), a == first))
        return out

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)
        path = partition.path
        try:
            same = identity(store, path) == partition.file
        except FileNotFoundError:
            same = False
        if not same:
            found = log_files(self.folder, self.prefix)
            if partition.file not in found:
                raise FileNotFoundError(f"a log file with unread lines is gone (identity {partition.file})")
            path = found[partition.file][0]
        with store.open_input_file(path) as file:
            yield from self._lines(file, partition)

    def _lines(self, file, part: Bytes) -> Iterator[pa.RecordBatch]:
        """The range's lines, the last one beyond its end, piece by piece."""
        # a range that may begin inside a line leaves that line to the range before
        at = part.first if part.opens else part.first - 1
        file.seek(at)
        rest, skip = b"", not part.opens
        while True:
            piece = file.read(PIECE)
            data = rest + piece
            cut = data.rfind(b"\n") + 1
            lines = data[:cut].split(b"\n")[:-1]
            starts, texts = [], []
            done = False
            for line in lines:
                if at >= part.last and not skip:
                    done = True
                    break
                if not skip:
                    starts.append(at)
                    texts.append(line.rstrip(b"\r"))
                skip = False
                at += len(line) + 1
            if texts:
                columns = [pa.array([t.decode("utf-8", "replace") for t in texts]), pa.array([part.file] * len(texts)), pa.array(starts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["line", "file", "at"])
            if done or not piece or (at >= part.last and not skip):
                return
            rest = data[cut:]

    def commit(self, end: dict) -> None:
        """Offsets live in the query's checkpoint; the log is the logger's."""


class RotatingLog(DataSource):
    """``spark.readStream.format("rotating_log").option("prefix", "data.json").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "rotating_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> RotatingReader:
        return RotatingReader(self.options)


def stream_rotating(spark: SparkSession, folder: str, prefix: str = "", schema: str = EVENTS, range_bytes: int = RANGE) -> DataFrame:
    """Events of a growing and rotating JSON log, with the event time ``at``. A line that is not JSON gives NULLs."""
    spark.dataSource.register(RotatingLog)
    lines = spark.readStream.format("rotating_log").option("prefix", prefix).option("range", range_bytes).load(folder)
    return lines.select(F.from_json("line", schema).alias("event")).select("event.*").withColumn("at", F.timestamp_millis("timestamp"))
