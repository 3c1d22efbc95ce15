"""Append-only event logs (a folder of JSON-lines files that still grow) as a stream with a cursor.

The offset of the stream is the number of bytes read of each file, up to the last line that is complete, so Spark's own checkpoint holds the cursor: a run that is
killed and started again goes on from the last batch that was planned, reads the same bytes for it, and loses and repeats nothing. Files are read in
ranges of ``rangeBytes``; a line belongs to the range in which it begins. Files that appear later are read from their start.
``tail_cursor`` finds the place of the last n events of each file, reading backwards from its end; given as option ``cursor``, it is where a new stream begins.

Options: path (a URI that pyarrow's file systems know: a mounted folder, hdfs, s3, gs), cursor (JSON of file name to bytes), rangeBytes.
Rows: file, offset (of the line's first byte), event (the line if it is JSON, else null), raw (the line if it is not).

Cases: blank lines are left out; a line without its end is not read yet; an empty folder gives no rows; a file that got shorter than the cursor is an error, as its events cannot be told apart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset long, event string, raw string"
RANGE_BYTES, BACK_BYTES = 64 << 20, 1 << 16


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _sizes(path: str) -> dict[str, int]:
    from pyarrow import fs

    system, root = _open(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {f.base_name: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}


def _last_end(path: str, name: str, size: int, least: int, lines: int = 0) -> int:
    """The place behind the line end that is ``lines`` line ends before the last one, looking back from ``size`` no farther than ``least``."""
    system, root = _open(path)
    with system.open_input_file(f"{root}/{name}") as f:
        at, left = size, lines
        while at > least:
            start = max(least, at - BACK_BYTES)
            f.seek(start)
            block = f.read(at - start)
            end = len(block)
            while (end := block.rfind(b"\n", 0, end)) >= 0:
                if not left:
                    return start + end + 1
                left -= 1
            at = start
    return least


def tail_cursor(path: str, n: int) -> str:
    """The cursor behind which each file has its last ``n`` complete lines."""
    return json.dumps({name: _last_end(path, name, size, 0, n) for name, size in sorted(_sizes(path).items())})


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int, first: int, stop: int) -> None:
        super().__init__((name, start))
        self.name, self.start, self.end, self.first, self.stop = name, start, end, first, stop


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.cursor = json.loads(options.get("cursor", "{}"))
        self.bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {k: int(v) for k, v in self.cursor.items()}

    def latestOffset(self) -> dict:
        sizes = _sizes(self.path)
        for name, size in sizes.items():
            least = self.known.get(name, self.cursor.get(name, 0))
            if size < least:
                raise ValueError(f"{name} has {size} bytes, but {least} have been read")
            self.known[name] = _last_end(self.path, name, size, least)
        return dict(sorted(self.known.items()))

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out = []
        for name, stop in sorted(end.items()):
            first = start.get(name, 0)
            if stop < first:
                raise ValueError(f"{name} ends at {stop}, but {first} bytes have been read")
            out += [_Range(name, at, min(at + self.bytes, stop), first, stop) for at in range(first, stop, self.bytes)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        system, root = _open(self.path)
        with system.open_input_file(f"{root}/{partition.name}") as f:
            # a line begins in the range if the byte before it does not lie behind the range's last
            at = partition.start
            f.seek(max(partition.first, at - 1))
            data = f.read(partition.end - f.tell())
            if at > partition.first:
                cut = data.find(b"\n")
                if cut < 0:
                    return
                data, at = data[cut + 1 :], at + cut
            if not data:
                return
            rest = []
            tail = data if data.endswith(b"\n") else None
            while tail is None:  # the last line goes on behind the range
                block = f.read(min(BACK_BYTES, partition.stop - f.tell()))
                end = block.find(b"\n")
                rest.append(block if end < 0 else block[: end + 1])
                tail = b"" if end >= 0 or not block else None
            rows = []
            for line in b"".join([data, *rest]).split(b"\n")[:-1]:
                text = line.decode("utf-8", "replace")
                if text.strip():
                    rows.append((partition.name, at, text, None) if _is_json(text) else (partition.name, at, None, text))
                at += len(line) + 1
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["file", "offset", "event", "raw"])


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class EventLog(DataSource):
    """``spark.readStream.format("event_log")`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLog)


def event_stream(spark: SparkSession, path: str, cursor: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The log as a stream, from a cursor or from its start."""
    register(spark)
    reader = spark.readStream.format("event_log").option("path", path).option("rangeBytes", range_bytes)
    return (reader.option("cursor", cursor) if cursor else reader).load()
