"""Growing log files as a streaming source: each line once, with its file and the byte at which it begins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads of a file, and that are looked at together for the last line's end.
RANGE_BYTES, LOOK_BYTES = 32 << 20, 1 << 16


@dataclass
class LogRange(InputPartition):
    """Whole lines that begin at low .. high; the first one begins at base or behind a line end."""

    file: str
    base: int
    low: int
    high: int
    end: int


class _TailReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.bytes = path, range_bytes

    def _files(self) -> dict[str, int]:
        store, inner = pf.FileSystem.from_uri(self.path)
        found = store.get_file_info(inner)
        files = [found] if found.type == pf.FileType.File else store.get_file_info(pf.FileSelector(inner, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in files if f.type == pf.FileType.File and not f.base_name.startswith((".", "_"))}

    def _whole(self, file: str, size: int) -> int:
        """The byte behind the last line end: a line that is still being written is left for later."""
        store, _ = pf.FileSystem.from_uri(self.path)
        with store.open_input_file(file) as stream:
            while size:
                low = max(0, size - LOOK_BYTES)
                stream.seek(low)
                at = stream.read(size - low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                size = low
        return 0

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return {file: self._whole(file, size) for file, size in sorted(self._files().items())}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[LogRange]:
        found = []
        for file, upto in sorted(end.items()):
            low = start.get(file, 0)
            if upto < low:
                raise ValueError(f"{file} is shorter than what was read of it; logs may only grow")
            found += [LogRange(file, low, at, min(at + self.bytes, upto), upto) for at in range(low, upto, self.bytes)]
        return found

    def read(self, partition: LogRange) -> Iterator[tuple[str, int, str]]:
        store, _ = pf.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.file) as stream:
            at = partition.low
            if at > partition.base:  # the line that reaches into this range is the range before's
                stream.seek(at - 1)
                at += len(_line(stream, partition.end)) - 1
            else:
                stream.seek(at)
            while at < partition.high:
                line = _line(stream, partition.end)
                yield partition.file, at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)


def _line(stream: object, end: int) -> bytes:
    """The bytes up to and with the next line end."""
    start, parts = stream.tell(), []
    while True:
        part = stream.read(min(LOOK_BYTES, end - stream.tell()))
        at = part.find(b"\n")
        if at >= 0 or not part:
            parts.append(part[: at + 1] if at >= 0 else part)
            line = b"".join(parts)
            stream.seek(start + len(line))
            return line
        parts.append(part)


class LogTail(DataSource):
    """Format log_tail: path names a log or a folder of logs (any store that pyarrow opens); option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, at bigint, line string"

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        options = dict(self.options)
        return _TailReader(options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES))))


def tail_logs(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A streaming table of file, at and line of the logs at path, as they grow.

    Offsets are bytes by file, so a query that starts again from its checkpoint goes on behind the last line that it took. A
    line is read once it has ended. Files may be added; one that got shorter is an error.
    """
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("rangeBytes", str(range_bytes)).load(path)
