"""Zip archives as a Spark data source: a row for each entry; one archive is read by many tasks, each with a range of its bytes."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRIES = "archive string, entry_no int, path string, encrypted boolean, size bigint, declared_size bigint, crc32 string, content binary, error string"
_ARROW = pa.schema(
    [("archive", pa.string()), ("entry_no", pa.int32()), ("path", pa.string()), ("encrypted", pa.bool_()), ("size", pa.int64()), ("declared_size", pa.int64()), ("crc32", pa.string()), ("content", pa.binary()), ("error", pa.string())]
)
#: Bytes of an archive that one task reads, and of content that it hands on at once.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Ranges of one archive at most: each reads the whole directory, which grows with the archive, so more of them would be quadratic work.
MOST_RANGES = 64


@dataclass
class ArchiveRange(InputPartition):
    """The entries of an archive whose headers stand at low .. high."""

    archive: str
    low: int
    high: int


def _opened(uri: str) -> BinaryIO:
    store, path = pf.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def _archives(path: str) -> list[tuple[str, int]]:
    """URI and size of the file at path, or of the .zip files below the folder at path, in order."""
    store, inner = pf.FileSystem.from_uri(path.rstrip("/"))
    front = path.rstrip("/").removesuffix(inner)
    found = store.get_file_info(inner)
    if found.type == pf.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.type == pf.FileType.File else [f for f in store.get_file_info(pf.FileSelector(inner, recursive=True)) if f.type == pf.FileType.File and f.path.lower().endswith(".zip")]
    return sorted((front + f.path, f.size) for f in files)


def entries_within(part: ArchiveRange) -> Iterator[tuple]:
    """Rows of ENTRIES for a range. An archive without a readable directory gives one row with error, in its first range."""
    with _opened(part.archive) as file:
        try:
            archive = zipfile.ZipFile(file)
        except (zipfile.BadZipFile, OSError, ValueError) as problem:
            if part.low == 0:
                yield part.archive, None, None, None, None, None, None, None, str(problem) or "no archive"
            return
        for number, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
            if not part.low <= max(info.header_offset, 0) < part.high:
                continue
            content, error = None, None
            locked = bool(info.flag_bits & 1)
            if not locked:
                try:
                    content = archive.read(info)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, OSError, ValueError) as problem:
                    error = str(problem) or type(problem).__name__
            yield part.archive, number, info.filename, locked, None if content is None else len(content), info.file_size, f"{info.CRC:08x}", content, error


class _EntryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.bytes = options["path"], int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[ArchiveRange]:
        """Ranges of bytes: only names and sizes are looked up here, directories are read by the tasks."""
        found = []
        for uri, size in _archives(self.path):
            step = max(self.bytes, -(-size // MOST_RANGES))
            cuts = list(range(0, max(size, 1), step))
            found += [ArchiveRange(uri, low, size + 1 if low == cuts[-1] else low + step) for low in cuts]
        return found or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for row in entries_within(partition) if partition.archive else ():
            held.append(row)
            size += len(row[7] or b"") + 200
            if size >= BATCH_BYTES:
                yield whole()
                held, size = [], 0
        if held:
            yield whole()


class ZipEntries(DataSource):
    """Format zip_entries: path names an archive or a folder of them (any store that pyarrow opens); option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: object) -> DataSourceReader:
        return _EntryReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Entries of the zip files at path, see ENTRIES: entry_no from 0 in the directory's order, folders left out.

    An archive is dealt to tasks by ranges of range_bytes, or of a MOST_RANGES-th of it if that is more: each seeks to the directory at its end and then to the entries
    that begin in its range, so an archive of any size (also above 2 GB) is read in parallel and no value holds it whole.
    Locked entries have no content; broken ones, and files that are no archive, are rows with error.
    """
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").option("rangeBytes", str(range_bytes)).load(path)


def write_archives(files: DataFrame, folder: str, name: str = "archive", path: str = "path", content: str = "content", order: Column | str | None = None) -> DataFrame:
    """Write each archive of files (name, path, content) to folder/<name>.zip; name and entries of what was written.

    An archive is one file and so one task's work, which streams its rows in order (by path by default) and holds one batch
    at a time. It is written beside its place and moved there when whole: a task that runs again writes it anew. Rows
    without a name or path are left out; a null content is an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pf.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        now: tuple | None = None

        def closed() -> pa.RecordBatch:
            name, file, archive, aside, n = now
            archive.close()
            file.close()
            store.move(aside, f"{root}/{name}.zip")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "entries"])

        for batch in batches:
            for which, entry, data in zip(*(batch.column(c).to_pylist() for c in ("archive", "path", "content")), strict=True):
                if now is None or now[0] != which:
                    if now is not None:
                        yield closed()
                    aside = f"{root}/_{which}.part"
                    file = store.open_output_stream(aside)
                    now = (which, file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED), aside, 0)
                now[2].writestr(zipfile.ZipInfo(entry), data or b"", zipfile.ZIP_DEFLATED)
                now = (*now[:4], now[4] + 1)
        if now is not None:
            yield closed()

    rows = files.select(F.col(name).cast("string").alias("archive"), F.col(path).alias("path"), F.col(content).cast("binary").alias("content"), (F.col(path) if order is None else order if isinstance(order, Column) else F.col(order)).alias("_order"))
    rows = rows.where("archive IS NOT NULL AND path IS NOT NULL").repartition("archive").sortWithinPartitions("archive", "_order")
    return rows.select("archive", "path", "content").mapInArrow(run, "archive string, entries bigint")


def with_digest(entries: DataFrame) -> DataFrame:
    return entries.withColumn("file_hash", F.sha2("content", 256))
