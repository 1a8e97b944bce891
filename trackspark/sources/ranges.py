"""Binary files of equal records, read by ranges of bytes and written as streams: Python data sources.

A file of any size is many partitions, each of which reads the head and its own records; a written file is streamed from
sorted rows, is seen only when the whole job has ended, and leaves nothing when it fails.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it, by the scheme; a path without one is local."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a file, folder or pattern names, in order; hidden ones don't count, as elsewhere in Spark."""
    system, root = file_system(path)
    parts = root.split("/")
    wild = next((i for i, part in enumerate(parts) if any(c in part for c in "*?[")), None)
    if wild is None:
        base, pattern = root, None
    else:
        base, pattern = "/".join(parts[:wild]) or "/", root.rstrip("/")
    info = system.get_file_info([base])[0]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File]
    hidden = lambda name: any(part[:1] in "._" for part in name.removeprefix(base).split("/") if part)
    depth = None if pattern is None else pattern.count("/")
    fits = lambda name: pattern is None or any(fnmatch.fnmatchcase(head, pattern) for head in _heads(name, depth))
    return sorted((x.path, x.size) for x in found if (x is info or not hidden(x.path)) and fits(x.path))


def _heads(name: str, depth: int) -> Iterator[str]:
    """A path cut to a pattern's depth, so that a pattern names folders too."""
    parts = name.split("/")
    if len(parts) > depth:
        yield "/".join(parts[: depth + 1])


#: Bytes of a file that a task reads; and how many tasks there are at most where they are asked to read less.
SPLIT, RANGES = 64 << 20, 1000


@dataclass
class Layout:
    """Where a file's records lie: count of them, each of stride bytes, from the byte first."""

    first: int
    stride: int
    count: int


@dataclass
class Range(InputPartition):
    """Bytes from begin up to end of a file; records that start there are this partition's."""

    path: str
    size: int
    begin: int
    end: int


class RecordReader(DataSourceReader):
    """Rows (file, size, head, number, data, reason): up to rows records end to end, the first of which has that number.

    head is what lies before the records, or so many bytes as are asked for. A file that layout refuses is one row with
    the reason and no data, as is, without reason, one without records. With rows 0 there is only a head for each file.
    """

    def __init__(self, path: str, layout: Callable[[Callable[[int, int], bytes], int], Layout], head: int, split: int, rows: int):
        self.path, self.layout, self.head, self.split, self.rows = path, layout, head, split, rows

    def partitions(self):
        out, files = [], listed(self.path)
        # A task costs more than a few records: small ranges grow up to SPLIT where there would be more than RANGES.
        split = max(self.split, min(SPLIT, -(-sum(size for _, size in files) // RANGES)))
        for name, size in files:
            cuts = range(0, max(size, 1), split) if self.rows else [0]
            out += [Range(name, size, a, min(size, a + split)) for a in cuts]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        system, _ = file_system(self.path)
        empty = {"file": partition.path, "size": partition.size, "head": b"", "number": 0, "data": b"", "reason": None}
        with system.open_input_file(partition.path) as file:
            at = lambda offset, n: file.read_at(max(0, min(n, partition.size - offset)), offset) if offset < partition.size else b""
            try:
                plan = self.layout(at, partition.size)
            except ValueError as error:
                if partition.begin == 0:
                    yield _batch([empty | {"reason": str(error)}])
                return
            head = at(0, self.head or plan.first)
            if not self.rows:
                yield _batch([empty | {"head": head}])
                return
            # The first record belongs to the range with the file's first byte, whatever comes before it.
            place = lambda byte: 0 if byte == 0 else -(-max(0, byte - plan.first) // plan.stride)
            low, high = (min(plan.count, place(byte)) for byte in (partition.begin, partition.end if partition.end < partition.size else plan.first + plan.count * plan.stride))
            if partition.begin == 0 and low == high:
                yield _batch([empty | {"head": head}])
            for number in range(low, high, self.rows):
                many = min(self.rows, high - number)
                yield _batch([empty | {"head": head, "number": number, "data": at(plan.first + number * plan.stride, many * plan.stride)}])


RECORDS = pa.schema([("file", pa.string()), ("size", pa.int64()), ("head", pa.binary()), ("number", pa.int64()), ("data", pa.binary()), ("reason", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, RECORDS)


LAYOUTS: dict[str, Callable] = {}


class RecordSource(DataSource):
    """format("binary_records"): options layout (a name in LAYOUTS), head, split (bytes of a partition) and rows (records of a row)."""

    @classmethod
    def name(cls) -> str:
        return "binary_records"

    def schema(self):
        return "file string, size bigint, head binary, number bigint, data binary, reason string"

    def reader(self, schema):
        from . import binary  # noqa: F401  its layouts

        o = self.options
        return RecordReader(o["path"], LAYOUTS[o["layout"]], int(o.get("head", 0)), int(o.get("split", SPLIT)), int(o.get("rows", 10_000)))


def read_records(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    spark.dataSource.register(RecordSource)
    return spark.read.format("binary_records").options(layout=layout, **options).load(path)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written, where they lie and where they go."""

    files: list[tuple[str, str]]


class PackedWriter(DataSourceArrowWriter):
    """A file for each track of sorted rows (track_id, head, points, n, data): the first has the head and how many points follow, others n points each.

    Files are written below _temporary and moved when all tasks have ended, so a failed job or task leaves none, and an
    attempt that was repeated leaves only one. A task holds one batch of rows.
    """

    def __init__(self, path: str, ending: str, overwrite: bool):
        self.path, self.ending, self.overwrite = path.rstrip("/"), ending, overwrite
        self.system, self.root = file_system(self.path)
        self.work = f"{self.root}/_temporary/{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, done, file, name, left = self.system, [], None, None, 0
        folder = f"{self.work}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)

        def close():
            if file is not None:
                file.close()
                if left:
                    raise ValueError(f"{left} points of {name} are missing")

        try:
            for batch in iterator:
                for row_name, head, points, n, data in zip(*(batch.column(c).to_pylist() for c in ("track_id", "head", "points", "n", "data")), strict=True):
                    if head is not None:
                        close()
                        name, left = row_name, points
                        target = f"{quote(str(name), safe=' -._(),=@')}.{self.ending}"
                        done.append((f"{folder}/{len(done)}", f"{self.root}/{target}"))
                        file = system.open_output_stream(done[-1][0])
                        file.write(head)
                    if data is not None:
                        if file is None or row_name != name:
                            raise ValueError(f"points of {row_name} come before its head")
                        file.write(data)
                        left -= n
            close()
        finally:
            if file is not None and not file.closed:
                file.close()
        return Written(done)

    def commit(self, messages) -> None:
        if self.overwrite:
            for info in self.system.get_file_info(fs.FileSelector(self.root, allow_not_found=True)):
                if info.type == fs.FileType.File and info.path.endswith(f".{self.ending}"):
                    self.system.delete_file(info.path)
        for message in messages:
            for source, target in message.files if message else []:
                self.system.move(source, target)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        for folder in (self.work, f"{self.root}/_temporary"):
            info = self.system.get_file_info([folder])[0]
            if info.type == fs.FileType.Directory and (folder == self.work or not self.system.get_file_info(fs.FileSelector(folder))):
                self.system.delete_dir(folder)


class PackedSink(DataSource):
    """format("packed_tracks"): writes rows of PackedWriter, sorted in their partitions, as a file for each track; option ending."""

    @classmethod
    def name(cls) -> str:
        return "packed_tracks"

    def writer(self, schema, overwrite):
        return PackedWriter(self.options["path"], self.options.get("ending", "gpb"), overwrite)


def write_packed(df: DataFrame, path: str, ending: str, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(PackedSink)
    df.write.format("packed_tracks").options(ending=ending).mode(mode).save(path)
