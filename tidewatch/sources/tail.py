"""A tail of growing files as a Structured Streaming source: appended bytes, by whole lines.

An offset is a map of file to the end of its last whole line and a mark of the file's identity, so what a
batch reads follows from its two offsets alone and a restart goes on where the checkpoint ends.
"""

from __future__ import annotations

import fnmatch
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidewatch.functions.text import stripped

#: Bytes of a file that one task reads, bytes read at once, and bytes of a first line that count for identity.
PART, BLOCK, HEAD = 16 << 20, 1 << 20, 1024
SCHEMA = "source_id string, position long, raw string"


@dataclass
class Range(InputPartition):
    """The lines of a file that start in [start, end). A start within the file is not the start of a line
    unless the byte before it ends one."""

    path: str
    start: int
    end: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; paths without a scheme are local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, inside_too: bool = False) -> list[fs.FileInfo]:
    """The files that a path names: a file, the files of a folder (`inside_too`: and of the folders in it), or those
    of a folder whose names fit a pattern. Hidden ones, and names that start with `_`, are passed over; a folder that is not there has none."""
    store, inside = _store(path)
    folder, _, name = inside.rpartition("/")
    if any(c in name for c in "*?["):
        found = [f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if fnmatch.fnmatchcase(f.base_name, name)]
    else:
        one = store.get_file_info(inside)
        found = [one] if one.is_file else store.get_file_info(fs.FileSelector(inside, allow_not_found=True, recursive=inside_too))
    return sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


def whole_lines(f: pa.NativeFile, size: int) -> int:
    """The place after the last line end in the first `size` bytes, looked for from there backwards."""
    end = size
    while end:
        start = max(0, end - BLOCK)
        f.seek(start)
        at = f.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


def mark(f: pa.NativeFile, path: str, local: bool) -> str:
    """What a file is known by when it has grown, or has another name: its first line, and where the store tells
    it, its inode."""
    f.seek(0)
    head = f.read(HEAD)
    end = head.find(b"\n")
    first = head[: end + 1] if end >= 0 else head if len(head) == HEAD else b""
    return f"{os.stat(path).st_ino if local else 0}-{zlib.crc32(first):08x}"


def state_of(path: str) -> dict[str, dict]:
    """For each file that has a whole line: at (where the last one ends) and id."""
    store, _ = _store(path)
    local, out = isinstance(store, fs.LocalFileSystem), {}
    for info in listed(path):
        try:
            with store.open_input_file(info.path) as f:
                at = whole_lines(f, info.size)
                if at:
                    out[info.path] = {"at": at, "id": mark(f, info.path, local)}
        except FileNotFoundError:  # it went since it was listed
            continue
    return out


def ranges(start: dict[str, dict], end: dict[str, dict], part: int) -> list[Range]:
    """What was added between two states, in ranges of `part` bytes at most. A file that is another
    one than before, or shorter, is read from its start; one that has taken another name goes on where it
    was under the old one."""
    moved = {s["id"]: s["at"] for p, s in start.items() if end.get(p, {}).get("id") != s["id"]}
    out = []
    for path, now in sorted(end.items()):
        old = start.get(path)
        known = old["at"] if old and old["id"] == now["id"] else moved.get(now["id"], 0)
        begin = known if known <= now["at"] else 0
        out += [Range(path, a, min(a + part, now["at"])) for a in range(begin, now["at"], part)]
    return out


def lines_of(store: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that start in the range, read in blocks. A file that has lost bytes since
    gives what is left."""
    with store.open_input_file(part.path) as f:
        size = f.size()
        at = max(0, part.start - 1)  # if the byte before ends a line, one starts here
        if at >= min(part.end, size):
            return
        f.seek(at)
        held, skip = [], part.start > 0  # pieces of a line that goes on
        while block := f.read(BLOCK):
            first, *more = block.split(b"\n")
            held.append(first)
            for piece in more:
                line, held = b"".join(held), [piece]
                if skip:
                    skip = False
                else:
                    yield at, line
                at += len(line) + 1
                if at >= part.end:
                    return
        if not skip and (line := b"".join(held)):
            yield at, line


def batches_of(path: str, part: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range in the store of `path`, in batches of about BLOCK bytes."""
    store, _ = _store(path)
    at, raw, held = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(raw, pa.string())], ["source_id", "position", "raw"])

    for position, line in lines_of(store, part):
        at.append(position)
        raw.append(line.decode("utf-8", "replace"))
        held += len(line)
        if held >= BLOCK or len(at) >= 10_000:
            yield batch()
            at, raw, held = [], [], 0
    if at:
        yield batch()


class _Grown(DataSourceStreamReader):
    def __init__(self, path: str, part: int, at_end: bool):
        self.path, self.part, self.at_end = path, part, at_end

    def initialOffset(self) -> dict:
        return {"files": state_of(self.path) if self.at_end else {}}

    def latestOffset(self) -> dict:
        return {"files": state_of(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start["files"], end["files"], self.part)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches_of(self.path, partition)


class _Whole(DataSourceReader):
    def __init__(self, path: str, part: int):
        self.path, self.part = path, part

    def partitions(self) -> list[Range]:
        return ranges({}, state_of(self.path), self.part) or [Range("", 0, 0)]  # Spark wants one at least

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches_of(self.path, partition) if partition.end else iter(())


class TailSource(DataSource):
    """Options: path; startAtEnd ("true": lines that are there when the query starts first are left out);
    part (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "tidewatch_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Whole(self.options["path"], int(self.options.get("part", PART)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Grown(self.options["path"], int(self.options.get("part", PART)), self.options.get("startAtEnd", "true").lower() == "true")


def tail_lines(spark: SparkSession, path: str, process_existing: bool = False, stream: bool = True, part: int = PART) -> DataFrame:
    """(source_id, line_no, raw) of the lines that are appended to files: stripped, blank ones dropped, invalid
    UTF-8 replaced. source_id is the path, line_no the byte at which the line starts.

    `path` names a file, a folder or a folder with a pattern for names, in a store that the driver and all
    executors reach through pyarrow. A line counts once its end is written, so one that is being
    written comes whole in a later batch, also if it began before the query did. A file that has become
    shorter, or is another one under the same name, is read from its start; one that was renamed
    goes on under its new name. If a file loses lines before they were read, or is cut and grows again over its
    old length with the same first line between two batches, those lines can't be told and are not read.
    The first start leaves existing lines out unless `process_existing`; later ones go on from the checkpoint.
    The offset has an entry for each file that is there, so old files should be moved away or deleted.
    Without `stream`: all whole lines, as a batch. Ranges of `part` bytes are read by tasks of their own.
    """
    spark.dataSource.register(TailSource)
    reader = (spark.readStream if stream else spark.read).format(TailSource.name())
    read = reader.option("path", path).option("startAtEnd", str(not process_existing).lower()).option("part", str(part)).load()
    return read.select("source_id", F.col("position").alias("line_no"), stripped(F.col("raw")).alias("raw")).where("raw <> ''")
