"""Lines of files that grow: a source whose offset is the byte up to which every file was read.

Each file is read once, up to the end of its last complete line; a half line waits until it is whole.  Bytes between
two offsets are cut into blocks, and a block yields the lines that begin in it, so one large file is read by many tasks.
Files may be local or in a store that Arrow reads.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Tasks get the classes of this module with the job, so that it need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "growing_lines"
SCHEMA = "value string, file string, start bigint"
BLOCK = 64 * 1024**2
CHUNK = 1024**2  # bytes that are read at once
LINES = 4096  # of a batch


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> dict[str, int]:
    """Names and sizes of a file, or of the files of a folder; hidden ones are left out."""
    store, base = _store(path)
    found = store.get_file_info(base)
    if found.type == fs.FileType.Directory:
        inside = store.get_file_info(fs.FileSelector(base, recursive=True))
        listed = [f for f in inside if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
    else:
        listed = [found] if found.type == fs.FileType.File else []
    return {f.path: f.size for f in listed}


def _complete(store: fs.FileSystem, file: str, done: int, size: int) -> int:
    """Where the last complete line of a file ends; looks back from its end no further than to ``done``."""
    with store.open_input_file(file) as data:
        end = size
        while end > done:
            begin = max(done, end - CHUNK)
            data.seek(begin)
            place = data.read(end - begin).rfind(b"\n")
            if place >= 0:
                return begin + place + 1
            end = begin
    return done


def grown(path: str, done: dict[str, int]) -> dict[str, int]:
    """The offset that follows ``done``: for every file the end of its last complete line."""
    store, _ = _store(path)
    following = dict(done)
    for file, size in _files(path).items():
        before = done.get(file, 0)
        if size < before:
            raise ValueError(f"{file} has shrunk from {before} to {size} bytes; growing files are only appended to")
        end = _complete(store, file, before, size) if size > before else before
        if end:
            following[file] = end
    return following


class Block(InputPartition):
    """The lines that begin in a range of bytes, none of which goes beyond ``end``."""

    def __init__(self, file: str, begin: int, stop: int, first: int, end: int):
        self.file, self.begin, self.stop, self.first, self.end = file, begin, stop, first, end


def blocks(before: dict[str, int], after: dict[str, int], size: int) -> list[Block]:
    found = []
    for file in sorted(after):
        first, end = before.get(file, 0), after[file]
        found += [Block(file, begin, min(begin + size, end), first, end) for begin in range(first, end, size)]
    return found


def _read(path: str, block: Block) -> Iterator[pa.RecordBatch]:
    """The lines of a block with the file and the byte at which each begins."""
    store, _ = _store(path)
    values, starts = [], []

    def batch() -> pa.RecordBatch:
        files = pa.array([block.file] * len(values), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), files, pa.array(starts, pa.int64())], names=["value", "file", "start"])

    with store.open_input_file(block.file) as data:
        # A line that begins at the first byte belongs here; whether one does, the byte before tells.
        place = block.begin if block.begin == block.first else block.begin - 1
        data.seek(place)
        skipping, rest = block.begin != block.first, b""
        while place < block.end:
            chunk = data.read(min(CHUNK, block.end - place))
            place += len(chunk)
            lines = (rest + chunk).split(b"\n")
            start = place - len(rest) - len(chunk)
            rest = lines.pop()
            for line in lines:
                if not skipping:
                    if start >= block.stop:
                        break
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    starts.append(start)
                    if len(values) >= LINES:
                        yield batch()
                        values, starts = [], []
                skipping = False
                start += len(line) + 1
            if not skipping and start >= block.stop:
                break
    if values:
        yield batch()


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, block: int):
        self.path, self.block = path, block

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *limits) -> dict:
        # The files that were read to the end are known from the offset before, which a reader isn't told; a file's
        # complete lines end at the same byte however often that is looked up.
        return grown(self.path, {})

    def partitions(self, start: dict, end: dict) -> list[Block]:
        return blocks(start, end, self.block)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class _Batch(DataSourceReader):
    def __init__(self, path: str, block: int, before: dict[str, int], after: dict[str, int]):
        self.path, self.block, self.before, self.after = path, block, before, after

    def partitions(self) -> list[Block]:
        return blocks(self.before, self.after, self.block) or [Block("", 0, 0, 0, 0)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition) if partition.file else iter(())


class GrowingLines(DataSource):
    """Options: ``path``; ``blockBytes``; for a batch ``before`` and ``after``, offsets as JSON."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _block(self) -> int:
        return int(self.options.get("blockBytes", BLOCK))

    def reader(self, schema) -> DataSourceReader:
        before = json.loads(self.options.get("before", "{}"))
        after = json.loads(self.options["after"]) if "after" in self.options else grown(self.options["path"], before)
        return _Batch(self.options["path"], self._block(), before, after)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], self._block())


def lines_between(spark: SparkSession, path: str, before: dict[str, int] | None = None, block: int = BLOCK) -> tuple[DataFrame, dict[str, int]]:
    """``value, file, start`` of the complete lines that come after ``before``, and the offset to go on from.

    An offset holds the byte up to which each file was read; none means from the beginning.  Lines end in a line
    feed, a carriage return before it is not part of them, and bytes that are no UTF-8 are replaced.
    """
    spark.dataSource.register(GrowingLines)
    before = before or {}
    after = grown(path, before)
    reading = spark.read.format(NAME).option("path", path).option("blockBytes", block)
    return reading.option("before", json.dumps(before)).option("after", json.dumps(after)).load(), after


def stream_of_lines(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The same as a stream; its checkpoint holds the offset."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format(NAME).option("path", path).option("blockBytes", block).load()
