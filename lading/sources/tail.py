"""Logs that grow while they are read: a streaming source with a byte offset a file.

Spark's file source takes a file as it is when first seen.  Here an offset
tells how far each file of a folder has been read; a micro-batch takes the
rows written since, each file's in a task of its own, and a row that is only half
written waits for its end.  A restart goes on at the offsets of its checkpoint.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lading import schemas
from lading.sources.events import enforce_event_format
from lading.sources.files import open_filesystem

NAME = "lading-tail"
MOST_BYTES = 64 << 20  # of a file in one micro-batch, if its rows aren't longer
BLOCK = 1 << 20
QUOTE, LINE = b'"', b"\n"


class Part(InputPartition):
    """Whole rows of a file, from byte `start` to `end`."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def whole_rows(source, start: int, size: int, most: int = MOST_BYTES) -> int:
    """End of the last whole row from `start` on: a line break outside quotes.

    Goes through the bytes written since, block by block; not beyond `most`
    once a row has ended.
    """
    end = at = start
    inside = False
    source.seek(start)
    while at < size and (end == start or at - start < most):
        block = source.read(min(BLOCK, size - at))
        if not block:
            break
        # between quotes, every second piece lies outside
        place = 0
        for n, piece in enumerate(block.split(QUOTE)):
            if not inside ^ (n % 2 == 1):
                found = piece.rfind(LINE)
                if found >= 0:
                    end = at + place + found + 1
            place += len(piece) + 1
        inside ^= block.count(QUOTE) % 2 == 1
        at += len(block)
    return end


def parse_rows(data: bytes, chunk: str) -> Iterator[tuple]:
    """Event fields, `problem` and `chunk` of each row; text fields are never NULL."""
    width = len(schemas.EVENT_FIELDS)
    for row in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline=""), delimiter="\t"):
        if not row:
            continue
        fields = (row + [""] * width)[:width]
        named = dict(zip(schemas.EVENT_FIELDS, fields, strict=True))
        missing = [f for f in schemas.EVENT_REQUIRED if not named[f]]
        problem = None
        if len(row) != width:
            problem = "wrong number of columns"
        elif missing:
            problem = "missing required fields: " + ", ".join(missing)
        yield (*fields, problem, chunk)


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """How far whole rows go in each file; only bytes that weren't there before are looked at."""
        filesystem, root = open_filesystem(self.path)
        infos = filesystem.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in infos:
            name = info.path[len(root) :].lstrip("/")
            hidden = any(part[:1] in ("_", ".") for part in name.split("/"))
            if info.type != pafs.FileType.File or hidden or info.size <= self.known.get(name, 0):
                continue
            with filesystem.open_input_file(info.path) as source:
                self.known[name] = whole_rows(source, self.known.get(name, 0), info.size, self.most)
        return {"files": dict(sorted(self.known.items()))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        for name, at in start["files"].items():  # after a restart these rows needn't be looked at again
            self.known[name] = max(at, self.known.get(name, 0))
        return [
            Part(name, start["files"].get(name, 0), to)
            for name, to in end["files"].items()
            if to > start["files"].get(name, 0)
        ]

    def read(self, partition: Part) -> Iterator[tuple]:
        filesystem, root = open_filesystem(self.path)
        with filesystem.open_input_file(f"{root.rstrip('/')}/{partition.path}") as source:
            source.seek(partition.start)
            data = source.read(partition.end - partition.start)
        yield from parse_rows(data, f"{self.path.rstrip('/')}/{partition.path}")


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return f"{schemas.EVENTS}, problem string, chunk string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("maxbytesperfile", MOST_BYTES)))


def tail_events(spark: SparkSession, path: str, strict: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Follow a folder of logs that grow, `most_bytes` of each file in a micro-batch.

    Rows as of `read_events`: event fields, `problem` of a malformed row,
    `chunk`.  Files whose names start with `_` or `.` are left out, as are
    files that get shorter; a file must only ever be appended to.
    """
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format(NAME).option("path", path).option("maxBytesPerFile", most_bytes).load()
    return enforce_event_format(rows, strict)
