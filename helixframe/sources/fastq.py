"""FASTQ as a data source: byte ranges that find their own first record, read in Arrow batches.

A range owns the records whose header begins in it. It finds the first by itself:
of the four lines from where it begins, a header is one with `@` whose second
next line begins with `+` and whose first and third next lines are equally long,
and so for all records of the next `SURE`. Quality lines may begin with `@`, but the
lines around them don't agree then; where more than one line would do, or none,
the range counts the lines of the file before it. No line crosses the cluster.

Paths are what `pyarrow.fs` reads: local folders, and URIs of the stores it knows.
Compressed files are one range each. Files are read in the order of their names; names
that begin with `_` or `.` are none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "read_id string, seq string, qual string, file string, at long, range int, number long"
SURE = 8  # records that have to agree
ROWS = 4096  # records of a batch
BUFFER = 1 << 20
PACKED = (".gz", ".bz2", ".zst", ".lz4")


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    number: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    parts = urlsplit(path)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder by name."""
    store, where = opened(path)
    found = store.get_file_info(where)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [(where, found.size)]
    inside = store.get_file_info(fs.FileSelector(where))
    return sorted((x.path, x.size) for x in inside if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def ranges(path: str, size: int) -> list[Range]:
    """Ranges of equal length, of `size` bytes at most, in each file."""
    out = []
    for name, length in files(path):
        parts = 1 if name.endswith(PACKED) else max(1, -(-length // size))
        out += [Range(name, length * k // parts, length * (k + 1) // parts, len(out) + k) for k in range(parts)]
    return out


def lines(store: fs.FileSystem, path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) without line ends, from the first line that begins at `start` or later."""
    stream = store.open_input_stream(path) if path.endswith(PACKED) else store.open_input_file(path)
    with stream:
        at = max(start - 1, 0)
        if start:
            stream.seek(at)
        rest, skip = b"", start > 0
        while block := stream.read(BUFFER):
            whole = (rest + block).split(b"\n")
            rest = whole.pop()
            for line in whole:
                if not skip:
                    yield at, line.rstrip(b"\r")
                skip, at = False, at + len(line) + 1
        if rest and not skip:
            yield at, rest.rstrip(b"\r")


def _record(four: list[bytes]) -> bool:
    return len(four) == 4 and four[0].startswith(b"@") and four[2].startswith(b"+") and len(four[1]) == len(four[3])


def first_record(store: fs.FileSystem, path: str, start: int) -> int | None:
    """Which of the lines from `start` on is the first header: 0 to 3; None if there is no line."""
    ahead = [line for _, line in islice(lines(store, path, start), 4 * SURE + 3)]
    if not ahead:
        return None
    records = [[ahead[k : k + 4] for k in range(first, len(ahead) - 3, 4)] for first in range(4)]
    good = [first for first, some in enumerate(records) if some and all(map(_record, some))]
    if len(good) == 1:
        return good[0]
    return -sum(1 for _ in takewhile(lambda x: x[0] < start, lines(store, path, 0))) % 4


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = options["path"], int(options.get("rangebytes", 64 << 20))
        self.firsts = json.loads(options.get("firsts", "[]"))  # number of each range's first record

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        first = first_record(store, partition.path, partition.start) if partition.start else 0
        if first is None:
            return
        number = self.firsts[partition.number] if self.firsts else 0
        each = lines(store, partition.path, partition.start)
        for _ in range(first):
            next(each, None)
        held: list[tuple[bytes, bytes, bytes, int]] = []
        for at, head in each:
            if not partition.path.endswith(PACKED) and at >= partition.end:
                break
            four = [head, *(x[1] for x in (next(each, None) for _ in range(3)) if x)]
            if not _record(four):
                raise ValueError(f"no read: {partition.path}, byte {at}")
            held.append((four[0][1:], four[1], four[3], at))
            if len(held) == ROWS:
                yield self.batch(held, partition, number)
                number += len(held)
                held = []
        if held:
            yield self.batch(held, partition, number)

    def batch(self, held: list[tuple[bytes, bytes, bytes, int]], partition: Range, number: int) -> pa.RecordBatch:
        name, seq, qual, at = zip(*held, strict=True)
        n = len(held)
        columns = [*(pa.array(x, pa.binary()).cast(pa.string()) for x in (name, seq, qual)), pa.array([partition.path] * n), pa.array(at, pa.int64()), pa.array([partition.number] * n, pa.int32()), pa.array(range(number, number + n), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["read_id", "seq", "qual", "file", "at", "range", "number"])


class FastqSource(DataSource):
    """`spark.read.format("fastq").option("rangeBytes", n).load(path)`: read_id, seq, qual, and where each record stands."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options))
