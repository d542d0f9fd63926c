"""CSV whose quoted fields may hold line feeds, read in byte ranges.

Whether a range begins within quotes depends on all before it. Each range first
tells, for every state that it could begin in, the state that it ends in; the chain
of these, a few letters a range, gives each range its own state. Then every range
cuts its rows at their true ends, and reads on beyond its own end for the last one.

States: S at the start of a row, N within a line outside quotes, Q within quotes,
C within a comment line (its first visible character is #). Fields with quotes are quoted
whole, and a quote in them is doubled; a quote elsewhere opens quotes too.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from helixframe.sources.fastq import BUFFER, PACKED, ROWS, Range, opened, ranges

STATES = "SNQC"


def after_line(state: str, line: bytes) -> str:
    """The state behind the line feed of a line, or of what is left of it."""
    if state == "C" or (state == "S" and line.lstrip().startswith(b"#")):
        return "S"
    return "S" if (line.count(b'"') % 2 == 0) == (state != "Q") else "Q"


def within_line(state: str, line: bytes) -> str:
    """The state behind a part of a line."""
    if not line or state == "C":
        return state
    if state == "S" and line.lstrip().startswith(b"#"):
        return "C"
    return "N" if (line.count(b'"') % 2 == 0) == (state != "Q") else "Q"


def pieces(store: fs.FileSystem, path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) without line feeds, from exactly `start` on."""
    stream = store.open_input_stream(path) if path.endswith(PACKED) else store.open_input_file(path)
    with stream:
        if start:
            stream.seek(start)
        rest, at = b"", start
        while block := stream.read(BUFFER):
            whole = (rest + block).split(b"\n")
            rest = whole.pop()
            for line in whole:
                yield at, line
                at += len(line) + 1
        if rest:
            yield at, rest


def ends(store: fs.FileSystem, part: Range) -> str:
    """The state at the range's end for each of STATES at its start."""
    now = {s: s for s in STATES}
    for at, line in pieces(store, part.path, part.start):
        if not part.path.endswith(PACKED) and at + len(line) >= part.end:  # its line feed is the next range's, or the file's end
            cut = line[: part.end - at]
            now = {s: within_line(x, cut) for s, x in now.items()}
            break
        seen = {x: after_line(x, line) for x in set(now.values())}
        now = {s: seen[x] for s, x in now.items()}
    return "".join(now[s] for s in STATES)


def rows(store: fs.FileSystem, part: Range, state: str) -> Iterator[tuple[int, list[str]]]:
    """(place, fields) of the rows that begin in the range; what it begins within belongs to the one before."""
    each = pieces(store, part.path, part.start)
    while state != "S":
        line = next(each, None)
        if line is None:
            return
        state = after_line(state, line[1])
    held: list[bytes] = []
    begin = part.start
    for at, line in each:
        if not held:
            if at >= part.end and not part.path.endswith(PACKED):
                return
            begin = at
            if line.lstrip().startswith(b"#"):
                continue
        state = after_line("Q" if held else "S", line)
        held.append(line)
        if state == "S":
            yield from parsed(begin, held)
            held = []
    if held:
        yield from parsed(begin, held)


def parsed(at: int, lines: list[bytes]) -> Iterator[tuple[int, list[str]]]:
    text = b"\n".join(lines).decode("utf-8", "replace").removeprefix("﻿")
    if text:
        yield at, next(csv.reader([x + "\n" for x in text.split("\n")], strict=False))


class QuotedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size, self.starts = options["path"], int(options.get("rangebytes", 64 << 20)), options.get("starts")

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        names = ["fields", "file", "at", "range"]
        if self.starts is None:
            yield pa.RecordBatch.from_arrays([pa.array([[ends(store, partition)]], pa.list_(pa.string())), pa.array([partition.path]), pa.array([partition.start]), pa.array([partition.number], pa.int32())], names)
            return
        held: list[tuple[int, list[str]]] = []

        def batch() -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([f for _, f in held], pa.list_(pa.string())), pa.array([partition.path] * n), pa.array([a for a, _ in held], pa.int64()), pa.array([partition.number] * n, pa.int32())], names)

        for row in rows(store, partition, self.starts[partition.number]):
            held.append(row)
            if len(held) == ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class QuotedSource(DataSource):
    """fields, file, at (a row's first byte) and range; without the option `starts` a row a range, whose one field is what ends() says."""

    @classmethod
    def name(cls) -> str:
        return "quoted_csv"

    def schema(self) -> str:
        return "fields array<string>, file string, at long, range int"

    def reader(self, schema) -> QuotedReader:
        return QuotedReader(dict(self.options))


def read_rows(spark: SparkSession, path: str, range_bytes: int = 64 << 20):
    """fields, file, at, range of all rows of CSV files, the headers included."""
    spark.dataSource.register(QuotedSource)
    source = spark.read.format("quoted_csv").option("rangeBytes", range_bytes)
    said = sorted((r["range"], r["at"], r["fields"][0]) for r in source.load(path).collect())  # a row a range
    starts, state = "", "S"
    for _, at, then in said:
        state = state if at else "S"  # a file begins
        starts += state
        state = then[STATES.index(state)]
    return source.option("starts", starts).load(path)
