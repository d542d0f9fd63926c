"""Table functions for SQL: rows out of a value (LATERAL) or of a group of rows (TABLE(...) PARTITION BY ...)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DataType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from helixframe.operators.fuzzy import edit_alignment

CONSUMES = {"M": (1, 1), "=": (1, 1), "X": (1, 1), "I": (0, 1), "S": (0, 1), "D": (1, 0), "N": (1, 0), "H": (0, 0), "P": (0, 0)}  # reference, read


def _constant(arg: AnalyzeArgument | None, default: int, least: int, what: str) -> int:
    if arg is None:
        return default
    if not arg.isConstantExpression or not isinstance(arg.value, int) or arg.value < least:
        raise ValueError(f"{what} must be a constant of {least} or more")
    return arg.value


def _text(arg: AnalyzeArgument, what: str) -> None:
    if arg.isTable or arg.dataType != StringType():
        raise ValueError(f"{what} must be a string")


class ExplodeResidues:
    """explode_residues(seq [, width]): pos (from 1) and residue, or with a width (3: codon) each whole stretch of so many."""

    @staticmethod
    def analyze(seq: AnalyzeArgument, width: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(seq, "seq")
        n = _constant(width, 1, 1, "width")
        return AnalyzeResult(StructType([StructField("pos", IntegerType()), StructField("residue" if n == 1 else "codon" if n == 3 else "stretch", StringType())]))

    def eval(self, seq: str | None, width: int = 1) -> Iterator[tuple[int, str]]:
        for k in range(len(seq or "") // width):
            yield k + 1, seq[k * width : (k + 1) * width]


class CigarObservations:
    """cigar_obs(TABLE(t) PARTITION BY name): name, ref_pos, base (- for a deletion), q (99 where qualities are `*`) for each covered reference position.

    The table has pos, cigar, seq and qual; the column that it is partitioned by comes first.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("cigar_obs takes a table")
        missing = {"pos", "cigar", "seq", "qual"} - set(rows.dataType.names)
        if missing:
            raise ValueError(f"the table lacks {sorted(missing)}")
        first: tuple[str, DataType] = (rows.dataType.names[0], rows.dataType.fields[0].dataType)
        return AnalyzeResult(StructType([StructField(*first), StructField("ref_pos", IntegerType()), StructField("base", StringType()), StructField("q", IntegerType())]))

    def eval(self, row: Row) -> Iterator[tuple[object, int, str, int]]:
        at, read, n = int(row["pos"]), 0, ""
        for c in row["cigar"] or "":
            if c.isdigit():
                n += c
                continue
            on_reference, on_read = CONSUMES[c]
            for k in range(int(n) if on_reference else 0):
                base = row["seq"][read + k : read + k + 1] if on_read else "-"
                q = 0 if not on_read else 99 if row["qual"] == "*" else ord(row["qual"][read + k]) - 33
                yield row[0], at + k, base, q
            at, read, n = at + int(n) * on_reference, read + int(n) * on_read, ""


class EditAlignment:
    """edit_alignment(a, b [, width]): distance, top, marks, bottom; with a width a row for each block of so many columns."""

    @staticmethod
    def analyze(a: AnalyzeArgument, b: AnalyzeArgument, width: AnalyzeArgument | None = None) -> AnalyzeResult:
        _text(a, "a")
        _text(b, "b")
        block = [] if width is None else [StructField("block", IntegerType())]
        if width is not None:
            _constant(width, 60, 1, "width")
        return AnalyzeResult(StructType([StructField("distance", IntegerType()), *block, *(StructField(c, StringType()) for c in ("top", "marks", "bottom"))]))

    def eval(self, a: str | None, b: str | None, width: int | None = None) -> Iterator[tuple]:
        distance, *lines = edit_alignment(a or "", b or "")
        if width is None:
            yield distance, *lines
            return
        for k in range(max(1, -(-len(lines[0]) // width))):
            yield distance, k + 1, *(x[k * width : (k + 1) * width] for x in lines)


FUNCTIONS = {"explode_residues": ExplodeResidues, "cigar_obs": CigarObservations, "edit_alignment": EditAlignment}


def register_table_functions(spark: SparkSession) -> list[str]:
    """Registers the table functions for SQL; their names."""
    for name, made in FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
    return list(FUNCTIONS)
