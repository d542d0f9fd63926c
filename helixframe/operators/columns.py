"""Resolving, adding and choosing columns by their names and types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQUENCE_NAMES = ("sequence", "motif1_sequence", "protein_sequence")


def find_column(columns: Sequence[str], wanted: str | None = None, names: Sequence[str] = SEQUENCE_NAMES, fuzzy: bool = False) -> str:
    """The wanted column, or the first of several names; without regard to case, then (if fuzzy) as a part of a name."""
    lower = {c.lower().strip(): c for c in reversed(columns)}
    for name in [wanted] if wanted else names:
        if name.lower().strip() in lower:
            return lower[name.lower().strip()]
    if fuzzy:
        for name in [wanted] if wanted else names:
            for c in columns:
                if name.lower() in c.lower():
                    return c
    raise ValueError(f"none of {[wanted] if wanted else list(names)} among {list(columns)}")


def by_position(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first columns of df under new names."""
    if len(df.columns) < len(names):
        raise ValueError(f"{len(names)} columns are needed, {len(df.columns)} are there")
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=False)))


def with_columns(df: DataFrame, columns: dict[str, str], blank: Sequence[str] = ()) -> DataFrame:
    """df with all of the given columns (name to type), NULL where missing; those in blank are '' instead."""
    out = df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})
    return out.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in blank})


def shared_features(frames: Sequence[DataFrame], exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that all frames have, in the order of the first one."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    kinds = [{n for n, t in f.dtypes if t in numeric or t.startswith("decimal")} for f in frames]
    return [c for c in frames[0].columns if c not in exclude and all(c in k for k in kinds)]


def derived_sums(df: DataFrame, sums: dict[str, tuple[str, ...]]) -> tuple[DataFrame, list[str]]:
    """df with sums of columns that exist, and the names of the sums that were skipped."""
    found = {n: cs for n, cs in sums.items() if all(c in df.columns for c in cs)}
    made = {n: sum((F.col(c) for c in cs[1:]), F.col(cs[0])) for n, cs in found.items()}
    return df.withColumns(made), [n for n in sums if n not in found]


def sequences(df: DataFrame, column: str | None = None, keep_blank: bool = False) -> DataFrame:
    """The sequence column alone; trimmed and without blanks unless these are kept."""
    c = F.col(f"`{find_column(df.columns, column)}`")
    return df.select(c.alias("sequence")) if keep_blank else df.select(F.trim(c).alias("sequence")).filter("sequence <> ''")


def safe_name(c: Column) -> Column:
    """A name that any file system takes: runs of other characters as one underscore, none of it at the ends; `property` for nothing."""
    safe = F.regexp_replace(F.regexp_replace(c.cast("string"), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("property"))


def fixed(c: Column, digits: int) -> Column:
    """A number with so many decimals; the exact value decides, and a tie goes to the even digit."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits))


def short_number(c: Column) -> Column:
    """1234567 as 1.23M: two decimals for billions and millions, one for thousands."""
    n = c.cast("double")
    parts = ((1e9, 2, "B"), (1e6, 2, "M"), (1e3, 1, "K"))
    out = c.cast("long").cast("string")
    for least, digits, unit in reversed(parts):
        out = F.when(n >= least, F.concat(fixed(n / least, digits), F.lit(unit))).otherwise(out)
    return out


def p_label(c: Column) -> Column:
    """A p-value as text: below 0.001 with an exponent."""
    return F.when(c < 0.001, F.format_string("%.2e", c)).otherwise(fixed(c, 3))
