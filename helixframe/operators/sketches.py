"""Theta sketches of samples: small, stored once a sample and day, merged and intersected without the rows behind them.

A sketch of 2 ** SIZE entries is exact up to so many distinct values, and beyond has a
standard error of about 1 / sqrt(2 ** SIZE) of the union that it is compared within.
Where exact counts of any number are wanted, the values are dealt to slices, each with
sketches of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import written

SIZE = 12


def sketched(df: DataFrame, by: Sequence[str], value: str, size: int = SIZE) -> DataFrame:
    """by, sketch, n (rows): one sketch of the distinct values of each group; nulls don't count."""
    return df.groupBy(*by).agg(F.theta_sketch_agg(F.col(value), size).alias("sketch"), F.count(value).alias("n"))


def merged(sketches: DataFrame, by: Sequence[str], size: int = SIZE) -> DataFrame:
    """by, sketch, n: sketches of finer groups put together; equal to the sketch of all their rows."""
    return sketches.groupBy(*by).agg(F.theta_union_agg("sketch", size).alias("sketch"), F.sum("n").alias("n"))


def distinct_values(sketch: Column | str = "sketch") -> Column:
    """How many distinct values a sketch holds, exactly or as an estimate."""
    return F.theta_sketch_estimate(sketch)


def slices(df: DataFrame, value: str, size: int = SIZE) -> int:
    """Into how many slices the distinct values are to be dealt, so that sketches of a slice stay exact: an eighth full on average, as counted to some percent."""
    n = df.agg(F.approx_count_distinct(value, 0.02)).first()[0]
    return max(1, -(-n // (1 << size - 3)))


def sliced(df: DataFrame, value: str, many: int, name: str = "slice") -> DataFrame:
    """df with the slice of each value."""
    return df.withColumn(name, F.pmod(F.xxhash64(value), F.lit(many)).cast("int"))


def overlaps(sketches: DataFrame, by: str, size: int = SIZE, slice_by: str | None = None) -> DataFrame:
    """a, b, in_a, in_b, shared, either, jaccard: of each two groups (one row each, a < b), from their sketches alone.

    With `slice_by` a group has a row for each slice of the values that it holds, and
    the counts are sums over all slices: as exact as the sketches of each.
    """
    if slice_by:
        rows = sketches.select(F.col(by).alias("g"), F.col(slice_by).alias("k"), "sketch")
        left, right = (rows.select("k", F.col("g").alias(side), F.col("sketch").alias(f"s_{side}")) for side in "ab")
        both = F.theta_sketch_estimate(F.theta_intersection("s_a", "s_b"))
        met = left.join(right, "k").filter("a < b").groupBy("a", "b").agg(F.sum(both).alias("shared"))
        sizes = written(rows.groupBy("g").agg(F.sum(distinct_values()).alias("n")), "sizes")
        pairs = sizes.select(F.col("g").alias("a"), F.col("n").alias("in_a")).join(sizes.select(F.col("g").alias("b"), F.col("n").alias("in_b")), F.col("a") < F.col("b"))
        counted = pairs.join(met, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0).cast("long")))
        counted = counted.select("a", "b", "in_a", "in_b", "shared", (F.col("in_a") + F.col("in_b") - F.col("shared")).alias("either"))
    else:
        left, right = (sketches.select(F.col(by).alias(side), F.col("sketch").alias(f"s_{side}")) for side in "ab")
        pairs = left.join(right, F.col("a") < F.col("b"))  # groups, not rows
        both, either = F.theta_sketch_estimate(F.theta_intersection("s_a", "s_b")), F.theta_sketch_estimate(F.theta_union("s_a", "s_b", size))
        counted = pairs.select("a", "b", distinct_values("s_a").alias("in_a"), distinct_values("s_b").alias("in_b"), both.alias("shared"), either.alias("either"))
    return counted.withColumn("jaccard", F.when(F.col("either") > 0, F.col("shared") / F.col("either")))
