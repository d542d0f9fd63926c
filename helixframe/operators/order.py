"""Exact order statistics of any number of groups at any size, by distributed selection.

Values become integers of the same order. A round counts, for each group and each
range that still holds a wanted rank, the rows by the next 16 bits, combined
before the shuffle; the bin that holds the rank is the next range. After four rounds
the range is one value. No state grows with the distinct values of a group, and all
groups and ranks share the rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import written
from helixframe.operators.relational import small_side

STEP = 16  # bits


def _flipped(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _ordered(x: Column) -> Column:
    """A long for a double, in the same order."""
    return F.pandas_udf(lambda s: pd.Series(_flipped((s.to_numpy(np.float64) + 0.0).view(np.int64))), "long")(x)


def _value(key: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(_flipped(s.to_numpy(np.int64)).view(np.float64)), "double")(key)


def _group(by: Sequence[str]) -> Column:
    """One column for the group, equal for equal nulls."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def percentiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], weight: str | None = None) -> DataFrame:
    """by, p0, p1, ...: the percentile of each share, between the two nearest ranks in proportion.

    A row counts `weight` times (an integer); nulls, NaN and weights that aren't
    positive don't count, and a group without a value has no row.
    """
    x = F.col(value).cast("double")
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    usable = df.filter(x.isNotNull() & ~F.isnan(x) & (times > 0))
    rows = written(usable.select(_group(by).alias("g"), _ordered(x).alias("key"), times.alias("w")), "ordered")
    zero = F.lit(0).cast("long")
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in shares]
    ends = [(F.floor(p).cast("long"), F.ceil(p).cast("long")) for p in place]
    wanted = totals = None
    for shift in range(64 - STEP, -1, -STEP):
        bin_ = F.shiftright("key", shift).alias("bin")
        if wanted is None:
            counts = written(rows.groupBy("g", zero.alias("range"), bin_).agg(F.sum("w").alias("n")), "bins")
            totals = written(counts.groupBy("g").agg(F.sum("n").alias("n")), "totals")
            ranks = F.explode(F.array_distinct(F.array(*(e for two in ends for e in two))))
            wanted = totals.select("g", zero.alias("range"), ranks.alias("rank")).withColumn("left", F.col("rank"))
        else:
            held = rows.withColumn("range", F.shiftright("key", shift + STEP)).join(small_side(wanted.select("g", "range").distinct()), ["g", "range"])
            counts = written(held.groupBy("g", "range", bin_).agg(F.sum("w").alias("n")), "bins")
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "range").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), zero)
        placed = counts.withColumn("before", before)  # 65,536 bins of a range at most
        found = wanted.join(placed, ["g", "range"]).filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        wanted = written(found.select("g", F.col("bin").alias("range"), "rank", (F.col("left") - F.col("before")).alias("left")), "ranges")
    read = wanted.select("g", "rank", _value(F.col("range")).alias("value")).join(totals, "g")
    at = [[F.max(F.when(F.col("rank") == e, F.col("value"))) for e in two] for two in ends]
    whole = read.groupBy("g", "n").agg(*(c.alias(f"{side}{k}") for k, two in enumerate(at) for side, c in zip("ab", two, strict=True)))
    between = [F.when(F.col(f"a{k}") == F.col(f"b{k}"), F.col(f"a{k}")).otherwise(F.col(f"a{k}") + (p - e[0]) * (F.col(f"b{k}") - F.col(f"a{k}"))).alias(f"p{k}") for k, (p, e) in enumerate(zip(place, ends, strict=True))]
    return whole.select(*(F.col(f"g.`{c}`").alias(c) for c in by), *between)


def with_percentiles(df: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """df, of a row a group, with the columns of `found`, of a row a group too; groups are equal if their nulls are."""
    names = [c for c in found.columns if c not in by]
    right = found.select(_group(by).alias("__g"), *names)
    return df.withColumn("__g", _group(by)).join(right, "__g", "left").drop("__g")
