"""Weighted summaries and comparisons of populations."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import written
from helixframe.operators.order import percentiles, with_percentiles
from helixframe.operators.relational import numbered, running_before

HOLM_ROWS = 100_000


def weighted(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """n, mean, sd (population) and median of the expanded population, over finite values of positive weight."""
    x, w = F.col(value), F.col(weight)
    usable = df.filter(x.isNotNull() & ~F.isnan(x.cast("double")) & (w > 0))
    mean = F.sum(w * x) / F.sum(w)
    spread = F.sum(w * x * x) / F.sum(w) - mean * mean
    sums = usable.groupBy(*by).agg(F.sum(w).alias("n"), mean.alias("weighted_mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("weighted_sd"))
    return with_percentiles(sums, percentiles(usable, by, value, [0.5], weight).withColumnRenamed("p0", "weighted_median"), by)


def chi_square(table: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson statistic of a 2 x K table, Cramer's V, and how many expected cells are below 5."""
    totals = table.agg(F.sum(a).alias("na"), F.sum(b).alias("nb"))
    row = F.col(a) + F.col(b)
    n = F.col("na") + F.col("nb")
    ea, eb = row * F.col("na") / n, row * F.col("nb") / n
    each = table.crossJoin(F.broadcast(totals)).select(((F.col(a) - ea) ** 2 / ea + (F.col(b) - eb) ** 2 / eb).alias("part"), ((ea < 5).cast("int") + (eb < 5).cast("int")).alias("few"), n.alias("n"))
    return each.agg(F.sum("part").alias("chi2"), (F.count("*") - 1).alias("dof"), F.sqrt(F.sum("part") / F.max("n")).alias("cramers_v"), F.sum("few").alias("cells_below_5"))


def chi_square_monte_carlo(spark: SparkSession, a: Sequence[int], b: Sequence[int], simulations: int, seed: int = 42, tasks: int = 8) -> DataFrame:
    """statistic, exceed, simulations, p: tables of the same margins, drawn in tasks; the table itself must be small.

    The draws of a block depend on the seed and the block's number alone.
    """
    x, y = np.asarray(a, float), np.asarray(b, float)
    both = x + y
    expected = both * x.sum() / both.sum()
    other = both * y.sum() / both.sum()
    observed = float((((x - expected) ** 2) / expected + ((y - other) ** 2) / other).sum())
    margin, n_a = both.astype(np.int64), int(x.sum())
    block = 1000

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                size = min(block, simulations - k * block)
                got = np.random.default_rng([seed, int(k)]).multivariate_hypergeometric(margin, n_a, size=size)
                stat = ((got - expected) ** 2 / expected).sum(1) + ((margin - got - other) ** 2 / other).sum(1)
                near = 100 * np.finfo(float).eps * np.maximum(1, np.abs(stat))
                yield pd.DataFrame({"exceed": [int((stat >= observed - near).sum())], "n": [size]})

    blocks = spark.range(0, -(-simulations // block), 1, tasks)
    total = blocks.mapInPandas(drawn, "exceed long, n long").agg(F.sum("exceed").alias("exceed"), F.sum("n").alias("simulations"))
    return total.select(F.lit(observed).alias("statistic"), "exceed", "simulations", ((F.col("exceed") + 1) / (F.col("simulations") + 1)).alias("p"))


def ranks_of_two(df: DataFrame, value: str, weight: str, side: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, wa, wb, below): weights of both samples at each distinct value, and b's weight below it."""
    w = F.col(weight)
    cells_ = df.filter(w > 0).groupBy(*by, value).agg(F.sum(F.when(F.col(side) == a, w).otherwise(0)).alias("wa"), F.sum(F.when(F.col(side) == b, w).otherwise(0)).alias("wb"))
    if not by:
        return running_before(cells_, [value], "wb", "below")
    over = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return cells_.withColumn("below", F.coalesce(F.sum("wb").over(over), F.lit(0)))


def normal_tail(z: Column | str) -> Column:
    """2 * P(Z > z)."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None or x != x else math.erfc(x / math.sqrt(2))), "double")(z)


def mann_whitney(df: DataFrame, value: str, weight: str, side: str, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """u, z: of weighted samples, tie-corrected, with continuity correction; z is NULL where the variance is 0."""
    cells_ = ranks_of_two(df.filter(F.col(side).isin(a, b)), value, weight, side, a, b, by)
    t = F.col("wa") + F.col("wb")
    sums = cells_.groupBy(*by).agg(F.sum(F.col("wa") * (F.col("below") + 0.5 * F.col("wb"))).alias("u"), F.sum("wa").cast("double").alias("na"), F.sum("wb").cast("double").alias("nb"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n, both = F.col("na") + F.col("nb"), F.col("na") * F.col("nb")
    variance = both / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    z = F.when(variance > 0, F.greatest(F.lit(0.0), F.abs(F.col("u") - both / 2) - 0.5) / F.sqrt(variance))
    return sums.select(*by, "u", "na", "nb", z.alias("z"))


def holm(df: DataFrame, p: str, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """df with `adjusted`: the step-down adjustment within each family; a family is one group of a window, all rows (without `by`) go by ranges."""
    order = [p, tie] if tie else [p]
    if not by:
        ranked = numbered(df, order, "__k")
        scaled = written(ranked.withColumn("__s", (F.lit(ranked.count()) - F.col("__k")) * F.col(p)).withColumn("__part", F.floor(F.col("__k") / HOLM_ROWS)), "holm")
        tops = scaled.groupBy("__part").agg(F.max("__s").alias("__top"))  # one row for each HOLM_ROWS
        before = tops.select("__part", F.max("__top").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
        within = F.max("__s").over(Window.partitionBy("__part").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
        return scaled.withColumn("__within", within).join(before, "__part").withColumn("adjusted", F.least(F.lit(1.0), F.greatest("__within", "__before"))).drop("__k", "__s", "__part", "__within", "__before")
    w = Window.partitionBy(*by).orderBy(*order)
    scaled = (F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(w) + 1) * F.col(p)
    return df.withColumn("__s", scaled).withColumn("adjusted", F.least(F.lit(1.0), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, r: Pearson of all pairs, in one aggregate."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))))


def block_means(df: DataFrame, by: Sequence[str], order: str, value: str, blocks: int = 5) -> DataFrame:
    """mean and sem over the means of equal blocks in order, the first ones one longer if need be."""
    cut = df.withColumn("block", F.ntile(blocks).over(Window.partitionBy(*by).orderBy(order)))
    means = cut.groupBy(*by, "block").agg(F.avg(value).alias("m"))
    return means.groupBy(*by).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("m"))).alias("sem"))


def melted(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in values], "feature", "value")


def exact_share(n: Column, total: Column) -> Column:
    return F.when(total > 0, n / total)
