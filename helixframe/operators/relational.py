"""Joins, alignment of samples, set operations, dedupe and ranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import written


BROADCAST_ROWS = 250_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a table that is cheap to count, for a join: broadcast if it is small, else left to the planner."""
    return F.broadcast(df) if df.count() <= most else df


def aligned_counts(df: DataFrame, key: str, sample: str, count: Column, samples: Sequence[str]) -> DataFrame:
    """One row a key with its count in each sample, 0 where it is missing; keys of no count at all go."""
    wide = df.groupBy(key).pivot(sample, list(samples)).agg(F.sum(count)).na.fill(0, list(samples))
    return wide.filter(reduce(lambda a, b: a + b, [F.col(f"`{s}`") for s in samples]) > 0)


def outer_aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join of two (key, n) tables as key, n_a, n_b; rows of two zeros go."""
    both = a.select(key, F.col("n").alias("n_a")).join(b.select(key, F.col("n").alias("n_b")), key, "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.filter("n_a + n_b > 0")


def with_group_stats(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Counts of each key joined with min, max and mean of the values, in one aggregate."""
    stats = [f(F.col(v)).alias(f"{v}_{n}") for v in values for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.groupBy(key).agg(F.count("*").alias("n"), *stats)


def checked_left_join(df: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on a key that must be unique on the right side: a repeated one raises instead of multiplying rows."""
    counted = right.groupBy(key).agg(*(F.first(c).alias(c) for c in right.columns if c != key), F.count("*").alias("__n"))
    checked = counted.filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string")))))
    return df.join(checked.drop("__n"), key, "left")


def missing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one side that the other lacks."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def nearest(df: DataFrame, value: str, centres: Sequence[str], distance) -> DataFrame:
    """df with `centre` and `distance` to the first of the nearest of few given centres."""
    each = F.array(*(F.struct(distance(F.col(value), F.lit(c)).alias("distance"), F.lit(k).alias("ord"), F.lit(c).alias("centre")) for k, c in enumerate(centres)))
    least = F.array_min(each)
    return df.withColumns({"centre": least["centre"], "distance": least["distance"]})


def hamming_totals(df: DataFrame, seq: str, by: str | None = None) -> DataFrame:
    """seq, total: the sum of Hamming distances to all sequences of the (group's) table, by counts of residues a position, without pairs.

    The counts of a group are one row, an array of small maps by position, so that
    sequences are neither exploded nor moved to their counts.
    """
    group = [by] if by else []
    cells = df.select(*group, F.posexplode(F.split(seq, "")).alias("pos", "c")).groupBy(*group, "pos", "c").agg(F.count("*").alias("same"))
    places = cells.groupBy(*group, "pos").agg(F.map_from_entries(F.collect_list(F.struct("c", "same"))).alias("same"))
    in_order = F.array_sort(F.collect_list(F.struct("pos", "same")), lambda x, y: x["pos"] - y["pos"])
    profile = places.groupBy(*group).agg(F.transform(in_order, lambda x: x["same"]).alias("__profile"))
    size = df.groupBy(*group).agg(F.count("*").alias("__m"))
    own = df.select(*group, seq).distinct()
    if group:
        joined = own.join(profile.join(size, group), group)
    else:
        joined = own.crossJoin(F.broadcast(profile)).crossJoin(F.broadcast(size))  # a row each
    each = F.transform(F.split(seq, ""), lambda c, i: F.col("__m") - F.element_at(F.get("__profile", i), c))
    return joined.select(*group, seq, F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def normal_key(c: Column, ignore_case: bool = True, ignore_space: bool = True) -> Column:
    if ignore_space:
        c = F.regexp_replace(c, r"\s", "")
    return F.upper(c) if ignore_case else c


def keep_one(df: DataFrame, key: Column, order: str, keep: str = "first") -> DataFrame:
    """The first or last row of each key in an explicit order; the row stays as it is.

    One struct extreme a key instead of a sort of each group, so that a frequent
    key is combined before the shuffle.
    """
    row = F.struct(*df.columns)
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(key.alias("__key")).agg(pick(row, F.col(order)).alias("__row")).select("__row.*")


def ranked(df: DataFrame, count: str, tie: str, name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """df with its rank by a count, most first, ties by a column; without `by` all rows are ranked in ranges, not in one task."""
    if not by:
        least = df.withColumns({"__none": F.col(count).isNull(), "__falling": -F.col(count)})
        return numbered(least, ["__none", "__falling", tie], name).withColumn(name, (F.col(name) + 1).cast("int")).drop("__none", "__falling")
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(count), tie)))


def cumulative(df: DataFrame, by: Sequence[str], value: str, order: Sequence, name: str = "cumulative") -> DataFrame:
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, index: str, flagged: Column, max_gap: int, by: Sequence[str] = ()) -> DataFrame:
    """first, last, width: runs of flagged rows whose indices are at most max_gap + 1 apart."""
    w = Window.partitionBy(*by).orderBy(index)
    marked = df.filter(flagged).withColumn("__new", (F.col(index) - F.lag(index).over(w) > max_gap + 1).cast("int"))
    grouped = marked.withColumn("region", F.sum(F.coalesce("__new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "region").agg(F.min(index).alias("first"), F.max(index).alias("last")).withColumn("width", F.col("last") - F.col("first") + 1)


def centred_mean(df: DataFrame, by: Sequence[str], order: str, value: str, frame: int) -> DataFrame:
    """Rolling mean over `frame` rows around each one; NULL where the frame is not full."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(frame // 2), frame - frame // 2 - 1)
    return df.withColumn("rolling_mean", F.when(F.count(value).over(w) == frame, F.avg(value).over(w)))


def numbered(df: DataFrame, order: Sequence[str], name: str = "ord") -> DataFrame:
    """df with gapless numbers from 0 in an order, without bringing all rows to one task.

    Ranges of the order are sorted each by itself; the ranges' sizes, one row a
    task, give each its first number.
    """
    local = F.monotonically_increasing_id()
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", local), "numbered")
    part = F.shiftright("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("__part", first.alias("__first"))
    rows = ranged.withColumn("__part", part).join(F.broadcast(firsts), "__part")
    return rows.withColumn(name, F.col("__first") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__first")


def running_before(df: DataFrame, order: Sequence[str], value: str, name: str = "before") -> DataFrame:
    """df with the sum of a value over all rows before each one in an order, without bringing all rows to one task."""
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "running")
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__s"))  # one row a task
    first = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__within", within).join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__within")).drop("__part", "__within", "__first")
