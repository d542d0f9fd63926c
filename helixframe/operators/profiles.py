"""Per-position profiles of aligned sequences: counts, proportions, extras, entropy, hotspots and consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.order import percentiles
from helixframe.operators.relational import islands


def cells(df: DataFrame, seq: str, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """(by, pos, aa, n, first_seen): how often each character stands at each 1-based position.

    first_seen is the least value of an order column: ties go to what came first.
    """
    seen = F.min(order).alias("first_seen") if order else F.min("aa").alias("first_seen")
    each = df.select(*by, *([order] if order else []), F.posexplode(F.split(seq, "")).alias("at", "aa"))
    return each.groupBy(*by, (F.col("at") + 1).alias("pos"), "aa").agg(F.count("*").alias("n"), seen)


def proportions(counts: DataFrame, by: Sequence[str] = (), ignored: str = "-.Xx") -> DataFrame:
    """cells with proportion and rank at their position; ignored characters count for nothing."""
    at = Window.partitionBy(*by, "pos")
    known = counts.filter(~F.col("aa").isin(*ignored)) if ignored else counts
    known = known.withColumn("total", F.sum("n").over(at))
    return known.withColumn("proportion", F.col("n") / F.col("total")).withColumn("rank", F.row_number().over(at.orderBy(F.desc("n"), "first_seen", "aa")))


def top_and_extras(profile: DataFrame, proportion: float, by: Sequence[str] = ()) -> DataFrame:
    """The top residue of each position, and those after it whose running share stays within (1 - top) * proportion."""
    at = Window.partitionBy(*by, "pos")
    top = F.max("proportion").over(at)
    running = F.sum(F.when(F.col("rank") >= 2, F.col("proportion")).otherwise(0.0)).over(at.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = profile.withColumns({"allowed_share": (1 - top) * proportion, "running": running})
    return kept.filter((F.col("rank") == 1) | (F.col("running") <= F.col("allowed_share") + 1e-9)).drop("allowed_share", "running")


def covering(profile: DataFrame, share: float, by: Sequence[str] = ()) -> DataFrame:
    """The smallest prefix of ranked residues that reaches a share of each position."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "pos").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return profile.withColumn("before", before).filter(F.col("before") < share * F.col("total")).drop("before")


def entropy(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy in bits, and noise (100 - top percent), of each position."""
    p = F.col("proportion")
    return profile.groupBy(*by, "pos").agg((-F.sum(p * F.log2(p))).alias("entropy"), (100 - 100 * F.max(p)).alias("noise"))


def mad_scores(df: DataFrame, value: str) -> DataFrame:
    """z by the median and 1.4826 times the median absolute deviation (1e-9 where that is 0)."""
    median = percentiles(df, [], value, [0.5]).first()
    off = F.abs(F.col(value) - (median.p0 if median else None))
    spread = percentiles(df.select(off.alias("off")), [], "off", [0.5]).first()
    s = 1.4826 * spread.p0 if spread else 0.0
    return df.withColumn("z", (F.col(value) - (median.p0 if median else None)) / (s or 1e-9))


def plain_scores(df: DataFrame, value: str) -> DataFrame:
    """z by the mean and the sample deviation (1e-9 where that is 0)."""
    stats = df.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    s = F.when(F.coalesce(F.col("__s"), F.lit(0.0)) == 0, 1e-9).otherwise(F.col("__s"))
    return df.crossJoin(F.broadcast(stats)).withColumn("z", (F.col(value) - F.col("__m")) / s).drop("__m", "__s")


def _indexed(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """scored with row_idx, the place of each position in its alignment."""
    return scored.withColumn("row_idx", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))


def hotspots(scored: DataFrame, k: float, max_gap: int, by: Sequence[str] = ()) -> DataFrame:
    """Regions of positions whose z is above k, for each alignment; gaps count rows, not positions."""
    rows = _indexed(scored, by)
    found = islands(rows, "row_idx", F.col("z") > k, max_gap, by)
    end = lambda c: rows.select(*by, F.col("row_idx").alias(c), F.col("pos").alias(f"{c}_pos"))
    out = found.join(end("first"), [*by, "first"]).join(end("last"), [*by, "last"])
    shape = F.when(F.col("width") == 1, "spike").when(F.col("width") >= 4, "block").otherwise("short run")
    return out.select(*by, "first_pos", "last_pos", "width", shape.alias("shape"))


def sweep(scored: DataFrame, ks: Sequence[float], max_gap: int, by: Sequence[str] = ()) -> DataFrame:
    """k, regions: how many hotspot regions each threshold leaves."""
    rows = _indexed(scored, by).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    found = islands(rows, "row_idx", F.col("z") > F.col("k"), max_gap, by=[*by, "k"])
    counts = found.groupBy(*by, "k").agg(F.count("*").alias("regions"))
    return rows.select(*by, "k").distinct().join(counts, [*by, "k"], "left").na.fill(0, ["regions"])


def consensus(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The top residues in the order of positions, as one sequence."""
    tops = F.array_sort(F.collect_list(F.struct("pos", "aa")))
    return profile.filter("rank = 1").groupBy(*by).agg(F.array_join(F.transform(tops, lambda x: x["aa"]), "").alias("consensus"))


def variant_rows(kept: DataFrame, consensus_: DataFrame, by: Sequence[str] = (), positions: Column | None = None) -> DataFrame:
    """One sequence for each allowed residue that differs from the consensus at its position."""
    rows = kept.join(consensus_, list(by)) if by else kept.crossJoin(F.broadcast(consensus_))
    if positions is not None:
        rows = rows.filter(positions)
    was = F.substr(F.col("consensus"), F.col("pos"), F.lit(1))
    return rows.filter(was != F.col("aa")).select(*by, "pos", was.alias("was"), "aa", F.overlay("consensus", "aa", "pos", F.lit(1)).alias("variant"))
