"""Filters with reports of what each one removes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.relational import checked_left_join


def no_nan(c: Column) -> Column:
    """NaN as NULL: comparisons with it then fail, as they should."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def at_most(c: Column, high: float) -> Column:
    return F.coalesce(no_nan(c) <= high, F.lit(False))


def at_least(c: Column, low: float) -> Column:
    return F.coalesce(no_nan(c) >= low, F.lit(False))


def within(c: Column, low: float, high: float) -> Column:
    return F.coalesce(no_nan(c).between(low, high), F.lit(False))


def outside(c: Column, low: float, high: float) -> Column:
    """Outside of a closed range; a missing value is not."""
    return F.coalesce((no_nan(c) < low) | (no_nan(c) > high), F.lit(False))


def attrition(df: DataFrame, filters: Sequence[tuple[str, Column]]) -> DataFrame:
    """step, filter, removed, remaining: of the filters one after the other, in one pass over df."""
    kept: Column = F.lit(True)
    parts = [F.count(F.lit(1)).alias("n0")]
    for k, (_, f) in enumerate(filters, 1):
        kept = kept & f
        parts.append(F.count_if(kept).alias(f"n{k}"))
    counts = df.agg(*parts)
    rows = [F.struct(F.lit(k).alias("step"), F.lit(name).alias("filter"), (F.col(f"n{k - 1}") - F.col(f"n{k}")).alias("removed"), F.col(f"n{k}").alias("remaining")) for k, (name, _) in enumerate(filters, 1)]
    return counts.select(F.inline(F.array(*rows)))


def passing(df: DataFrame, filters: Sequence[tuple[str, Column]]) -> DataFrame:
    for _, f in filters:
        df = df.filter(f)
    return df


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks; a rule that can't be judged for want of a value is kept. NULL where none is broken."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def reasons(df: DataFrame, reason: Column) -> DataFrame:
    """reason, n: how many rows each reason excludes, most first."""
    return df.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def is_stale(c: Column, kind: str = "string") -> Column:
    """A cell without a usable value: NULL, NaN, blank, or the words nan and none."""
    blank = F.lower(F.trim(c.cast("string"))).isin("", "nan", "none")
    return F.coalesce(blank, F.lit(True))


def recompute_plan(df: DataFrame, metrics: Sequence[str], forced: Column | None = None) -> DataFrame:
    """df with `recompute`: some metric is stale, or the row is forced."""
    stale: Column = forced if forced is not None else F.lit(False)
    for m in metrics:
        stale = stale | is_stale(F.col(m))
    return df.withColumn("recompute", stale)


def update_stale(df: DataFrame, fresh: DataFrame, key: str, metrics: Sequence[str], forced: Column | None = None) -> DataFrame:
    """Fill stale (or forced) cells with the incoming values of the same key, where these aren't NULL; a repeated incoming key raises."""
    incoming = fresh.select(F.col(key), *(F.col(m).alias(f"__new_{m}") for m in metrics))
    out = checked_left_join(df, incoming, key)
    force = forced if forced is not None else F.lit(False)
    filled = {m: F.when((is_stale(F.col(m)) | force) & F.col(f"__new_{m}").isNotNull(), F.col(f"__new_{m}")).otherwise(F.col(m)) for m in metrics}
    return out.withColumns(filled).drop(*(f"__new_{m}" for m in metrics))


def quality_gate(bases: Sequence[Column] | Column, mapq: Column, min_mapq: int) -> Column:
    """`low_mapq`, or the reason of the first designed position that fails in an array of (position, reason), else `assigned`."""
    first = F.get(F.filter(bases, lambda x: x["reason"].isNotNull()), F.lit(0))["reason"]
    return F.when(mapq < min_mapq, "low_mapq").when(first.isNotNull(), first).otherwise("assigned")


def repaired(seq: Column, qual: Column, design: str, codes: Mapping[str, str], confident: int = 30) -> dict[str, Column]:
    """Quality-aware conformity with a design: the reason of the first misfit that can't be repaired, and the repaired sequence.

    A misfit of at least `confident` discards the read; a weaker one is repaired
    where the design is one base, and discards the read where it is ambiguous.
    """
    table = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    each = F.transform(
        F.arrays_zip(F.split(seq, "").alias("b"), F.split(qual, "").alias("q"), F.split(F.lit(design), "").alias("d")),
        lambda p: F.struct(p["b"].alias("b"), (F.ascii(p["q"]) - 33).alias("q"), F.element_at(table, p["d"]).alias("allowed")),
    )
    misfit = lambda x: ~F.contains(x["allowed"], x["b"])
    why = lambda x: F.when(misfit(x), F.when(x["q"] >= confident, "confident_mismatch").when(F.length(x["allowed"]) > 1, "ambiguous_low_quality"))
    fits = F.length(seq) == len(design)
    reason = F.when(fits, F.get(F.filter(F.transform(each, why), lambda r: r.isNotNull()), F.lit(0))).otherwise("length")
    fixed = F.array_join(F.transform(each, lambda x: F.when(misfit(x) & (F.length(x["allowed"]) == 1), x["allowed"]).otherwise(x["b"])), "")
    return {"reason": reason, "repaired": F.when(fits & reason.isNull(), fixed)}
