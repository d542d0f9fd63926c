"""Joins of spans, and greedy removal of overlapping spans, for keys of any number of spans.

Spans (first and last position, both within) stand in bins as wide as their own size
rounded up to a power of two, so that a span is in two bins at most. Two spans
meet in a bin of the larger one's width, and count in the bin where their common
stretch begins. A hot key is spread over its bins.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import written
from helixframe.operators.relational import small_side

HOT = 100_000  # spans of a key that stream through one task
ROUNDS = 12


def _class(start: Column, end: Column) -> Column:
    """The least k for which 2 ** k positions hold the span."""
    rest = (end - start).cast("long")
    return F.when(rest == 0, 0).otherwise(F.length(F.bin(rest))).cast("int")


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str], start: str = "start", end: str = "end", within: bool = False) -> DataFrame:
    """(left, right) structs of rows of one key whose spans share a position, or with `within` whose right span lies in the left one. A span that ends before it starts, or has a null, meets none."""
    whole = ("tinyint", "smallint", "int", "bigint")

    def rest(d: DataFrame) -> list[str]:
        """Columns that a span carries besides its key, and its ends where these are whole numbers."""
        types = dict(d.dtypes)
        return [c for c in d.columns if c not in on and not (c in (start, end) and types[c] in whole)]

    def spans(d: DataFrame) -> DataFrame:
        carried = F.struct(*rest(d)) if rest(d) else F.lit(0)
        return written(d.filter(F.col(start) <= F.col(end)).select(*on, carried.alias("row"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")), "spans")

    first = spans(left)
    sides = [first, first if right is left else spans(right)]  # a table with itself is moved once
    size = _class(F.col("a"), F.col("b"))
    sizes = sorted({r["size"] for d in sides[: 1 if right is left else 2] for r in d.select(size.alias("size")).distinct().collect()})  # 64 at most

    def binned(d: DataFrame) -> DataFrame:
        wide = d.withColumn("wide", F.explode(F.filter(F.array(*(F.lit(k).cast("tinyint") for k in sizes)), lambda w: w >= size)))
        return wide.withColumn("bin", F.explode(F.expr("sequence(shiftright(a, wide), shiftright(b, wide))"))).select(*on, "wide", "bin", "row", "a", "b")

    def row(d: DataFrame, names: tuple[str, str, str]) -> Column:
        carried, types = rest(d), dict(d.dtypes)
        ends = {start: F.col(names[1]), end: F.col(names[2])}
        return F.struct(*((F.col(c) if c in on else F.col(names[0])[c] if c in carried else ends[c].cast(types[c])).alias(c) for c in d.columns))

    if not sizes:
        return left.select(F.struct(*left.columns).alias("left")).crossJoin(right.select(F.struct(*right.columns).alias("right"))).limit(0)
    x = binned(sides[0]).withColumnsRenamed({"row": "r1", "a": "a1", "b": "b1"})
    y = binned(sides[1]).withColumnsRenamed({"row": "r2", "a": "a2", "b": "b2"})
    larger = F.greatest(_class(F.col("a1"), F.col("b1")), _class(F.col("a2"), F.col("b2")))
    here = (F.col("a1") <= F.col("b2")) & (F.col("a2") <= F.col("b1")) & (F.expr("shiftright(greatest(a1, a2), wide)") == F.col("bin")) & (larger == F.col("wide"))
    inside = (F.col("a1") <= F.col("a2")) & (F.col("b2") <= F.col("b1"))
    met = x.join(y.hint("merge"), [*on, "wide", "bin"]).filter(here & inside if within else here)
    return met.select(row(left, ("r1", "a1", "b1")).alias("left"), row(right, ("r2", "a2", "b2")).alias("right"))


def _streamed(df: DataFrame, by: str, start: str, end: str, score: str, share: float) -> DataFrame:
    """Rows stream by key and score; only the kept spans of the current key are held, and those that can reach a candidate are looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, kept, longest = None, [], 0
        for pdf in batches:
            rows = []
            for i, (k, a, b) in enumerate(zip(pdf[by].tolist(), pdf[start].tolist(), pdf[end].tolist(), strict=True)):
                if k != key:
                    key, kept, longest = k, [], 0
                near = kept[bisect_left(kept, (a - longest,)) : bisect_right(kept, (b + 1,))]
                if all(min(b, d) - max(a, c) + 1 < share * min(b - a + 1, d - c + 1) for c, d in near):
                    insort(kept, (a, b))
                    longest = max(longest, b - a + 1)
                    rows.append(i)
            yield pdf.iloc[rows]

    return df.repartition(by).sortWithinPartitions(by, F.desc(score), start, end).mapInPandas(run, df.schema)


def greedy(starts: Sequence[int], ends: Sequence[int], share: float, names: Sequence) -> list:
    """Names of the spans that are kept, of one key's in the order in which they are to be looked at."""
    kept, longest, out = [], 0, []
    for a, b, name in zip(starts, ends, names, strict=True):
        near = kept[bisect_left(kept, (a - longest,)) : bisect_right(kept, (b + 1,))]
        if all(min(b, d) - max(a, c) + 1 < share * min(b - a + 1, d - c + 1) for c, d in near):
            insort(kept, (a, b))
            longest = max(longest, b - a + 1)
            out.append(name)
    return out


def without_overlaps(df: DataFrame, by: str, start: str, end: str, score: str, share: float = 0.5, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """Candidates of each key by falling score, without those that overlap a kept one by `share` of the shorter of the two.

    A key of at most `hot` candidates streams through one task. The candidates of others are
    settled in rounds: one is kept once all better ones that it overlaps are out, and
    out once one of them is kept. What a long chain of ever better ones leaves open after
    `rounds` rounds depends on nothing else any more, and streams.
    """
    rows = written(df, "candidates")
    many = written(rows.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > hot).select(by), "hot-keys")
    if many.isEmpty():
        return _streamed(rows, by, start, end, score, share)
    light = _streamed(rows.join(small_side(many), by, "left_anti"), by, start, end, score, share)
    dense = written(rows.join(small_side(many), by, "left_semi").withColumn("__id", F.monotonically_increasing_id()), "hot-candidates")
    spans = dense.select(by, F.col(start).alias("start"), F.col(end).alias("end"), F.col(score).alias("score"), "__id")
    pairs = overlapping(spans, spans, [by])
    length = lambda side: F.col(f"{side}.end") - F.col(f"{side}.start") + 1
    common = F.least("left.end", "right.end") - F.greatest("left.start", "right.start") + 1
    place = lambda side: F.struct(F.col(f"{side}.score").isNull(), -F.col(f"{side}.score"), F.col(f"{side}.start"), F.col(f"{side}.end"), F.col(f"{side}.__id"))
    worse = pairs.filter((place("left") < place("right")) & (common >= share * F.least(length("left"), length("right"))))
    edges = written(worse.select(F.col("right.__id").alias("x"), F.col("left.__id").alias("y")), "overlaps")
    ids = dense.select(F.col("__id").alias("x"))
    kept = fresh = written(ids.join(edges.select("x").distinct(), "x", "left_anti"), "kept")
    for _ in range(rounds):
        if edges.isEmpty():
            break
        out = written(edges.join(fresh.select(F.col("x").alias("y")), "y").select("x").distinct(), "out")
        open_ = written(edges.join(out, "x", "left_anti"), "open")
        edges = written(open_.join(out.select(F.col("x").alias("y")), "y", "left_anti").select("x", "y"), "overlaps")
        fresh = written(open_.select("x").distinct().join(edges.select("x").distinct(), "x", "left_anti"), "kept")
        kept = kept.unionByName(fresh)
    edges = edges.join(edges.join(fresh.select(F.col("x").alias("y")), "y").select("x").distinct(), "x", "left_anti")  # what the last ones put out
    settled = dense.join(kept.withColumnRenamed("x", "__id"), "__id", "left_semi").select(*df.columns)
    rest = dense.join(edges.select(F.col("x").alias("__id")).distinct(), "__id", "left_semi").select(*df.columns)
    return light.unionByName(settled).unionByName(_streamed(rest, by, start, end, score, share))
