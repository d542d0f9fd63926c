"""The power transform of Yeo and Johnson (2000) as expressions both ways, with parameters by maximum likelihood.

A model is trained on transformed, standardised values; `to_real` takes its
predictions back to the scale of the measurement.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import written

CANDIDATES = 17  # exponents that one pass compares
FARTHEST = 1e3  # of an exponent from 1


@dataclass(frozen=True)
class Power:
    """The exponent, and mean and population deviation of the transformed values (1 where they are all equal)."""

    exponent: float
    mean: float = 0.0
    deviation: float = 1.0


def _power(x: Column, e: Column) -> Column:
    """((1 + x) ** e - 1) / e, whose limit at 0 is the logarithm; x is not below 0."""
    return F.when(e == 0, F.log1p(x)).otherwise(F.expm1(e * F.log1p(x)) / e)


def _root(y: Column, e: Column) -> Column:
    """The inverse of _power."""
    return F.when(e == 0, F.expm1(y)).when(e * y > -1, F.expm1(F.log1p(e * y) / e))


def transformed(x: Column, exponent: float | Column) -> Column:
    """x by the transform alone."""
    e = exponent if isinstance(exponent, Column) else F.lit(float(exponent))
    return F.when(x >= 0, _power(x, e)).otherwise(-_power(-x, 2 - e))


def restored(y: Column, exponent: float | Column) -> Column:
    """The inverse of transformed(); NULL for what no value is transformed to."""
    e = exponent if isinstance(exponent, Column) else F.lit(float(exponent))
    return F.when(y >= 0, _root(y, e)).otherwise(-_root(-y, 2 - e))


def from_real(x: Column, power: Power) -> Column:
    """Measurements as a model sees them."""
    return (transformed(x.cast("double"), power.exponent) - power.mean) / power.deviation


def to_real(y: Column, power: Power) -> Column:
    """A model's predictions as measurements."""
    return restored(y.cast("double") * power.deviation + power.mean, power.exponent)


def fitted(df: DataFrame, columns: Sequence[str], tolerance: float = 1e-9) -> dict[str, Power]:
    """The most likely Power of each column, over its finite values; a column without two different ones has exponent 1.

    The log-likelihood has one top. It is bracketed by CANDIDATES exponents at equal
    steps: while the best stands at an end the bracket moves and widens, else it
    shrinks to the best one's neighbours. One aggregate gives the likelihoods of all
    candidates of all columns, over different values and how often each occurs: rows
    are read once.
    """
    usable = {c: F.when(F.abs(F.col(c).cast("double")) < math.inf, F.col(c).cast("double")) for c in columns}
    melted = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), x.alias("x")) for k, x in enumerate(usable.values())))).alias("v")).select("v.*").filter("x is not null")
    values = written(melted.groupBy("k", "x").agg(F.count("*").alias("n")), "values")
    log = F.when(F.col("x") >= 0, F.log1p("x")).otherwise(-F.log1p(-F.col("x")))
    first = {r.k: r for r in values.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * log).alias("s"), F.min("x").alias("a"), F.max("x").alias("b"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m")).collect()}
    n = F.sum("n")

    def moments(t: Column, middle: Column) -> tuple[Column, Column]:
        """Mean and population variance of t, from its differences to what the mean is transformed to."""
        d = t - middle
        mean = F.sum(F.col("n") * d) / n
        return mean, F.sum(F.col("n") * d * d) / n - mean * mean

    count, logs = {k: r.n for k, r in first.items()}, {k: r.s for k, r in first.items()}
    flat = [k not in first or first[k].a == first[k].b for k in range(len(columns))]
    bracket = {k: (-2.0, 2.0) for k in range(len(columns)) if not flat[k]}
    best = dict.fromkeys(range(len(columns)), 1.0)
    while open_ := {k: b for k, b in bracket.items() if b[1] - b[0] > tolerance}:
        steps = {k: [a + (b - a) * i / (CANDIDATES - 1) for i in range(CANDIDATES)] for k, (a, b) in open_.items()}
        # The candidates are data, so that all passes share their compiled code.
        tried = F.from_json(F.lit(json.dumps([{"of": k, "i": i, "e": e, "m": first[k].m} for k, some in steps.items() for i, e in enumerate(some)])), "array<struct<of:int,i:int,e:double,m:double>>")
        rows = values.select("k", "x", "n", F.explode(F.filter(tried, lambda c: c["of"] == F.col("k"))).alias("c"))
        rows = rows.select("k", "c.i", "n", (transformed(F.col("x"), F.col("c.e")) - transformed(F.col("c.m"), F.col("c.e"))).alias("t"))
        got = {(r.k, r.i): r.spread for r in rows.groupBy("k", "i").agg(moments(F.col("t"), F.lit(0.0))[1].alias("spread")).collect()}
        for k, some in steps.items():

            def likelihood(i: int, k: int = k, some: list[float] = some) -> float:
                spread = got.get((k, i))
                if spread is None or not 0 < spread < math.inf:
                    return -math.inf
                return -count[k] / 2 * math.log(spread) + (some[i] - 1) * logs[k]

            at = max(range(CANDIDATES), key=likelihood)
            best[k] = some[at]
            width = some[-1] - some[0]
            if at in (0, CANDIDATES - 1) and abs(some[at] - 1) < FARTHEST and width > 0.1:
                bracket[k] = (some[at] - width, some[at] + width)
            else:
                bracket[k] = (some[max(at - 1, 0)], some[min(at + 1, CANDIDATES - 1)])
    found = {}
    for k, c in enumerate(columns):
        if k not in first:
            found[c] = Power(best[k])
            continue
        middle = transformed(F.lit(float(first[k].m)), best[k])
        off, spread, at = values.filter(F.col("k") == k).select("x", "n").agg(*moments(transformed(F.col("x"), best[k]), middle), F.first(middle)).first()
        found[c] = Power(best[k], at + off, 1.0 if flat[k] else math.sqrt(max(spread, 0.0)) or 1.0)
    return found
