"""Degenerate-codon design: the codon table, objectives, selection by column, and what a design encodes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.dna import codon_residue
from helixframe.functions.tables import IUPAC, RESIDUES

_CODES = [(i, code, base) for i, (code, bases) in enumerate(IUPAC.items()) for base in bases]


def residue_bit(aa: Column) -> Column:
    """One of 20 bits; 0 for what is no residue."""
    at = F.position(aa, F.lit(RESIDUES))
    return F.when(at > 0, F.call_function("shiftleft", F.lit(1), at - 1)).otherwise(F.lit(0))


def codon_table(spark: SparkSession) -> DataFrame:
    """ord, codon, mask (bits of the residues), size, stops, total: all 3,375 degenerate codons in enumeration order."""
    n = len(_CODES)
    codes = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("code"), F.lit(b).alias("base")) for i, c, b in _CODES))
    k = F.col("id").cast("int")
    picks = [F.get(codes, F.pmod(F.floor(k / n**p), F.lit(n)).cast("int")) for p in (2, 1, 0)]
    rows = spark.range(0, n**3, 1, 1).select(
        sum((p["i"] * 15 ** (2 - j) for j, p in enumerate(picks)), F.lit(0)).alias("ord"), F.concat(*(p["code"] for p in picks)).alias("codon"), codon_residue(F.concat(*(p["base"] for p in picks))).alias("aa")
    )
    return rows.groupBy("ord", "codon").agg(
        F.bit_or(residue_bit(F.col("aa"))).alias("mask"), F.count_distinct(F.when(F.col("aa") != "*", F.col("aa"))).cast("int").alias("size"), F.count_if(F.col("aa") == "*").cast("int").alias("stops"), F.count("*").cast("int").alias("total")
    )


def safe(codons: DataFrame) -> DataFrame:
    """Codons without any stop."""
    return codons.filter("stops = 0")


def not_only_stops(codons: DataFrame) -> DataFrame:
    return codons.filter("stops < total")


def columns_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, pos, observed, n_observed): the residues of each position as bits, from per-position counts."""
    bits = counts.select(*by, "pos", residue_bit(F.col("aa")).alias("bit")).filter("bit > 0")
    return bits.groupBy(*by, "pos").agg(F.bit_or("bit").alias("observed")).withColumn("n_observed", F.bit_count("observed"))


def metrics() -> dict[str, Column]:
    """recall, precision, loss, off_target of a (column, codon) row."""
    hit = F.bit_count(F.col("observed").bitwiseAND(F.col("mask")))
    recall, precision = hit / F.col("n_observed"), hit / F.col("size")
    return {"recall": recall, "precision": precision, "loss": 1 - recall, "off_target": 1 - precision}


def direct() -> Column:
    m = metrics()
    return 2 - m["recall"] - m["precision"]


def weighted(w_loss: float | Column, w_off: float | Column) -> Column:
    m = metrics()
    return w_loss * m["loss"] + w_off * m["off_target"]


def stop_aware(w_loss: float, w_off: float, w_stop: float) -> Column:
    """weighted, and the cost of stops; for codons that are not only stops."""
    return weighted(w_loss, w_off) + w_stop * -F.ln(1 - F.col("stops") / F.col("total"))


def full_coverage() -> Column:
    """1000 a missing residue, 10 an unwanted one, 100 if a stop is encoded, and the size."""
    hit = F.bit_count(F.col("observed").bitwiseAND(F.col("mask")))
    stop = F.when(F.col("stops") > 0, 1).otherwise(0)
    return 1000 * (F.col("n_observed") - hit) + 10 * (F.col("size") - hit) + 100 * stop + F.col("size") + stop


def best_codons(columns: DataFrame, codons: DataFrame, objective: Column, keys: Sequence[str] = ("pos",), by_size: bool = True) -> DataFrame:
    """The codon of the least objective for each column; ties: the smaller set (if by_size), then enumeration order.

    The codons are a table of constant size, so that each column meets all of
    them without a shuffle of the columns by codon.
    """
    rows = columns.crossJoin(F.broadcast(codons.filter("size > 0"))).withColumn("objective", objective)
    order = F.struct("objective", "size", "ord") if by_size else F.struct("objective", "ord")
    kept = F.struct("codon", "mask", "size", "stops", "total", "objective", "observed", "n_observed")
    return rows.groupBy(*keys).agg(F.min_by(kept, order).alias("b")).select(*keys, "b.*")


def encoded_space(best: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """space: the product of sizes as a decimal string, exact up to 38 digits, and its logarithm."""
    sizes = best.groupBy(*by).agg(F.collect_list("size").alias("sizes"))
    one = F.lit(1).cast("decimal(38,0)")
    product = F.aggregate("sizes", one, lambda a, x: (a * x.cast("decimal(2,0)")).cast("decimal(38,0)"))
    return sizes.select(*by, product.cast("string").alias("space"), F.aggregate("sizes", F.lit(0.0), lambda a, x: a + F.log10(x)).alias("log10_space"))


def coverage(sequences: DataFrame, key: str, seq: str, best: DataFrame, by: Sequence[str] = (), ignored: str = "-.Xx") -> DataFrame:
    """Share of sequences whose every residue is encoded; gaps are skipped, and only positions with a codon are held against it."""
    cells = sequences.select(*by, key, F.posexplode(F.split(seq, "")).alias("at", "aa")).withColumn("pos", F.col("at") + 1).filter(~F.col("aa").isin(*ignored))
    ok = residue_bit(F.col("aa")).bitwiseAND(F.col("mask")) > 0
    joined = cells.join(best.select(*by, "pos", "mask"), [*by, "pos"])
    missed = joined.filter(~ok).select(*by, key).distinct().groupBy(*by).agg(F.count("*").alias("missed"))
    total = sequences.groupBy(*by).agg(F.count("*").alias("n"))
    out = total.join(missed, list(by), "left") if by else total.crossJoin(missed)
    return out.select(*by, "n", ((F.col("n") - F.coalesce("missed", F.lit(0))) / F.col("n")).alias("coverage"))


def summary(best: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Averages, compression and global off-target share of a design."""
    hit = F.bit_count(F.col("observed").bitwiseAND(F.col("mask")))
    return best.groupBy(*by).agg(
        F.avg(1 - hit / F.col("n_observed")).alias("mean_loss"), F.avg(1 - hit / F.col("size")).alias("mean_off_target"), F.avg("objective").alias("mean_objective"),
        F.exp(F.sum(F.ln("n_observed") - F.ln("size"))).alias("compression"), (F.sum(F.col("size") - hit) / F.sum("size")).alias("global_off_target"),
        (1 - F.exp(F.sum(F.log1p(-F.col("stops") / F.col("total"))))).alias("stop_risk"),
    )


def grid(columns: DataFrame, codons: DataFrame, weights: Sequence[tuple[float, float]], score: Callable[[], Column] = direct) -> DataFrame:
    """w_loss, w_off, mean_score: for each pair of weights the mean score of the codons that it selects."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("w_loss"), F.lit(b).alias("w_off")) for a, b in weights)))
    rows = columns.withColumn("w", pairs).select("*", "w.*").drop("w")
    keys = [c for c in rows.columns if c not in ("observed", "n_observed")]
    best = best_codons(rows, codons, weighted(F.col("w_loss"), F.col("w_off")), keys)
    return best.withColumn("score", score()).groupBy("w_loss", "w_off").agg(F.avg("score").alias("mean_score"))


def surface(cells: DataFrame, x: str, y: str, z: str) -> dict[str, float]:
    """Least squares of z on 1, x, y, x^2, xy, y^2 from sums in one pass; the stationary point and R squared."""
    terms = [F.lit(1.0), F.col(x), F.col(y), F.col(x) ** 2, F.col(x) * F.col(y), F.col(y) ** 2]
    sums = [F.sum(terms[i] * terms[j]) for i in range(6) for j in range(i, 6)] + [F.sum(t * F.col(z)) for t in terms] + [F.sum(F.col(z) ** 2), F.sum(F.col(z))]
    got = list(cells.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first())
    a = np.zeros((6, 6))
    a[np.triu_indices(6)] = got[:21]
    a = a + np.triu(a, 1).T
    right = np.array(got[21:27])
    c = np.linalg.lstsq(a, right, rcond=None)[0]
    n, zz, zs = a[0, 0], got[27], got[28]
    rest = zz - 2 * c @ right + c @ a @ c
    total = zz - zs * zs / n
    det = 4 * c[3] * c[5] - c[4] ** 2
    point = ((-2 * c[5] * c[1] + c[4] * c[2]) / det, (-2 * c[3] * c[2] + c[4] * c[1]) / det) if abs(det) >= 1e-12 else (float("nan"),) * 2
    return {**dict(zip("abcdef", map(float, c), strict=True)), "x": float(point[0]), "y": float(point[1]), "r_squared": float(1 - rest / total) if total else 1.0}
