"""Protein properties as Column expressions over residue counts and positions."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.dna import characters, count_of
from helixframe.functions.tables import CONSENSUS_HYDROPHOBICITY, HELIX_PROPENSITY, HYDROPATHY, MASSES, PKA, PKA_TAG, RESIDUES, WATER


def _sum_of(c: Column, scale: Mapping[str, float]) -> Column:
    """Sum of a scale over the residues that it knows, from their counts; added residue by residue in the scale's order, so that a value's last bits are fixed."""
    terms = [count_of(c, residue) * F.lit(x) for residue, x in scale.items() if x]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def fraction(c: Column, letters: str) -> Column:
    """Share of residues that are one of letters; 0.0 for an empty sequence."""
    return F.when(F.length(c) > 0, count_of(c, letters) / F.length(c)).otherwise(0.0)


def is_valid(c: Column) -> Column:
    return c.rlike(f"^[{RESIDUES}]+$")


def invalid_residues(c: Column) -> Column:
    """Sorted distinct characters that are no residue, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(characters(F.regexp_replace(c, f"[{RESIDUES}]", "")))), "")


def net_charge(c: Column, ph: float = 7.0, pka: Mapping[str, float] = PKA) -> Column:
    """Henderson-Hasselbalch charge of the termini and the ionisable residues."""
    total = F.lit(1 / (1 + 10 ** (ph - pka["N_TERM"])) - 1 / (1 + 10 ** (pka["C_TERM"] - ph)))
    for r in "DECY":
        total = total - count_of(c, r) * F.lit(1 / (1 + 10 ** (pka[r] - ph)))
    for r in "HKR":
        total = total + count_of(c, r) * F.lit(1 / (1 + 10 ** (ph - pka[r])))
    return total


def charged_fraction(c: Column) -> Column:
    return F.when(F.length(c) > 0, (count_of(c, "KRED") + count_of(c, "H") * F.lit(0.1)) / F.length(c)).otherwise(0.0)


def charge_per_residue(c: Column) -> Column:
    return F.when(F.length(c) > 0, (count_of(c, "KR") + count_of(c, "H") * F.lit(0.1) - count_of(c, "ED")) / F.length(c)).otherwise(0.0)


def gravy(c: Column) -> Column:
    return _sum_of(c, HYDROPATHY) / F.length(c)


def molecular_weight(c: Column) -> Column:
    return _sum_of(c, MASSES) + F.lit(WATER)


def aromaticity(c: Column) -> Column:
    return fraction(c, "FWY")


def aliphatic_index(c: Column) -> Column:
    """A + 2.9 V + 3.9 (I + L), as percentages."""
    return 100 * (count_of(c, "A") + 2.9 * count_of(c, "V") + 3.9 * count_of(c, "IL")) / F.length(c)


def instability_index(c: Column, weights: Mapping[str, float]) -> Column:
    """10/n times the sum of dipeptide weights; weights are a parameter (pairs such as `AC`), 1.0 where absent."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    each = F.arrays_zip(characters(c).alias("x"), characters(F.substr(c, F.lit(2))).alias("y"))  # the last residue has no second
    value = lambda p: F.when(p["y"].isNotNull(), F.coalesce(F.try_element_at(table, F.concat(p["x"], p["y"])), F.lit(1.0))).otherwise(0.0)
    return 10 * F.aggregate(each, F.lit(0.0), lambda a, p: a + value(p)) / F.length(c)


def secondary_fractions(c: Column) -> tuple[Column, Column, Column]:
    """Shares of residues that favour helix, turn and sheet."""
    return fraction(c, "EMALK"), fraction(c, "NPGSD"), fraction(c, "VIYFWLT")


def isoelectric_point(c: Column, pka: Mapping[str, float] = PKA, steps: int = 40) -> Column:
    """The pH of no charge, by bisection between 0 and 14 over the counts of ionisable residues, a batch of rows at a time."""
    acids, bases = "DECY", "HKR"
    table = dict(pka)

    def solve(counts: pd.DataFrame) -> pd.Series:
        lo, hi = np.zeros(len(counts)), np.full(len(counts), 14.0)
        for _ in range(steps):
            ph = (lo + hi) / 2
            charge = 1 / (1 + 10 ** (ph - table["N_TERM"])) - 1 / (1 + 10 ** (table["C_TERM"] - ph))
            for r in acids:
                charge = charge - counts[r] / (1 + 10 ** (table[r] - ph))
            for r in bases:
                charge = charge + counts[r] / (1 + 10 ** (ph - table[r]))
            up = charge.to_numpy() > 0
            lo, hi = np.where(up, ph, lo), np.where(up, hi, ph)
        return pd.Series((lo + hi) / 2).where(counts[bases[0]].notna().to_numpy())

    return F.pandas_udf(solve, "double")(F.struct(*(count_of(c, r).cast("double").alias(r) for r in acids + bases)))


def helix_propensity(c: Column) -> tuple[Column, Column]:
    """Sum and mean over known residues; the mean is NULL without any."""
    known = count_of(c, "".join(HELIX_PROPENSITY))
    total = F.when(known > 0, _sum_of(c, HELIX_PROPENSITY))
    return total, total / known


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def moment_and_face(c: Column, delta: float = 100.0, half_width: float = 60.0) -> tuple[Column, Column]:
    """Helical hydrophobic moment per residue, and the share of hydrophobic residues within half_width degrees of its direction."""
    scale = F.create_map(*[F.lit(x) for kv in CONSENSUS_HYDROPHOBICITY.items() for x in kv])
    each = F.transform(characters(c), lambda r, i: F.struct(F.try_element_at(scale, r).alias("h"), (F.radians(i * F.lit(delta))).alias("a")))
    each = F.filter(each, lambda x: x["h"].isNotNull())

    def summed(e: Column) -> Column:
        total = lambda f: F.aggregate(e, F.lit(0.0), lambda a, x: a + x["h"] * f(x["a"]))
        return F.struct(e.alias("each"), total(F.sin).alias("y"), total(F.cos).alias("x"))

    # Residues, their sums and the direction are made once a sequence: a lambda's variable holds what it is given.
    sums = once(once(each, summed), lambda s: F.struct(s["each"].alias("each"), s["y"].alias("y"), s["x"].alias("x"), F.atan2(s["y"], s["x"]).alias("towards")))

    def occupied(s: Column) -> Column:
        wet = F.filter(s["each"], lambda e: e["h"] > 0)
        near = F.filter(wet, lambda e: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.cos(e["a"] - s["towards"])))) <= F.lit(half_width * 3.141592653589793 / 180))
        return F.when(F.size(wet) > 0, F.size(near) / F.size(wet)).otherwise(0.0)

    moment = once(sums, lambda s: F.sqrt(s["y"] * s["y"] + s["x"] * s["x"]))
    some = F.length(c) > 0
    return F.when(some, moment / F.length(c)), F.when(some, once(sums, occupied))


def salt_bridges(c: Column) -> Column:
    """Pairs three or four apart of one of E, D and one of K, R, in either order."""
    sign = F.translate(F.regexp_replace(c, "[^EDKR]", "0"), "EDKR", "--++")
    # Overlapping pairs: a look-ahead consumes nothing but its own first character.
    return F.regexp_count(sign, F.lit(r"-(?=..\+)|\+(?=..-)")) + F.regexp_count(sign, F.lit(r"-(?=...\+)|\+(?=...-)"))


def helix_breakers(c: Column) -> tuple[Column, Column, Column]:
    """Prolines, glycines, and whether there is any."""
    p, g = count_of(c, "P"), count_of(c, "G")
    return p, g, (p + g) > 0


def matrix_score(c: Column, reference: str, matrix: Mapping[str, float]) -> Column:
    """Sum of matrix[pair] along a reference of equal length; NULL for another length or an unknown pair."""
    table = F.create_map(*[F.lit(x) for kv in matrix.items() for x in kv])
    each = F.transform(F.arrays_zip(characters(c).alias("x"), characters(F.lit(reference)).alias("y")), lambda p: F.try_element_at(table, F.concat(p["x"], p["y"])))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)  # a NULL stays
    return F.when(F.length(c) == len(reference), total)


def residue_positions(c: Column, residue: str) -> Column:
    """1-based positions of a residue."""
    return F.array_compact(F.transform(characters(c), lambda r, i: F.when(r == residue, i + 1)))


def thirds(c: Column, residue: str = "G") -> Column:
    """Which thirds hold the residue, in the order of first appearance."""
    n = F.length(c)
    name = lambda i: F.when(i <= n / 3, "front").when(i <= 2 * n / 3, "middle").otherwise("back")
    return F.array_distinct(F.transform(residue_positions(c, residue), name))


def tag_score(c: Column) -> Column:
    """-2 GRAVY + 10 |charge| / n - 2 cysteines, at pH 7.4."""
    return -2 * gravy(c) + 10 * F.abs(net_charge(c, 7.4, PKA_TAG)) / F.length(c) - 2 * count_of(c, "C")


def clean_protein(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s", ""))


def analysis(c: Column) -> dict[str, Column]:
    """The property table of a sequence: NULL metrics and a reason where it can't be analysed."""
    s = clean_protein(c)
    error = F.when(~F.coalesce(is_valid(s), F.lit(False)) & (F.length(s) > 0), F.concat(F.lit("invalid chars: "), invalid_residues(s))).when(F.coalesce(F.length(s), F.lit(0)) < 2, F.lit("too short")).otherwise("")
    helix, turn, sheet = secondary_fractions(s)
    rk, de = count_of(s, "RK"), count_of(s, "DE")
    found = {
        "length": F.length(s), "molecular_weight": molecular_weight(s), "isoelectric_point": isoelectric_point(s), "gravy": gravy(s), "aromaticity": aromaticity(s), "charge_at_ph7": net_charge(s),
        "positive_res_rk": rk, "negative_res_de": de, "charge_sum": rk + de, "helix_fraction": helix, "sheet_fraction": sheet, "turn_fraction": turn, "helix_sheet_sum": helix + sheet,
        "fcr": charged_fraction(s), "ncpr": charge_per_residue(s),
    }
    return {k: F.when(error == "", v) for k, v in found.items()} | {"error": error}


def parsed_regions(c: Column) -> Column:
    """Regions such as `3-5, 6` as an array of (first, last); raises where one can't be read."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")

    def one(p: Column) -> Column:
        first = F.regexp_extract(p, r"^(\d+)", 1)
        last = F.coalesce(F.nullif(F.regexp_extract(p, r"^\d+\s*-\s*(\d+)$", 1), F.lit("")), first)
        a, b = first.try_cast("int"), last.try_cast("int")
        ok = p.rlike(r"^\d+(\s*-\s*\d+)?$") & (a >= 1) & (b >= a)
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(a.alias("first"), b.alias("last"))).otherwise(F.raise_error(F.concat(F.lit("Invalid region: "), p)))

    return F.transform(parts, one)


def region_error(c: Column) -> Column:
    """The first region that can't be read, or ''."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    ends = lambda p: F.transform(F.split(p, r"\s*-\s*"), lambda x: x.try_cast("int"))
    bad = F.filter(parts, lambda p: ~F.coalesce(p.rlike(r"^\d+(\s*-\s*\d+)?$") & (F.get(ends(p), F.lit(0)) >= 1) & (F.element_at(ends(p), -1) >= F.get(ends(p), F.lit(0))), F.lit(False)))
    return F.coalesce(F.get(bad, F.lit(0)), F.lit(""))


def region_positions(c: Column) -> Column:
    """All positions of the regions, in order, a position in two regions twice."""
    return F.flatten(F.transform(parsed_regions(c), lambda r: F.sequence(r["first"], r["last"])))


def copy_count(c: Column) -> Column:
    """A whole number of copies, 1 where blank; NULL where it can't be read."""
    t = F.trim(c.cast("string"))
    x = t.try_cast("double")
    return F.when(t.isNull() | (t == ""), F.lit(1)).when((x >= 0) & (x == F.floor(x)), x.cast("int"))
