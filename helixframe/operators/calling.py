"""Reference-guided haplotype calling from aligned reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.tables import IUPAC
from helixframe.operators.fuzzy import observed_bases, usable_alignments


@dataclass
class Calls:
    """reads: qname, status, hap; positions: designed positions with base counts and tallies of failures; fixed: mismatches of the others."""

    reads: DataFrame
    positions: DataFrame
    fixed: DataFrame


def call(alignments: DataFrame, original: str, design: str, min_mapq: int = 20, min_baseq: int = 8, min_fixed: int = 12) -> Calls:
    """Statuses in order: low_mapq; incomplete_or_low_baseq, at the first designed position that is missing, deleted or weak; invalid_design; assigned.

    A read stops at its first failing position: those before it count, and it has
    its own tally; later ones count for nothing.
    """
    designed = [k for k, (o, d) in enumerate(zip(original, design, strict=True), 1) if o != d or len(IUPAC[d]) > 1]
    rows = usable_alignments(alignments)
    good = rows.filter(F.col("mapq") >= min_mapq)
    cells = observed_bases(good).select("qname", "ref_pos", "base", "q")
    wanted = F.array(*map(F.lit, designed)) if designed else F.array().cast("array<int>")
    seen = cells.filter(F.array_contains(wanted, F.col("ref_pos"))).groupBy("qname").agg(F.map_from_entries(F.collect_list(F.struct("ref_pos", F.struct("base", "q")))).alias("at"))

    def fate(p):
        x = F.try_element_at("at", p)
        return F.struct(p.alias("pos"), x["base"].alias("base"), F.when(x.isNull(), "missing").when(x["base"] == "-", "deletion").when(x["q"] < min_baseq, "low_quality").alias("failure"))

    per = good.select("qname").join(seen, "qname", "left").withColumn("cells", F.transform(wanted, fate))
    per = per.withColumn("failed", F.get(F.filter("cells", lambda c: c["failure"].isNotNull()), F.lit(0))["pos"])
    allowed = F.create_map(*[F.lit(x) for p in designed for x in (p, IUPAC[design[p - 1]])]) if designed else F.create_map()
    fits = F.forall("cells", lambda c: F.contains(F.try_element_at(allowed, c["pos"]), c["base"])) if designed else F.lit(True)
    hap = F.array_join(F.transform("cells", lambda c: c["base"]), "")
    status = F.when(F.col("failed").isNotNull(), "incomplete_or_low_baseq").when(~fits, "invalid_design").otherwise("assigned")
    called = per.select("qname", "cells", "failed", status.alias("status"), F.when(F.col("failed").isNull(), hap).alias("hap"))
    reads = rows.filter(F.col("mapq") < min_mapq).select("qname", F.lit("low_mapq").alias("status"), F.lit(None).cast("string").alias("hap")).unionByName(called.select("qname", "status", "hap"))
    counted = called.select("failed", F.explode("cells").alias("c")).filter(F.col("failed").isNull() | (F.col("c.pos") <= F.col("failed"))).select("c.*")
    positions = counted.groupBy("pos").agg(
        *(F.count_if(F.col("failure").isNull() & (F.col("base") == b)).alias(b) for b in "ACGT"), *(F.count_if(F.col("failure") == f).alias(f) for f in ("missing", "deletion", "low_quality"))
    )
    reference = F.create_map(*[F.lit(x) for p, o in enumerate(original, 1) if p not in designed for x in (p, o)])
    others = cells.withColumn("expected", F.try_element_at(reference, F.col("ref_pos"))).filter(F.col("expected").isNotNull() & (F.col("base") != "-") & (F.col("q") >= min_fixed))
    fixed = others.groupBy(F.col("ref_pos").alias("pos")).agg(F.count("*").alias("callable"), F.count_if(F.col("base") != F.col("expected")).alias("mismatches"), *(F.count_if((F.col("base") == b) & (F.col("base") != F.col("expected"))).alias(f"alt_{b.lower()}") for b in "ACGT"))
    return Calls(reads, positions, fixed)


def reconstructed(hap, original: str, design: str):
    """The whole sequence with called bases at the designed positions."""
    parts, k = [], 0
    for o, d in zip(original, design, strict=True):
        if o != d or len(IUPAC[d]) > 1:
            k += 1
            parts.append(F.substring(hap, k, 1))
        else:
            parts.append(F.lit(o))
    return F.concat(*parts)


def variants(reads: DataFrame, original: str, design: str) -> DataFrame:
    """hap, reads, frequency, sequence, nt_changes, protein, aa_changes of assigned reads."""
    counts = reads.filter("status = 'assigned'").groupBy("hap").agg(F.count("*").alias("reads"))
    total = counts.agg(F.sum("reads").alias("total"))
    seq = reconstructed(F.col("hap"), original, design)
    rows = counts.crossJoin(F.broadcast(total)).select("hap", "reads", (F.col("reads") / F.col("total")).alias("frequency"), seq.alias("sequence"))
    wild = F.lit(original)
    return rows.withColumns({"nt_changes": dna.changes(wild, F.col("sequence")), "protein": dna.translate(F.col("sequence"))}).withColumn("aa_changes", dna.changes(dna.translate(wild), F.col("protein")))
