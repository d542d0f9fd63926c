"""Column functions on hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import dna, protein
from helixframe.functions.tables import CODONS, HYDROPATHY, IUPAC
from helixframe.operators import codons, filters


@pytest.fixture
def of(spark):
    """The value of a column expression over one string."""

    def value(text, make):
        return spark.createDataFrame([(text,)], "s string").select(make(F.col("s")).alias("v")).first()["v"]

    return value


@pytest.mark.parametrize(("seq", "n"), [("AAAATTCG", 4), ("", 0), ("ACGT", 1), ("GGGTTTTTA", 5)])
def test_longest_run(of, seq, n):
    assert of(seq, dna.longest_run) == n


def test_translations(of):
    assert of("ATGTAA", dna.translate) == "M*"
    assert of("ATGTAAATG", lambda c: dna.translate(c, stop="cut")) == "M"
    assert of("ATGTAAATG", lambda c: dna.translate(c, stop="drop")) is None
    assert of("ATGNNNAT", dna.translate) == "MX"
    assert of("AT", dna.translate) == ""
    assert of(None, dna.translate) is None
    assert of("CATGTA", lambda c: dna.translate(c, frame=1)) == "M"
    with pytest.raises(Exception, match="multiple of three"):
        of("ATGTA", lambda c: dna.translate(c, trailing="error"))
    with pytest.raises(Exception, match="unknown codon"):
        of("ATGNNN", lambda c: dna.translate(c, unknown="error"))


def test_every_codon(spark):
    rows = spark.createDataFrame(list(CODONS.items()), "codon string, aa string")
    assert rows.filter(dna.codon_residue(F.col("codon")) != F.col("aa")).isEmpty()


def test_reverse_complements(of):
    assert of("ACGTN", dna.reverse_complement) == "NACGT"
    assert of("ARG", lambda c: dna.reverse_complement(c, "N")) == "CNT"
    assert of("ARG", lambda c: dna.reverse_complement(c, "keep")) == "CRT"
    with pytest.raises(Exception, match="not a DNA sequence"):
        of("ARG", dna.reverse_complement)


def test_qualities_and_differences(of):
    assert of("!I", dna.phred) == [0, 40]
    assert of("", dna.phred) == []
    assert of("ACGT", lambda c: dna.hamming(c, F.lit("AGGA"))) == 2
    assert of("ACGT", lambda c: dna.hamming(c, F.lit("AG"))) is None
    assert of("ACGT", lambda c: dna.hamming(c, F.lit("AG"), strict=False)) == 1
    assert of("ACGT", lambda c: dna.changes(c, F.lit("AGGA"))) == "C2G;T4A"
    assert dna.resolve_for_mapping("RYA", "CCA") == "ACA"
    assert [tuple(x) for x in of("5S10M2D", dna.cigar_operations)] == [(5, "S"), (10, "M"), (2, "D")]


def test_designs(spark):
    assert dna.design_space("NNK") == 32
    got = [r.s for r in spark.range(32).select(dna.decode_index(F.col("id"), "NNK").alias("s")).collect()]
    assert len(set(got)) == 32 and all(a in IUPAC[d] for s in got for a, d in zip(s, "NNK", strict=True))


@pytest.mark.parametrize(("text", "want"), [("8-11,16", [8, 9, 10, 11, 16]), ("", []), (None, []), (" 3 - 4 , 4", [3, 4, 4])])
def test_region_positions(of, text, want):
    assert of(text, protein.region_positions) == want


@pytest.mark.parametrize("bad", ["5-3", "x", "0-2", "3-", "1-2-3"])
def test_bad_regions(of, bad):
    assert of(bad, protein.region_error) == bad
    with pytest.raises(Exception, match="Invalid region"):
        of(bad, protein.region_positions)


@pytest.mark.parametrize(("text", "n"), [("2", 2), ("", 1), (None, 1), ("3.0", 3), ("1.5", None), ("-1", None), ("x", None), ("0", 0)])
def test_copy_counts(of, text, n):
    assert of(text, protein.copy_count) == n


def plain_moment(seq):
    from helixframe.functions.tables import CONSENSUS_HYDROPHOBICITY as H

    at = [(H[r], math.radians(100 * i)) for i, r in enumerate(seq) if r in H]
    y, x = sum(h * math.sin(a) for h, a in at), sum(h * math.cos(a) for h, a in at)
    towards = math.atan2(y, x)
    wet = [a for h, a in at if h > 0]
    near = [a for a in wet if abs((a - towards + math.pi) % (2 * math.pi) - math.pi) <= math.radians(60)]
    return math.hypot(x, y) / len(seq), len(near) / len(wet) if wet else 0.0


@pytest.mark.parametrize("seq", ["EKLLAAXAKEWGGPIVFYW", "KKKK", "A", "AXXL"])
def test_moment_and_face(spark, seq):
    row = spark.createDataFrame([(seq,)], "s string").select(*(c.alias(n) for n, c in zip("mf", protein.moment_and_face(F.col("s")), strict=True))).first()
    assert (row.m, row.f) == pytest.approx(plain_moment(seq))


def test_sums_have_the_last_bits_of_a_plain_sum(spark):
    """Residue by residue in the scale's order: what stands at a limit is on the side that plain arithmetic says."""
    r = random.Random(3)
    seqs = ["".join(r.choices("ACDEFGHIKLMNPQRSTVWY", k=64)) for _ in range(3000)]
    got = {x.s: x.g for x in spark.createDataFrame([(s,) for s in seqs], "s string").select("s", protein.gravy(F.col("s")).alias("g")).collect()}
    for s in seqs:
        total = 0.0
        for residue, x in HYDROPATHY.items():
            total += x * s.count(residue)
        assert got[s] == total / 64


def test_protein_properties(of):
    assert of("EAAKEAAR", protein.salt_bridges) == 2
    assert of("GAAAAG", lambda c: protein.residue_positions(c, "G")) == [1, 6]
    assert of("GAAAAG", protein.thirds) == ["front", "back"]
    assert of("ACDX", protein.invalid_residues) == "X"
    assert of("AC", lambda c: protein.instability_index(c, {"AC": 44.94})) == pytest.approx(224.7)
    assert of("ACW", lambda c: protein.matrix_score(c, "AC", {})) is None
    ph = of("KKDE", protein.isoelectric_point)
    assert abs(of("KKDE", lambda c: protein.net_charge(c, ph))) < 1e-6
    assert of("", lambda c: protein.moment_and_face(c)[0]) is None


def test_codon_search_spaces(spark):
    t = codons.codon_table(spark)
    assert (t.count(), codons.not_only_stops(t).count(), codons.safe(t).count()) == (3375, 3370, 2351)


def test_repair(spark):
    rows = spark.createDataFrame([("ACA", "III"), ("CCA", "+II"), ("CCA", "III"), ("AGT", "II+"), ("AC", "II")], "seq string, qual string")
    got = filters.repaired(F.col("seq"), F.col("qual"), "ASR", IUPAC)
    assert [tuple(r) for r in rows.select(got["reason"].alias("r"), got["repaired"].alias("f")).collect()] == [
        (None, "ACA"), (None, "ACA"), ("confident_mismatch", None), ("ambiguous_low_quality", None), ("length", None),
    ]


def test_missing_values_in_filters(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double")
    kept = lambda f: [r.x for r in rows.filter(f).collect()]
    assert kept(filters.at_most(F.col("x"), 3)) == [1.0]
    assert kept(filters.outside(F.col("x"), 0, 3)) == [5.0]
    assert kept(filters.at_least(F.col("x"), 3)) == [5.0]
    assert rows.select(filters.first_failing([("high", F.col("x") > 3)]).alias("r")).filter("r is null").count() >= 2
