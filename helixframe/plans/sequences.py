"""Queries on DNA reads and protein sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import dna, protein
from helixframe.functions.tables import CODONS, CONSENSUS_HYDROPHOBICITY, CONSERVATIVE, HELIX_PROPENSITY, HYDROPATHY, IUPAC, MASSES, PKA, PKA_TAG, WATER
from helixframe.operators import expansion, filters
from helixframe.plans.core import PROTEINS, READS, count_sql, proteins, query, r9, reads

_CODON_MAP = "map {" + ", ".join(f"'{c}': '{a}'" for c, a in CODONS.items()) + "}"


def codons_sql(seq: str, n: int) -> str:
    """Translation of the first n bases in DuckDB, unknown codons as X."""
    return f"array_to_string(list_transform(range(1, {n} - 1, 3), lambda i: coalesce({_CODON_MAP}[substr({seq}, i, 3)], 'X')), '')"


TRANSLATED = f"{READS}, called AS (SELECT *, {codons_sql('seq', 63)} AS aa FROM reads)"


def called(spark, sf_dir):
    return reads(spark, sf_dir).withColumn("aa", dna.translate(F.col("seq")))


@query(
    "flagship_variant_population",
    f"""WITH {TRANSLATED}, good AS (SELECT sample, aa, count(*) AS n FROM called WHERE NOT contains(aa, '*') GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, aa) AS rank, sum(n) OVER (PARTITION BY sample) AS total FROM good)
SELECT sample, aa, n, CAST(rank AS INTEGER) AS rank, round(n / total, 9) AS fraction FROM ranked WHERE rank <= 10""",
)
def flagship(spark, sf_dir):
    """Reads to proteins, without stops, counted and ranked: the ten commonest variants of each sample."""
    from pyspark.sql import Window

    counts = called(spark, sf_dir).filter(~F.contains("aa", F.lit("*"))).groupBy("sample", "aa").agg(F.count("*").alias("n"))
    w = Window.partitionBy("sample")
    top = counts.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "aa")), "total": F.sum("n").over(w)})
    return top.filter("rank <= 10").select("sample", "aa", "n", "rank", r9(F.col("n") / F.col("total")).alias("fraction"))


@query(
    "d1_d5_strand_functions",
    f"""WITH {READS} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS strict, reverse(translate(replace(seq, 'AC', 'AR'), 'ACGT', 'TGCA')) AS kept,
reverse(translate(regexp_replace(replace(seq, 'AC', 'AR'), '[^ACGTN]', 'N', 'g'), 'ACGT', 'TGCA')) AS unknown_n, translate(seq, 'ACGT', 'TGCA') AS complement,
translate(upper(regexp_replace(lower(replace(seq, 'TT', ' u')), '\\s', '', 'g')), 'U', 'T') AS cleaned FROM reads""",
)
def strands(spark, sf_dir):
    odd = F.replace("seq", F.lit("AC"), F.lit("AR"))
    return reads(spark, sf_dir).select(
        "read_id", dna.reverse_complement(F.col("seq")).alias("strict"), dna.reverse_complement(odd, "keep").alias("kept"), dna.reverse_complement(odd, "N").alias("unknown_n"),
        dna.complement(F.col("seq")).alias("complement"), dna.clean_dna(F.lower(F.replace("seq", F.lit("TT"), F.lit(" u")))).alias("cleaned"),
    )


@query(
    "d6_d9_translations",
    f"""WITH {READS}, t AS (SELECT read_id, {codons_sql('seq', 63)} AS whole, {codons_sql('substr(seq, 2)', 63)} AS frame_1, {codons_sql("replace(seq, 'AC', 'AN')", 63)} AS unknown FROM reads)
SELECT read_id, whole, split_part(whole, '*', 1) AS cut, CASE WHEN NOT contains(whole, '*') THEN whole END AS dropped, frame_1, unknown FROM t""",
)
def translations(spark, sf_dir):
    s = F.col("seq")
    return reads(spark, sf_dir).select(
        "read_id", dna.translate(F.substring("seq", 1, 63), trailing="error").alias("whole"), dna.translate(s, stop="cut").alias("cut"), dna.translate(s, stop="drop").alias("dropped"), dna.translate(s, frame=1).alias("frame_1"),
        dna.translate(F.replace("seq", F.lit("AC"), F.lit("AN"))).alias("unknown"),
    )


@query("p10_translate_table", f"""WITH {READS}, t AS (SELECT read_id, sample, {codons_sql('seq', 63)} AS whole FROM reads)
SELECT read_id, sample, split_part(whole, '*', 1) AS protein, '1 trailing bases ignored' || CASE WHEN contains(substr(whole, 1, length(whole) - 1), '*') THEN '; stopped early' ELSE '' END AS warnings FROM t""")  # fmt: skip
def translate_table(spark, sf_dir):
    """The DNA column replaced by its protein and what was left out."""
    s = F.col("seq")
    return reads(spark, sf_dir).select("read_id", "sample", dna.translate(s, stop="cut").alias("protein"), dna.translation_warnings(s).alias("warnings"))


_PHRED = "list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)"


@query(
    "d14_d16_w6_read_stats",
    f"""WITH {READS}, p AS (SELECT *, {_PHRED} AS scores FROM reads)
SELECT read_id, {count_sql('A')} AS a_count, {count_sql('C')} AS c_count, {count_sql('G')} AS g_count, {count_sql('T')} AS t_count, {count_sql('N')} AS n_count,
round(100.0 * {count_sql('GC')} / length(seq), 9) AS gc_pct, CAST(list_sum(scores) AS BIGINT) AS quality_sum, round(list_sum(scores) / len(scores), 9) AS mean_quality,
list_min(scores) AS min_quality, list_max(scores) AS max_quality, round(100 * pow(10.0, -(list_sum(scores) / len(scores)) / 10), 9) AS est_error_pct,
list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda x: length(x))) AS longest_homopolymer FROM p""",
)
def read_stats(spark, sf_dir):
    s, scores = F.col("seq"), dna.phred(F.col("qual"))
    total = dna.quality_sum(F.col("qual"))
    mean = total / F.length("qual")
    return reads(spark, sf_dir).select(
        "read_id", *(dna.count_of(s, b).alias(f"{b.lower()}_count") for b in "ACGTN"), r9(100 * dna.count_of(s, "GC") / F.length(s)).alias("gc_pct"), total.cast("long").alias("quality_sum"), r9(mean).alias("mean_quality"),
        F.array_min(scores).alias("min_quality"), F.array_max(scores).alias("max_quality"), r9(100 * F.pow(F.lit(10.0), -mean / 10)).alias("est_error_pct"), dna.longest_run(s).alias("longest_homopolymer"),
    )


@query("s7_read_count", f"WITH {READS}, lines AS (SELECT unnest(['@' || read_id, seq, '+', qual]) AS line FROM reads) SELECT CAST(count(*) // 4 AS BIGINT) AS n_reads FROM lines")
def read_count(spark, sf_dir):
    """Lines of a read file over four."""
    lines = reads(spark, sf_dir).select(F.explode(F.array(F.concat(F.lit("@"), "read_id"), "seq", F.lit("+"), "qual")).alias("line"))
    return lines.agg(F.floor(F.count("*") / 4).alias("n_reads"))


@query(
    "d18_d22_differences",
    f"""WITH {READS}, p AS (SELECT read_id, substr(seq, 1, 32) AS a, substr(seq, 33) AS b, substr(seq, 1, 20) AS c FROM reads)
SELECT read_id, array_to_string(list_filter(list_transform(range(1, 33), lambda i: CASE WHEN substr(a, i, 1) <> substr(b, i, 1) THEN substr(a, i, 1) || i || substr(b, i, 1) END), lambda x: x IS NOT NULL), ';') AS changes,
hamming(a, b) AS strict, hamming(substr(b, 1, 20), c) AS truncated, levenshtein(a, b) AS edits FROM p""",
)
def differences(spark, sf_dir):
    """The two halves of each read, and the second one against a shorter piece."""
    a, b, c = F.substring("seq", 1, 32), F.substring("seq", 33, 32), F.substring("seq", 1, 20)
    return reads(spark, sf_dir).select("read_id", dna.changes(a, b).alias("changes"), dna.hamming(a, b).cast("long").alias("strict"), dna.hamming(b, c, strict=False).cast("long").alias("truncated"), F.levenshtein(a, b).cast("long").alias("edits"))


DESIGN = "NNKRYN"
WHOLE = "NNN" * 9 + DESIGN + "NHN" * 2 + "NNN" * 8 + "N"  # of a whole read


@query("f12_design_conformity", f"WITH {READS} SELECT sample, count(*) AS n, count(*) FILTER (regexp_matches(seq, '{dna.design_pattern(WHOLE)}')) AS conforming FROM reads GROUP BY 1")
def conformity(spark, sf_dir):
    ok = dna.conforms(F.col("seq"), WHOLE)
    return reads(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n"), F.count_if(ok).alias("conforming"))


_IUPAC_MAP = "map {" + ", ".join(f"'{c}': '{a}'" for c, a in IUPAC.items()) + "}"


REPAIR = "N" * 20 + "ARNTCK" + "N" * 38


@query(
    "f13_repair_by_quality",
    f"""WITH {READS}, cell AS (
  SELECT read_id, sample, unnest(range(1, 65)) AS i, unnest(string_split(seq, '')) AS b, unnest(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS q,
         unnest(list_transform(string_split('{REPAIR}', ''), lambda d: {_IUPAC_MAP}[d])) AS allowed FROM reads
), judged AS (
  SELECT *, NOT contains(allowed, b) AS misfit, CASE WHEN NOT contains(allowed, b) THEN CASE WHEN q >= 30 THEN 'confident_mismatch' WHEN length(allowed) > 1 THEN 'ambiguous_low_quality' END END AS why FROM cell
), per AS (
  SELECT read_id, sample, arg_min(why, i) FILTER (why IS NOT NULL) AS reason, string_agg(CASE WHEN misfit AND length(allowed) = 1 THEN allowed ELSE b END, '' ORDER BY i) AS fixed FROM judged GROUP BY 1, 2)
SELECT coalesce(reason, 'kept') AS reason, CASE WHEN reason IS NULL THEN fixed END AS repaired, count(*) AS n FROM per GROUP BY 1, 2""",
)
def repair(spark, sf_dir):
    got = filters.repaired(F.col("seq"), F.col("qual"), REPAIR, IUPAC)
    return reads(spark, sf_dir).select(F.coalesce(got["reason"], F.lit("kept")).alias("reason"), got["repaired"].alias("repaired")).groupBy("reason", "repaired").agg(F.count("*").alias("n"))


@query(
    "f11_first_failing_position",
    f"""WITH {READS}, cell AS (SELECT read_id, sample, unnest(range(1, 65)) AS i, unnest(list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)) AS q FROM reads),
per AS (SELECT read_id, sample, min(i) FILTER (q < 5) AS pos FROM cell GROUP BY 1, 2)
SELECT sample, CASE WHEN read_id % 60 < 20 THEN 'low_mapq' WHEN pos IS NOT NULL THEN 'low_baseq_' || pos ELSE 'assigned' END AS status, count(*) AS n FROM per GROUP BY 1, 2""",
)
def gates(spark, sf_dir):
    """Mapping quality first, then the first designed base below the limit."""
    bases = F.transform(dna.phred(F.col("qual")), lambda q, i: F.struct((i + 1).alias("position"), F.when(q < 5, F.concat(F.lit("low_baseq_"), i + 1)).alias("reason")))
    status = filters.quality_gate(bases, F.col("read_id") % 60, 20)
    return reads(spark, sf_dir).select("sample", status.alias("status")).groupBy("sample", "status").agg(F.count("*").alias("n"))


@query("f14_g12_g13_stop_free_counts", f"WITH {TRANSLATED} SELECT sample, count(*) FILTER (contains(aa, '*')) AS with_stop, count(*) FILTER (NOT contains(aa, '*')) AS kept, count(DISTINCT aa) FILTER (NOT contains(aa, '*')) AS variants FROM called GROUP BY 1")
def stop_free(spark, sf_dir):
    stop = F.contains("aa", F.lit("*"))
    return called(spark, sf_dir).groupBy("sample").agg(F.count_if(stop).alias("with_stop"), F.count_if(~stop).alias("kept"), F.count_distinct(F.when(~stop, F.col("aa"))).alias("variants"))


@query("f15_x8_restriction_sites", f"WITH {READS} SELECT sample, count(*) AS n, count(*) FILTER (contains(seq, 'GAATTC')) AS palindrome, count(*) FILTER (contains(seq, 'GTCTC') OR contains(seq, 'GAGAC')) AS both_strands FROM reads GROUP BY 1")
def restriction(spark, sf_dir):
    s = F.col("seq")
    return reads(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n"), F.count_if(dna.contains_site(s, "GAATTC")).alias("palindrome"), F.count_if(dna.contains_site(s, "GTCTC")).alias("both_strands"))


@query("d13_mixed_radix_decode", f"""SELECT event_id, {" || ".join(f"substr('{IUPAC[c]}', CAST((event_id % {dna.design_space(DESIGN)} // {dna.design_space(DESIGN[k + 1:])}) % {len(IUPAC[c])} AS INTEGER) + 1, 1)" for k, c in enumerate(DESIGN))} AS seq FROM events""")
def decode(spark, sf_dir):
    """The concrete sequence that each number stands for in a design."""
    from helixframe.plans.core import table

    index = F.pmod("event_id", F.lit(dna.design_space(DESIGN)))
    return table(spark, sf_dir, "events").select("event_id", dna.decode_index(index, DESIGN).alias("seq"))


@query("d27_j14_orientation", f"""WITH {READS} SELECT sample, CASE WHEN starts_with(seq, 'AC') THEN 'sense' WHEN starts_with(reverse(translate(seq, 'ACGT', 'TGCA')), 'AC') THEN 'antisense' ELSE 'unknown' END AS orientation,
ends_with(seq, 'AA') AS poly_a, count(*) AS n FROM reads GROUP BY 1, 2, 3""")  # fmt: skip
def orientation(spark, sf_dir):
    s = F.col("seq")
    kind = F.when(s.startswith("AC"), "sense").when(dna.reverse_complement(s).startswith("AC"), "antisense").otherwise("unknown")
    return reads(spark, sf_dir).groupBy("sample", kind.alias("orientation"), s.endswith("AA").alias("poly_a")).agg(F.count("*").alias("n"))


@query(
    "g14_motif_histograms",
    f"""WITH {READS}, m AS (SELECT length(seq) - CAST(read_id % 3 AS INTEGER) AS len, substr(seq, 1, 2) AS m5, right(seq, 2) AS m3 FROM reads)
SELECT coalesce(len, -1) AS len, m5, m3, count(*) AS n FROM m GROUP BY GROUPING SETS ((len), (m5), (len, m3), (m5, m3))""",
)
def histograms(spark, sf_dir):
    """Four histograms in one pass."""
    m = reads(spark, sf_dir).select((F.length("seq") - (F.col("read_id") % 3).cast("int")).alias("len"), F.substring("seq", 1, 2).alias("m5"), F.right("seq", F.lit(2)).alias("m3"))
    sets = [[F.col("len")], [F.col("m5")], [F.col("len"), F.col("m3")], [F.col("m5"), F.col("m3")]]
    return m.groupingSets(sets, "len", "m5", "m3").agg(F.count("*").alias("n")).select(F.coalesce("len", F.lit(-1)).alias("len"), "m5", "m3", "n")


@query("g15_quality_by_position", f"""WITH {READS}, c AS (SELECT sample, unnest(range(1, 65)) AS pos, unnest({_PHRED}) AS q FROM reads) SELECT sample, CAST(pos AS INTEGER) AS pos, CAST(sum(q) AS BIGINT) AS quality_sum, count(*) AS n FROM c GROUP BY 1, 2""")
def quality_by_position(spark, sf_dir):
    each = reads(spark, sf_dir).select("sample", F.posexplode(dna.phred(F.col("qual"))).alias("at", "q"))
    return each.groupBy("sample", (F.col("at") + 1).alias("pos")).agg(F.sum("q").alias("quality_sum"), F.count("*").alias("n"))


@query("g10_base_counts", f"""WITH {READS}, c AS (SELECT sample, unnest(range(1, 65)) AS pos, unnest(string_split(seq, '')) AS b, unnest(list_transform(string_split(qual, ''), lambda x: ascii(x) - 33)) AS q FROM reads)
SELECT sample, CAST(pos AS INTEGER) AS pos, count(*) FILTER (b = 'A' AND q >= 8) AS "A", count(*) FILTER (b = 'C' AND q >= 8) AS "C", count(*) FILTER (b = 'G' AND q >= 8) AS "G", count(*) FILTER (b = 'T' AND q >= 8) AS "T", count(*) FILTER (q < 8) AS low_quality FROM c GROUP BY 1, 2""")  # fmt: skip
def base_counts(spark, sf_dir):
    cells = F.arrays_zip(dna.characters(F.col("seq")).alias("b"), dna.phred(F.col("qual")).alias("q"))
    each = reads(spark, sf_dir).select("sample", F.posexplode(cells).alias("at", "x")).select("sample", (F.col("at") + 1).alias("pos"), "x.b", "x.q")
    good = F.col("q") >= 8
    return each.groupBy("sample", "pos").agg(*(F.count_if((F.col("b") == b) & good).alias(b) for b in "ACGT"), F.count_if(~good).alias("low_quality"))


@query("g11_fixed_position_mismatches", f"""WITH {READS}, c AS (SELECT unnest(range(33, 65)) AS pos, unnest(string_split(substr(seq, 33, 32), '')) AS b, unnest(list_transform(string_split(substr(qual, 33, 32), ''), lambda x: ascii(x) - 33)) AS q FROM reads)
SELECT CAST(pos AS INTEGER) AS pos, count(*) FILTER (q >= 12) AS callable, count(*) FILTER (q >= 12 AND b <> 'A') AS mismatches, count(*) FILTER (q >= 12 AND b = 'C') AS alt_c FROM c GROUP BY 1 HAVING count(*) FILTER (q >= 12) > 0""")  # fmt: skip
def fixed_mismatches(spark, sf_dir):
    cells = F.arrays_zip(dna.characters(F.substring("seq", 33, 32)).alias("b"), dna.phred(F.substring("qual", 33, 32)).alias("q"))
    each = reads(spark, sf_dir).select(F.posexplode(cells).alias("at", "x")).select((F.col("at") + 33).alias("pos"), "x.b", "x.q")
    good = F.col("q") >= 12
    return each.groupBy("pos").agg(F.count_if(good).alias("callable"), F.count_if(good & (F.col("b") != "A")).alias("mismatches"), F.count_if(good & (F.col("b") == "C")).alias("alt_c")).filter("callable > 0")


# --- proteins ------------------------------------------------------------


def _scale(scale: dict[str, float], of: str = "seq") -> str:
    return "(" + " + ".join(f"CAST({x} AS DOUBLE) * {count_sql(r, of)}" for r, x in scale.items() if x) + ")"


def _charge(ph: float, pka: dict[str, float]) -> str:
    out = f"{1 / (1 + 10 ** (ph - pka['N_TERM'])) - 1 / (1 + 10 ** (pka['C_TERM'] - ph))!r}::DOUBLE"
    for r in "DECY":
        out += f" - {count_sql(r)} / (1 + pow(10::DOUBLE, {pka[r]} - {ph}))"
    for r in "HKR":
        out += f" + {count_sql(r)} / (1 + pow(10::DOUBLE, {ph} - {pka[r]}))"
    return f"({out})"


@query(
    "q1_q4_q6_q14_property_table",
    f"""WITH {PROTEINS} SELECT protein_id, length(seq) AS length, round({_scale(MASSES)} + {WATER}, 4) AS molecular_weight, round({_scale(HYDROPATHY)} / length(seq), 9) AS gravy, round({count_sql('FWY')} / length(seq), 9) AS aromaticity,
round({_charge(7.0, PKA)}, 9) AS charge, round(({count_sql('KRED')} + 0.1::DOUBLE * {count_sql('H')}) / length(seq), 9) AS fcr, round(({count_sql('KR')} + 0.1::DOUBLE * {count_sql('H')} - {count_sql('ED')}) / length(seq), 9) AS ncpr,
round({count_sql('EMALK')} / length(seq), 9) AS helix, round({count_sql('NPGSD')} / length(seq), 9) AS turn, round({count_sql('VIYFWLT')} / length(seq), 9) AS sheet,
{count_sql('RK')} + {count_sql('DE')} AS charge_sum, round(100 * ({count_sql('A')} + 2.9::DOUBLE * {count_sql('V')} + 3.9::DOUBLE * {count_sql('IL')}) / length(seq), 9) AS aliphatic FROM proteins""",
)
def properties(spark, sf_dir):
    p = protein.analysis(F.col("seq"))
    return proteins(spark, sf_dir).select(
        "protein_id", p["length"].alias("length"), F.round(p["molecular_weight"], 4).alias("molecular_weight"), r9(p["gravy"]).alias("gravy"), r9(p["aromaticity"]).alias("aromaticity"), r9(p["charge_at_ph7"]).alias("charge"),
        r9(p["fcr"]).alias("fcr"), r9(p["ncpr"]).alias("ncpr"), r9(p["helix_fraction"]).alias("helix"), r9(p["turn_fraction"]).alias("turn"), r9(p["sheet_fraction"]).alias("sheet"), p["charge_sum"].alias("charge_sum"), r9(protein.aliphatic_index(F.col("seq"))).alias("aliphatic"),
    )


_IONISABLE = ", ".join(f"{count_sql(r)} AS n_{r}" for r in "DECYHKR")
_AT_MID = (
    f"1 / (1 + 10 ** (mid - {PKA['N_TERM']})) - 1 / (1 + 10 ** ({PKA['C_TERM']} - mid))"
    + "".join(f" - n_{r} / (1 + 10 ** ({PKA[r]} - mid))" for r in "DECY")
    + "".join(f" + n_{r} / (1 + 10 ** (mid - {PKA[r]}))" for r in "HKR")
)


@query("q6_isoelectric_point", f"""WITH RECURSIVE {PROTEINS}, c AS (SELECT protein_id, {_IONISABLE} FROM proteins), b(protein_id, lo, hi, step) AS (SELECT protein_id, 0::DOUBLE, 14::DOUBLE, 0 FROM c
UNION ALL SELECT protein_id, CASE WHEN {_AT_MID} > 0 THEN mid ELSE lo END, CASE WHEN {_AT_MID} > 0 THEN hi ELSE mid END, step + 1 FROM (SELECT b.*, (lo + hi) / 2 AS mid FROM b WHERE step < 40) JOIN c USING (protein_id))
SELECT protein_id, round((lo + hi) / 2, 6) AS isoelectric_point FROM b WHERE step = 40""")  # fmt: skip
def isoelectric(spark, sf_dir):
    """The pH of no charge."""
    return proteins(spark, sf_dir).select("protein_id", F.round(protein.isoelectric_point(F.col("seq")), 6).alias("isoelectric_point"))


@query("q1_f7_invalid_sequences", f"""WITH {PROTEINS}, s AS (SELECT protein_id, CASE WHEN protein_id % 5 = 0 THEN replace(seq, 'A', 'B') WHEN protein_id % 7 = 0 THEN 'a' ELSE seq END AS seq FROM proteins)
SELECT protein_id, CASE WHEN contains(seq, 'B') THEN 'invalid chars: B' WHEN length(seq) < 2 THEN 'too short' ELSE '' END AS error FROM s""")  # fmt: skip
def invalid(spark, sf_dir):
    s = F.when(F.col("protein_id") % 5 == 0, F.replace("seq", F.lit("A"), F.lit("B"))).when(F.col("protein_id") % 7 == 0, "a").otherwise(F.col("seq"))
    return proteins(spark, sf_dir).select("protein_id", protein.analysis(s)["error"].alias("error"))


_H = "map {" + ", ".join(f"'{r}': {x}::DOUBLE" for r, x in CONSENSUS_HYDROPHOBICITY.items()) + "}"
_BRIDGES = " + ".join(f"len(list_filter(range(1, length(m) - {g - 1}), lambda i: (contains('ED', substr(m, i, 1)) AND contains('KR', substr(m, i + {g}, 1))) OR (contains('KR', substr(m, i, 1)) AND contains('ED', substr(m, i + {g}, 1)))))" for g in (3, 4))


@query(
    "q8_q12_p8_motif_block",
    f"""WITH {PROTEINS}, motif AS (SELECT protein_id, substr(seq, 4, 19) AS m FROM proteins),
vec AS (SELECT *, list_sum(list_transform(range(1, 20), lambda i: {_H}[substr(m, i, 1)] * sin(radians((i - 1) * 100.0)))) AS y, list_sum(list_transform(range(1, 20), lambda i: {_H}[substr(m, i, 1)] * cos(radians((i - 1) * 100.0)))) AS x FROM motif)
SELECT protein_id, m AS motif, round({_scale(HELIX_PROPENSITY, 'm')}, 9) AS propensity_sum, round({_scale(HELIX_PROPENSITY, 'm')} / 19, 9) AS propensity_mean, round(sqrt(y * y + x * x) / 19, 9) AS moment,
CAST({_BRIDGES} AS INTEGER) AS salt_bridges, {count_sql('P', 'm')} AS prolines, {count_sql('G', 'm')} AS glycines, {count_sql('PG', 'm')} > 0 AS breaker FROM vec""",
)
def motif_block(spark, sf_dir):
    m = F.col("motif")
    total, mean = protein.helix_propensity(m)
    p, g, flag = protein.helix_breakers(m)
    rows = proteins(spark, sf_dir).select("protein_id", F.substring("seq", 4, 19).alias("motif"))
    return rows.select("protein_id", "motif", r9(total).alias("propensity_sum"), r9(mean).alias("propensity_mean"), r9(protein.moment_and_face(m)[0]).alias("moment"), protein.salt_bridges(m).alias("salt_bridges"), p.alias("prolines"), g.alias("glycines"), flag.alias("breaker"))


@query(
    "q9_helical_face",
    f"""WITH {PROTEINS}, motif AS (SELECT protein_id, substr(seq, 4, 19) AS m FROM proteins),
vec AS (SELECT *, list_sum(list_transform(range(1, 20), lambda i: {_H}[substr(m, i, 1)] * sin(radians((i - 1) * 100.0)))) AS y, list_sum(list_transform(range(1, 20), lambda i: {_H}[substr(m, i, 1)] * cos(radians((i - 1) * 100.0)))) AS x FROM motif),
wet AS (SELECT protein_id, atan2(y, x) AS towards, list_filter(range(1, 20), lambda i: {_H}[substr(m, i, 1)] > 0) AS hits FROM vec)
SELECT protein_id, CASE WHEN len(hits) > 0 THEN round(len(list_filter(hits, lambda i: cos(radians((i - 1) * 100.0) - towards) >= 0.5)) / len(hits), 9) ELSE 0 END AS face_occupancy FROM wet""",
)
def helical_face(spark, sf_dir):
    return proteins(spark, sf_dir).select("protein_id", r9(protein.moment_and_face(F.substring("seq", 4, 19))[1]).alias("face_occupancy"))


@query(
    "f8_q16_g37_glycine_regions",
    f"""WITH {PROTEINS}, g AS (SELECT protein_id, substr(seq, 4, 19) AS m FROM proteins), pos AS (SELECT protein_id, unnest(list_filter(range(1, 20), lambda i: substr(m, i, 1) = 'G')) AS i FROM g),
r AS (SELECT DISTINCT protein_id, CASE WHEN i <= 19 / 3.0 THEN 'front' WHEN i <= 2 * 19 / 3.0 THEN 'middle' ELSE 'back' END AS region FROM pos) SELECT region, count(*) AS n FROM r GROUP BY 1""",
)
def glycine_regions(spark, sf_dir):
    """Motifs with glycine, counted once in each of their regions."""
    m = proteins(spark, sf_dir).select(F.substring("seq", 4, 19).alias("m")).filter(F.contains("m", F.lit("G")))
    return m.select(F.explode(protein.thirds(F.col("m"))).alias("region")).groupBy("region").agg(F.count("*").alias("n"))


@query("q15_reference_deltas", f"""WITH {PROTEINS}, s AS (SELECT protein_id, {_scale(HYDROPATHY)} / length(seq) AS g FROM proteins) SELECT protein_id, round(g - (-0.5), 9) + 0 AS delta, round(g / -0.5, 9) AS ratio, (g + 0.5 < -0.15 OR g / -0.5 > 1.5) AS review FROM s""")
def deltas(spark, sf_dir):
    """Differences from a reference value, and which rows need review."""
    g = protein.gravy(F.col("seq"))
    return proteins(spark, sf_dir).select("protein_id", r9(g + 0.5).alias("delta"), r9(g / -0.5).alias("ratio"), ((g + 0.5 < -0.15) | (g / -0.5 > 1.5)).alias("review"))


def _small_matrix() -> dict[str, float]:
    """A substitution matrix from a rule: 4 for identity, 1 within conservative groups, -1 else."""
    letters = "ACDEFGHIKLMNPQRSTVWY"
    return {a + b: 4.0 if a == b else 1.0 if b in CONSERVATIVE[a] else -1.0 for a in letters for b in letters}


_REF = "ACDEFGHIKL"


@query("q13_matrix_score", f"""WITH {PROTEINS} SELECT protein_id, {" + ".join(f"(CASE WHEN substr(seq, {k}, 1) = '{r}' THEN 4.0::DOUBLE WHEN contains('{''.join(a for a in CONSERVATIVE if r in CONSERVATIVE[a])}', substr(seq, {k}, 1)) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)" for k, r in enumerate(_REF, 1))} AS score FROM proteins""")
def matrix_score(spark, sf_dir):
    return proteins(spark, sf_dir).select("protein_id", protein.matrix_score(F.substring("seq", 1, 10), _REF, _small_matrix()).alias("score"))


_TAG = f"(-2 * {_scale(HYDROPATHY)} / length(seq) + 10 * abs({_charge(7.4, PKA_TAG)}) / length(seq) - 2 * {count_sql('C')})"


@query("q17_q18_o2_tag_fragments", f"""WITH {PROTEINS}, f AS (SELECT protein_id, first AS start, n AS len, substr(p.seq, CAST(first AS INTEGER), CAST(n AS INTEGER)) AS seq FROM proteins p, unnest(range(20, 46, 5)) AS l(n), unnest(range(1, 64 - n + 2)) AS s(first)),
scored AS (SELECT protein_id, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len, round({_TAG}, 9) AS score FROM f) SELECT * FROM scored ORDER BY score DESC, protein_id, start, len LIMIT 20""")  # fmt: skip
def tag_fragments(spark, sf_dir):
    """All fragments of several lengths, scored; the best twenty."""
    found = expansion.scored_fragments(proteins(spark, sf_dir).select("protein_id", "seq"), "seq", range(20, 46, 5), best=20)
    scored = found.select("protein_id", "start", "len", r9("score").alias("score"))
    return scored.orderBy(F.desc("score"), "protein_id", "start", "len").limit(20)


_GROUPS = "map {" + ", ".join(f"'{r}': '{g}'" for r, g in CONSERVATIVE.items()) + "}"


@query("x3_single_position_scan", f"""WITH {PROTEINS}, p AS (SELECT protein_id, seq, unnest([3, 4, 5, 9]) AS pos FROM proteins), s AS (SELECT *, substr(seq, pos, 1) AS was FROM p), e AS (SELECT *, unnest(string_split({_GROUPS}[was], '')) AS aa FROM s)
SELECT protein_id, pos, was, aa, substr(seq, 1, pos - 1) || aa || substr(seq, pos + 1) AS mutant FROM e""")  # fmt: skip
def scan(spark, sf_dir):
    """Every conservative change at the positions of `3-5, 4, 9`, a position once."""
    rows = proteins(spark, sf_dir).select("protein_id", "seq", F.lit("3-5, 4, 9").alias("regions"))
    return expansion.single_position_scan(rows, "seq", "regions").select("protein_id", "pos", "was", "aa", "mutant")


@query("q19_q20_f20_parsers", """WITH c AS (SELECT event_id, [ '3-5, 6', '5-3', '', 'x', '0-2', '4' ][event_id % 6 + 1] AS region, ['2', '', '1.5', '3.0', '-1', 'abc'][event_id % 6 + 1] AS copies FROM events)
SELECT event_id, CASE region WHEN '5-3' THEN '5-3' WHEN 'x' THEN 'x' WHEN '0-2' THEN '0-2' ELSE '' END AS bad_region, CASE region WHEN '3-5, 6' THEN 4 WHEN '4' THEN 1 WHEN '' THEN 0 ELSE -1 END AS n_positions,
CASE copies WHEN '2' THEN 2 WHEN '' THEN 1 WHEN '3.0' THEN 3 ELSE -1 END AS copies FROM c""")  # fmt: skip
def parsers(spark, sf_dir):
    from helixframe.plans.core import table

    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % 6).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick("3-5, 6", "5-3", "", "x", "0-2", "4").alias("region"), pick("2", "", "1.5", "3.0", "-1", "abc").alias("copies"))
    bad = protein.region_error(F.col("region"))
    return rows.select("event_id", bad.alias("bad_region"), F.when(bad == "", F.size(protein.region_positions(F.when(bad == "", F.col("region"))))).otherwise(-1).alias("n_positions"), F.coalesce(protein.copy_count(F.col("copies")), F.lit(-1)).alias("copies"))


