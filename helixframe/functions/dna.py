"""DNA, quality and alignment strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions.tables import CODONS, IUPAC


def characters(c: Column) -> Column:
    """The characters of a string; none for an empty one."""
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def complement(c: Column) -> Column:
    return F.translate(c, "ACGT", "TGCA")


def reverse_complement(c: Column, unknown: str = "error") -> Column:
    """unknown bases: `error` raises, `N` puts N, `keep` leaves them."""
    if unknown == "N":
        c = F.regexp_replace(c, "[^ACGTN]", "N")
    out = F.reverse(complement(c))
    if unknown == "error":
        bad = F.raise_error(F.concat(F.lit("not a DNA sequence: "), c))
        return F.when(c.rlike("^[ACGTN]*$"), out).when(c.isNotNull(), bad)
    return out


def clean_dna(c: Column) -> Column:
    """Upper case, without white space, U as T."""
    return F.translate(F.upper(F.regexp_replace(c, r"\s", "")), "U", "T")


_CODON_TABLE = [x for kv in CODONS.items() for x in kv]


def codon_residue(codon: Column) -> Column:
    """The residue of a codon, or X."""
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, _CODON_TABLE)), codon), F.lit("X"))


def translate(c: Column, stop: str = "keep", trailing: str = "trim", unknown: str = "X", frame: int = 0) -> Column:
    """Protein of a DNA string.

    stop: `keep` leaves `*`, `cut` ends before the first one, `drop` makes NULL of a
    sequence that holds one. trailing bases: `trim` or `error`. unknown codons: `X` or `error`.
    """
    s = F.substr(c, F.lit(frame + 1)) if frame else c
    residues = F.transform(F.regexp_extract_all(s, F.lit("(?s)(...)"), F.lit(1)), codon_residue)  # cut once: a lambda would evaluate s for each codon
    out = F.when(s.isNotNull(), F.array_join(residues, ""))
    if trailing == "error":
        out = F.when(F.length(s) % 3 == 0, out).when(s.isNotNull(), F.raise_error(F.lit("the length is not a multiple of three")))
    if unknown == "error":
        out = F.when(~F.contains(out, F.lit("X")), out).when(out.isNotNull(), F.raise_error(F.concat(F.lit("an unknown codon in "), s)))
    if stop == "cut":
        return F.substring_index(out, "*", 1)
    return F.when(~F.contains(out, F.lit("*")), out) if stop == "drop" else out


def translation_warnings(c: Column, frame: int = 0, readthrough: bool = False) -> Column:
    """What a stopping translation leaves out: trailing bases, unknown codons, stops within, joined by `; `."""
    s = F.substr(c, F.lit(frame + 1))
    whole = translate(s)
    over = F.length(s) % 3
    inner = F.contains(F.substr(whole, F.lit(1), F.length(whole) - 1), F.lit("*"))
    return F.concat_ws(
        "; ",
        F.when(over > 0, F.concat(over, F.lit(" trailing bases ignored"))),
        F.when(F.contains(whole, F.lit("X")), F.concat(F.length(whole) - F.length(F.replace(whole, F.lit("X"), F.lit(""))), F.lit(" unknown codons"))),
        F.when(inner, F.lit("stops within" if readthrough else "stopped early")),
    )


def phred(qual: Column) -> Column:
    """Scores of a Phred+33 string."""
    return F.transform(characters(qual), lambda q: F.ascii(q) - 33)


def quality_sum(qual: Column) -> Column:
    return F.aggregate(phred(qual), F.lit(0), lambda a, x: a + x)


def longest_run(c: Column) -> Column:
    """Length of the longest run of one character; 0 for an empty string."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"((.)\2*)"), F.lit(1)), F.length)), F.lit(0))


def count_of(c: Column, letters: str) -> Column:
    """How many characters of c are one of letters."""
    if len(letters) == 1:
        return F.length(c) - F.length(F.replace(c, F.lit(letters), F.lit("")))  # a search of bytes
    return F.length(c) - F.length(F.translate(c, letters, ""))


def hamming(a: Column, b: Column, strict: bool = True) -> Column:
    """Differing positions; strict: NULL for unequal lengths, else over the shorter one."""
    n = F.least(F.length(a), F.length(b))
    differ = F.size(F.filter(F.arrays_zip(F.slice(characters(a), F.lit(1), n).alias("x"), F.slice(characters(b), F.lit(1), n).alias("y")), lambda p: p["x"] != p["y"]))
    return F.when(F.length(a) == F.length(b), differ) if strict else differ


def changes(a: Column, b: Column) -> Column:
    """Differences of two strings of equal length as `A12G`, joined by `;`."""
    pairs = F.arrays_zip(characters(a).alias("x"), characters(b).alias("y"))
    said = F.transform(pairs, lambda p, i: F.when(p["x"] != p["y"], F.concat(p["x"], i + 1, p["y"])))
    return F.array_join(F.array_compact(said), ";")


def design_pattern(design: str) -> str:
    """A regular expression of all sequences that a design of ambiguity codes allows."""
    return "^" + "".join(IUPAC[c] if len(IUPAC[c]) == 1 else f"[{IUPAC[c]}]" for c in design) + "$"


def conforms(c: Column, design: str) -> Column:
    return c.rlike(design_pattern(design))


def contains_site(c: Column, site: str, both_strands: bool = True) -> Column:
    """Whether a restriction site stands in c, on either strand if asked."""
    other = site[::-1].translate(str.maketrans("ACGT", "TGCA"))
    found = F.contains(c, F.lit(site))
    return found | F.contains(c, F.lit(other)) if both_strands and other != site else found


def resolve_for_mapping(design: str, original: str) -> str:
    """A concrete reference for a design: the original base where the design allows it, else the first allowed one."""
    return "".join(o if o in IUPAC[d] else min(IUPAC[d]) for d, o in zip(design, original, strict=True))


def mapping_reference(original: Column, design: str) -> Column:
    """resolve_for_mapping for a column of originals; an original that is too short gives the first allowed base."""
    base = lambda k: F.substring(original, k, 1)
    return F.concat(*(F.when(F.contains(F.lit(IUPAC[d]), base(k)) & (base(k) != ""), base(k)).otherwise(F.lit(min(IUPAC[d]))) for k, d in enumerate(design, 1)))


def design_space(design: str) -> int:
    """How many sequences a design stands for."""
    n = 1
    for c in design:
        n *= len(IUPAC[c])
    return n


def decode_index(index: Column, design: str) -> Column:
    """The sequence with a number below design_space(design): its bases are the digits, the last position the lowest."""
    out, unit = [], design_space(design)
    if unit > 2**53:
        raise ValueError("the design has more sequences than a double can number exactly")
    for c in design:
        allowed = IUPAC[c]
        unit //= len(allowed)
        digit = F.pmod((index - F.pmod(index, F.lit(unit))) / F.lit(unit), F.lit(len(allowed)))  # an exact quotient
        out.append(F.substring(F.lit(allowed), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def cigar_operations(cigar: Column) -> Column:
    """Array of (n, op) of a CIGAR string."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1)), lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))
