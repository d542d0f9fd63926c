"""SQL functions of the library for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions made of Spark's own expressions; their names."""
    codon = "coalesce(nullif(substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 16 * (instr('TCAG', substr(s, i, 1)) - 1) + 4 * (instr('TCAG', substr(s, i + 1, 1)) - 1) + instr('TCAG', substr(s, i + 2, 1)), 1), ''), 'X')"
    known = "instr('TCAG', substr(s, i, 1)) > 0 AND instr('TCAG', substr(s, i + 1, 1)) > 0 AND instr('TCAG', substr(s, i + 2, 1)) > 0"
    count = lambda letters: f"(length(s) - length(translate(s, '{letters}', '')))"
    made = {
        "revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGT', 'TGCA'))",
        "translate_dna(s STRING) RETURNS STRING": f"CASE WHEN length(s) < 3 THEN '' ELSE array_join(transform(sequence(1, length(s) - 2, 3), i -> CASE WHEN {known} THEN {codon} ELSE 'X' END), '') END",
        "hamming(s STRING, t STRING) RETURNS INT": "CASE WHEN length(s) = length(t) THEN CASE WHEN length(s) = 0 THEN 0 ELSE size(filter(sequence(1, length(s)), i -> substr(s, i, 1) <> substr(t, i, 1))) END END",
        "gc_fraction(s STRING) RETURNS DOUBLE": f"CASE WHEN length(s) > 0 THEN {count('GC')} / length(s) ELSE 0.0 END",
        "phred_mean(s STRING) RETURNS DOUBLE": "CASE WHEN length(s) > 0 THEN aggregate(split(s, ''), 0, (a, c) -> a + ascii(c) - 33) / length(s) END",
        "fcr(s STRING) RETURNS DOUBLE": f"CASE WHEN length(s) > 0 THEN ({count('KRED')} + 0.1D * {count('H')}) / length(s) ELSE 0.0D END",
        "ncpr(s STRING) RETURNS DOUBLE": f"CASE WHEN length(s) > 0 THEN ({count('KR')} + 0.1D * {count('H')} - {count('ED')}) / length(s) ELSE 0.0D END",
    }
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in made]
