"""Queries on degenerate-codon design for the columns of an alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions.tables import IUPAC, RESIDUES
from helixframe.operators import codons, profiles
from helixframe.plans.core import CELLS, alignment, query, r9
from helixframe.plans.sequences import _CODON_MAP

BY = ["sample"]
_BASES = ", ".join(f"({i}, '{c}', '{b}')" for i, (c, bases) in enumerate(IUPAC.items()) for b in bases)
CODONS = f"""ib(i, code, b) AS (VALUES {_BASES}),
expanded AS (SELECT x.i * 225 + y.i * 15 + z.i AS ord, x.code || y.code || z.code AS codon, {_CODON_MAP}[x.b || y.b || z.b] AS aa FROM ib x, ib y, ib z),
codons AS (SELECT ord, codon, CAST(bit_or(CASE WHEN aa = '*' THEN 0 ELSE 1 << (instr('{RESIDUES}', aa) - 1) END) AS INTEGER) AS mask, CAST(count(DISTINCT aa) FILTER (aa <> '*') AS INTEGER) AS size,
  CAST(count(*) FILTER (aa = '*') AS INTEGER) AS stops, CAST(count(*) AS INTEGER) AS total FROM expanded GROUP BY 1, 2)"""
COLUMNS = f"""{CELLS}, observed AS (SELECT sample, pos, CAST(bit_or(1 << (instr('{RESIDUES}', aa) - 1)) AS INTEGER) AS observed, count(*) AS n_observed FROM profile GROUP BY 1, 2)"""
_HIT = "bit_count(observed & mask)"


def best_sql(objective: str, keep: str, by_size: bool = True) -> str:
    return f"""{COLUMNS}, {CODONS}, scored AS (SELECT o.*, c.*, {objective} AS objective FROM observed o, codons c WHERE size > 0 AND {keep}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY sample, pos ORDER BY objective, {'size, ' if by_size else ''}ord) = 1)"""


_DIRECT = f"2 - {_HIT} / n_observed - {_HIT} / size"
_WEIGHTED = f"1.0::DOUBLE * (1 - {_HIT} / n_observed) + 0.5::DOUBLE * (1 - {_HIT} / size)"
_STOPS = f"{_WEIGHTED} + 0.3::DOUBLE * -ln(1 - stops / total)"
_FULL = f"1000 * (n_observed - {_HIT}) + 10 * (size - {_HIT}) + 100 * (stops > 0)::INT + size + (stops > 0)::INT"


def columns(spark, sf_dir):
    p = profiles.proportions(profiles.cells(alignment(spark, sf_dir), "seq", BY, "seq_id"), BY)
    return codons.columns_of(p, BY)


def best(spark, sf_dir, objective=None, kind=codons.safe, by_size=True):
    return codons.best_codons(columns(spark, sf_dir), kind(codons.codon_table(spark)), codons.direct() if objective is None else objective, ["sample", "pos"], by_size)


@query("d10_d12_j12_codon_table", f"WITH {COLUMNS}, {CODONS} SELECT sample, pos, CASE WHEN stops = total THEN 'only stops' WHEN stops > 0 THEN 'some stops' ELSE 'safe' END AS kind, count(*) AS n, CAST(sum(size) AS BIGINT) AS sizes, CAST(sum({_HIT}) AS BIGINT) AS hits, count(*) FILTER ({_HIT} = n_observed) AS complete FROM observed, codons GROUP BY 1, 2, 3")
def codon_kinds(spark, sf_dir):
    """For each column and kind of codon: how many there are, how many residues they encode, how many of these are observed, and how many codons encode all observed ones."""
    t = codons.codon_table(spark)
    kind = F.when(F.col("stops") == F.col("total"), "only stops").when(F.col("stops") > 0, "some stops").otherwise("safe")
    hit = F.bit_count(F.col("observed").bitwiseAND(F.col("mask")))
    both = columns(spark, sf_dir).crossJoin(F.broadcast(t))  # a table of constant size
    return both.groupBy("sample", "pos", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.sum(hit).alias("hits"), F.count_if(hit == F.bit_count("observed")).alias("complete"))


@query("x17_j6_direct_codons", f"WITH {best_sql(_DIRECT, 'stops = 0')} SELECT sample, pos, codon, size, round(objective, 9) AS objective FROM best")
def direct(spark, sf_dir):
    return best(spark, sf_dir).select("sample", "pos", "codon", "size", r9("objective").alias("objective"))


@query("x17_weighted_codons", f"WITH {best_sql(_WEIGHTED, 'stops = 0')} SELECT sample, pos, codon, size, round(objective, 9) AS objective FROM best")
def weighted(spark, sf_dir):
    return best(spark, sf_dir, codons.weighted(1.0, 0.5)).select("sample", "pos", "codon", "size", r9("objective").alias("objective"))


@query("x17_stop_aware_codons", f"WITH {best_sql(_STOPS, 'stops < total')} SELECT sample, pos, codon, size, round(objective, 9) AS objective FROM best")
def stop_aware(spark, sf_dir):
    return best(spark, sf_dir, codons.stop_aware(1.0, 0.5, 0.3), codons.not_only_stops).select("sample", "pos", "codon", "size", r9("objective").alias("objective"))


@query("x18_full_coverage_codons", f"WITH {best_sql(_FULL, 'true', False)} SELECT sample, pos, codon, CAST(objective AS BIGINT) AS objective FROM best")
def full(spark, sf_dir):
    return best(spark, sf_dir, codons.full_coverage(), lambda t: t, False).select("sample", "pos", "codon", F.col("objective").cast("long").alias("objective"))


@query("x19_first_weighted_codons", f"WITH {best_sql(_WEIGHTED, 'stops < total', False)} SELECT sample, pos, codon, size FROM best")
def first_weighted(spark, sf_dir):
    return best(spark, sf_dir, codons.weighted(1.0, 0.5), codons.not_only_stops, False).select("sample", "pos", "codon", "size")


@query("x20_design_pass", f"WITH {best_sql(_DIRECT, 'stops = 0')} SELECT sample, string_agg(codon, '' ORDER BY pos) AS design, count(*) AS positions FROM best GROUP BY 1")
def design(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("pos", "codon")))
    return best(spark, sf_dir).groupBy("sample").agg(F.array_join(F.transform(parts, lambda x: x["codon"]), "").alias("design"), F.count("*").alias("positions"))


@query("g30_u7_position_metrics", f"WITH {best_sql(_DIRECT, 'stops = 0')} SELECT sample, pos, round({_HIT} / n_observed, 9) AS recall, round({_HIT} / size, 9) AS precision, CAST(bit_count(mask & ~observed) AS INTEGER) AS unwanted, CAST(bit_count(observed & ~mask) AS INTEGER) AS missing FROM best")
def position_metrics(spark, sf_dir):
    m = codons.metrics()
    over = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("observed")))
    under = F.bit_count(F.col("observed").bitwiseAND(F.bitwise_not("mask")))
    return best(spark, sf_dir).select("sample", "pos", r9(m["recall"]).alias("recall"), r9(m["precision"]).alias("precision"), over.alias("unwanted"), under.alias("missing"))


@query("g31_encoded_space", f"WITH {best_sql(_DIRECT, 'stops = 0')} SELECT sample, CAST(CAST(product(size) AS HUGEINT) AS VARCHAR) AS space, round(sum(log10(size)), 9) AS log10_space FROM best GROUP BY 1")
def space(spark, sf_dir):
    return codons.encoded_space(best(spark, sf_dir), BY).select("sample", "space", r9("log10_space").alias("log10_space"))


@query(
    "g32_design_coverage",
    f"""WITH {best_sql(_DIRECT, 'stops = 0')}, cell AS (SELECT seq_id, sample, unnest(range(1, 13)) AS pos, unnest(string_split(seq, '')) AS aa FROM alignment),
bad AS (SELECT DISTINCT c.seq_id, c.sample FROM cell c JOIN best b ON c.sample = b.sample AND c.pos = b.pos WHERE aa NOT IN ('-', '.', 'X', 'x') AND (mask & (1 << (instr('{RESIDUES}', aa) - 1))) = 0)
SELECT a.sample, count(*) AS n, round(count(*) FILTER (b.seq_id IS NULL) / count(*), 9) AS coverage FROM alignment a LEFT JOIN bad b USING (seq_id) GROUP BY 1""",
)
def coverage(spark, sf_dir):
    return codons.coverage(alignment(spark, sf_dir), "seq_id", "seq", best(spark, sf_dir), BY).select("sample", "n", r9("coverage").alias("coverage"))


_SUMMARY = f"""round(avg(1 - {_HIT} / n_observed), 9) AS mean_loss, round(avg(1 - {_HIT} / size), 9) AS mean_off_target, round(avg(objective), 9) AS mean_objective, round(exp(sum(ln(n_observed) - ln(size))), 9) AS compression,
round(sum(size - {_HIT}) / sum(size), 9) AS global_off_target, round(1 - exp(sum(ln(1 - stops / total))), 9) AS stop_risk"""


def _summary(b):
    got = codons.summary(b, BY)
    return got.select("sample", *(r9(c).alias(c) for c in got.columns if c != "sample"))


@query("g33_g34_design_summary", f"WITH {best_sql(_STOPS, 'stops < total')} SELECT sample, {_SUMMARY} FROM best GROUP BY 1")
def design_summary(spark, sf_dir):
    return _summary(best(spark, sf_dir, codons.stop_aware(1.0, 0.5, 0.3), codons.not_only_stops))


@query(
    "g35_safe_against_all",
    f"""WITH {COLUMNS}, {CODONS}, scored AS (SELECT sample, pos, ord, stops, {_HIT} / n_observed AS recall, {_HIT} / size AS precision, {_DIRECT} AS objective, size FROM observed, codons WHERE size > 0),
a AS (SELECT sample, pos, objective FROM scored QUALIFY row_number() OVER (PARTITION BY sample, pos ORDER BY objective, size, ord) = 1),
s AS (SELECT sample, pos, objective FROM scored WHERE stops = 0 QUALIFY row_number() OVER (PARTITION BY sample, pos ORDER BY objective, size, ord) = 1)
SELECT sample, round(avg(s.objective), 9) AS safe_objective, round(avg(a.objective), 9) AS all_objective, round(avg(s.objective) - avg(a.objective), 9) AS price FROM s JOIN a USING (sample, pos) GROUP BY 1""",
)
def safe_against_all(spark, sf_dir):
    """What it costs to allow no stops."""
    cols, table = columns(spark, sf_dir), codons.codon_table(spark)
    s = codons.best_codons(cols, codons.safe(table), codons.direct(), ["sample", "pos"]).select("sample", "pos", F.col("objective").alias("s"))
    a = codons.best_codons(cols, table, codons.direct(), ["sample", "pos"]).select("sample", "pos", F.col("objective").alias("a"))
    return s.join(a, ["sample", "pos"]).groupBy("sample").agg(r9(F.avg("s")).alias("safe_objective"), r9(F.avg("a")).alias("all_objective"), r9(F.avg("s") - F.avg("a")).alias("price"))


GRID = [(a / 2, b / 2) for a in range(0, 5) for b in range(0, 5)]
_W = f"w(w_loss, w_off) AS (SELECT * FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in GRID)}) AS t(a, b))"
_GRID = f"""{COLUMNS}, {CODONS}, {_W}, scored AS (SELECT sample, pos, w_loss, w_off, {_DIRECT} AS score, w_loss * (1 - {_HIT} / n_observed) + w_off * (1 - {_HIT} / size) AS objective, size, ord FROM observed, codons, w WHERE size > 0 AND stops = 0),
picked AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY sample, pos, w_loss, w_off ORDER BY objective, size, ord) = 1), grid_cells AS (SELECT w_loss, w_off, avg(score) AS mean_score FROM picked GROUP BY 1, 2)"""


GRID_SQL = f"WITH {_GRID} SELECT w_loss, w_off, round(mean_score, 9) AS mean_score FROM grid_cells"


@query("x21_o5_weight_grid", GRID_SQL)
def grid(spark, sf_dir):
    got = codons.grid(columns(spark, sf_dir), codons.safe(codons.codon_table(spark)), GRID)
    return got.select("w_loss", "w_off", r9("mean_score").alias("mean_score"))


@query("x22_response_surface")
def surface(spark, sf_dir):
    """The quadratic surface over the grid of weights, with its stationary point."""
    got = codons.surface(codons.grid(columns(spark, sf_dir), codons.safe(codons.codon_table(spark)), GRID), "w_loss", "w_off", "mean_score")
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} double" for k in got))
