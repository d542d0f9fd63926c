"""Queries on profiles of aligned sequences and on variant populations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import order, profiles, relational, sketches, statistics
from helixframe.operators.graph import written
from helixframe.plans.core import ALIGNMENT, CELLS, COUNTS, PROTEINS, SUBSTITUTED, alignment, proteins, query, r9, substituted, table, variant_counts
from helixframe.plans.sequences import codons_sql

BY = ["sample"]


def profile(spark, sf_dir):
    return profiles.proportions(profiles.cells(alignment(spark, sf_dir), "seq", BY, "seq_id"), BY)


# --- lengths -------------------------------------------------------------

_CUT = f"{PROTEINS}, cut AS (SELECT protein_id, value, substr(seq, 1, CAST(20 + protein_id % 30 AS INTEGER)) AS seq FROM proteins)"


def cut(spark, sf_dir):
    return proteins(spark, sf_dir).select("protein_id", "value", F.substr("seq", F.lit(1), (20 + F.col("protein_id") % 30).cast("int")).alias("seq"))


@query("g1_length_histogram", f"WITH {_CUT}, r AS (SELECT CASE WHEN protein_id % 11 = 0 THEN 'n/a' WHEN protein_id % 2 = 0 THEN length(seq) || '.0' ELSE CAST(length(seq) AS VARCHAR) END AS raw FROM cut) SELECT coalesce(CAST(TRY_CAST(raw AS DOUBLE) AS INTEGER), -1) AS length, count(*) AS n FROM r GROUP BY 1")
def length_histogram(spark, sf_dir):
    """Lengths read from text; what can't be read counts under -1."""
    raw = F.when(F.col("protein_id") % 11 == 0, "n/a").when(F.col("protein_id") % 2 == 0, F.concat(F.length("seq"), F.lit(".0"))).otherwise(F.length("seq").cast("string"))
    return cut(spark, sf_dir).groupBy(F.coalesce(raw.try_cast("double").cast("int"), F.lit(-1)).alias("length")).agg(F.count("*").alias("n"))


@query("g2_threshold_summary", f"WITH {_CUT}, t AS (SELECT unnest([25, 30, 40, 60]) AS threshold) SELECT threshold, count(*) FILTER (length(seq) <= threshold) AS n, round(count(*) FILTER (length(seq) <= threshold) / count(*), 9) AS fraction FROM cut, t GROUP BY 1")
def thresholds(spark, sf_dir):
    ts = (25, 30, 40, 60)
    one = cut(spark, sf_dir).agg(F.count("*").alias("total"), *(F.count_if(F.length("seq") <= t).alias(f"n{t}") for t in ts))
    return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("n"), r9(F.col(f"n{t}") / F.col("total")).alias("fraction")) for t in ts))))


@query("g3_j1_length_summary", f"WITH {_CUT} SELECT length(seq) AS length, count(*) AS n, min(value) AS value_min, max(value) AS value_max, round(avg(value), 9) AS value_mean FROM cut GROUP BY 1")
def length_summary(spark, sf_dir):
    rows = cut(spark, sf_dir).withColumn("length", F.length("seq"))
    return relational.with_group_stats(rows, "length", ["value"]).withColumn("value_mean", r9("value_mean"))


@query("p1_f9_k12_o1_length_cap", f"WITH {_CUT} SELECT length(seq) AS len, protein_id, seq FROM cut WHERE length(seq) <= 30 ORDER BY len, protein_id")
def length_cap(spark, sf_dir):
    rows = cut(spark, sf_dir).withColumn("len", F.length("seq")).filter("len <= 30")
    return rows.select("len", "protein_id", "seq").orderBy("len", "protein_id")


# --- profiles ------------------------------------------------------------


@query("g4_position_counts", f"WITH {CELLS} SELECT sample, pos, aa, n, CAST(total AS BIGINT) AS total, round(proportion, 9) AS proportion, CAST(rank AS INTEGER) AS rank FROM profile")
def position_counts(spark, sf_dir):
    return profile(spark, sf_dir).select("sample", "pos", "aa", "n", "total", r9("proportion").alias("proportion"), "rank")


@query("g5_frequency_table", f"""WITH {CELLS}, t AS (SELECT sample, pos, aa, 100 * n / sum(n) OVER (PARTITION BY sample, pos) AS pct, row_number() OVER (PARTITION BY sample, pos ORDER BY n DESC, first_seen, aa) AS rank FROM cells WHERE aa <> '-')
SELECT sample, pos, max(CASE WHEN rank = 1 THEN aa END) AS top_aa, round(max(CASE WHEN rank = 1 THEN pct END), 9) AS top_pct, max(CASE WHEN rank = 2 THEN aa END) AS second_aa, round(max(CASE WHEN rank = 2 THEN pct END), 9) AS second_pct FROM t GROUP BY 1, 2""")  # fmt: skip
def frequency_table(spark, sf_dir):
    """Percentages of all but the gap, with the first and second residue."""
    p = profiles.proportions(profiles.cells(alignment(spark, sf_dir), "seq", BY, "seq_id"), BY, ignored="-")
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    return p.groupBy("sample", "pos").agg(pick(1, "aa").alias("top_aa"), F.round(100 * pick(1, "proportion"), 9).alias("top_pct"), pick(2, "aa").alias("second_aa"), F.round(100 * pick(2, "proportion"), 9).alias("second_pct"))


@query("g6_w2_cumulative_share", f"WITH {CELLS} SELECT sample, pos, aa, CAST(rank AS INTEGER) AS rank, round(100 * sum(n) OVER (PARTITION BY sample, pos ORDER BY rank) / total, 9) AS cumulative_pct FROM profile")
def cumulative_share(spark, sf_dir):
    got = relational.cumulative(profile(spark, sf_dir), ["sample", "pos"], "n", ["rank"], "running")
    return got.select("sample", "pos", "aa", "rank", r9(100 * F.col("running") / F.col("total")).alias("cumulative_pct"))


@query("g7_covering_set", f"""WITH {CELLS}, c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sample, pos ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM profile)
SELECT sample, pos, string_agg(aa, '' ORDER BY rank) AS residues FROM c WHERE 10 * before < 9 * total GROUP BY 1, 2""")  # fmt: skip
def covering(spark, sf_dir):
    kept = profiles.covering(profile(spark, sf_dir), 0.9, BY)
    parts = F.array_sort(F.collect_list(F.struct("rank", "aa")))
    return kept.groupBy("sample", "pos").agg(F.array_join(F.transform(parts, lambda x: x["aa"]), "").alias("residues"))


_EXTRAS = f"""{CELLS}, tops AS (SELECT *, max(proportion) OVER (PARTITION BY sample, pos) AS top, sum(CASE WHEN rank >= 2 THEN proportion ELSE 0 END) OVER (PARTITION BY sample, pos ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM profile),
kept AS (SELECT sample, pos, aa, rank FROM tops WHERE rank = 1 OR running <= (1 - top) * 0.5 + 1e-9),
consensus AS (SELECT sample, string_agg(aa, '' ORDER BY pos) AS consensus FROM profile WHERE rank = 1 GROUP BY 1)"""


@query("w3_o8_top_and_extras", f"WITH {_EXTRAS} SELECT sample, pos, aa, CAST(rank AS INTEGER) AS rank FROM kept")
def top_and_extras(spark, sf_dir):
    return profiles.top_and_extras(profile(spark, sf_dir), 0.5, BY).select("sample", "pos", "aa", "rank")


@query("x16_f18_consensus_variants", f"WITH {_EXTRAS} SELECT k.sample, k.pos, substr(consensus, k.pos, 1) AS was, k.aa, substr(consensus, 1, k.pos - 1) || k.aa || substr(consensus, k.pos + 1) AS variant FROM kept k JOIN consensus c ON k.sample = c.sample WHERE substr(consensus, k.pos, 1) <> k.aa AND k.pos IN (1, 2, 3, 8, 9, 10)")
def variants(spark, sf_dir):
    """Variants at the positions of 1-3 and 8-10."""
    p = profile(spark, sf_dir)
    return profiles.variant_rows(profiles.top_and_extras(p, 0.5, BY), profiles.consensus(p, BY), BY, F.col("pos").isin(1, 2, 3, 8, 9, 10))


_ENTROPY = f"{CELLS}, e AS (SELECT sample, pos, -sum(proportion * log2(proportion)) AS entropy, 100 - 100 * max(proportion) AS noise FROM profile GROUP BY 1, 2)"


@query("g26_g27_entropy_and_noise", f"WITH {_ENTROPY} SELECT sample, pos, round(entropy, 9) AS entropy, round(noise, 9) AS noise FROM e")
def entropy(spark, sf_dir):
    return profiles.entropy(profile(spark, sf_dir), BY).select("sample", "pos", r9("entropy").alias("entropy"), r9("noise").alias("noise"))


def _noise(spark, sf_dir):
    return profiles.entropy(profiles.proportions(profiles.cells(alignment(spark, sf_dir), "seq", (), "seq_id"))).select("pos", "noise")


_NOISE = f"""{ALIGNMENT}, cells AS (SELECT CAST(pos AS INTEGER) AS pos, aa, count(*) AS n FROM (SELECT unnest(range(1, 13)) AS pos, unnest(string_split(seq, '')) AS aa FROM alignment) GROUP BY 1, 2),
profile AS (SELECT *, n / sum(n) OVER (PARTITION BY pos) AS proportion FROM cells WHERE aa NOT IN ('-', '.', 'X', 'x')), noise AS (SELECT pos, 100 - 100 * max(proportion) AS noise FROM profile GROUP BY 1),
med AS (SELECT median(noise) AS m FROM noise), mad AS (SELECT 1.4826 * median(abs(noise - m)) AS s FROM noise, med), z AS (SELECT pos, (noise - m) / (CASE WHEN s = 0 THEN 1e-9 ELSE s END) AS z FROM noise, med, mad)"""


@query("g28_mad_scores", f"WITH {_NOISE} SELECT pos, round(z, 9) AS z FROM z")
def mad(spark, sf_dir):
    return profiles.mad_scores(_noise(spark, sf_dir), "noise").select("pos", r9("z").alias("z"))


@query("g29_plain_scores", f"WITH {_NOISE}, s AS (SELECT avg(noise) AS m, stddev_samp(noise) AS s FROM noise) SELECT pos, round((noise - m) / s, 9) AS z FROM noise, s")
def plain(spark, sf_dir):
    return profiles.plain_scores(_noise(spark, sf_dir), "noise").select("pos", r9("z").alias("z"))


_ISLANDS = """flagged AS (SELECT k, i, pos, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS island FROM (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) > 2 THEN 1 ELSE 0 END AS fresh FROM (SELECT k, pos, z, row_number() OVER (PARTITION BY k ORDER BY pos) AS i FROM z, (SELECT unnest([-0.5, 0.0, 0.5, 1.5]::DOUBLE[]) AS k)) WHERE z > k)),
regions AS (SELECT k, island, min(pos) AS first_pos, max(pos) AS last_pos, CAST(max(i) - min(i) + 1 AS INTEGER) AS width FROM flagged GROUP BY 1, 2)"""


@query("w4_hotspot_regions", f"WITH {_NOISE}, {_ISLANDS} SELECT first_pos, last_pos, width, CASE WHEN width = 1 THEN 'spike' WHEN width >= 4 THEN 'block' ELSE 'short run' END AS shape FROM regions WHERE k = 0.0")
def hotspots(spark, sf_dir):
    return profiles.hotspots(profiles.mad_scores(_noise(spark, sf_dir), "noise"), 0.0, 1)


@query("x28_threshold_sweep", f"WITH {_NOISE}, {_ISLANDS} SELECT k, count(island) AS regions FROM (SELECT unnest([-0.5, 0.0, 0.5, 1.5]::DOUBLE[]) AS k) LEFT JOIN regions USING (k) GROUP BY 1")
def sweep(spark, sf_dir):
    return profiles.sweep(profiles.mad_scores(_noise(spark, sf_dir), "noise"), (-0.5, 0.0, 0.5, 1.5), 1)


# --- populations ---------------------------------------------------------


@query("g8_w1_haplotypes", f"WITH {SUBSTITUTED}, h AS (SELECT sample, seq AS hap, count(*) AS n, min(read_id) AS first_seen FROM substituted GROUP BY 1, 2) SELECT sample, hap, n, CAST(row_number() OVER (PARTITION BY sample ORDER BY n DESC, first_seen) AS INTEGER) AS rank FROM h")
def haplotypes(spark, sf_dir):
    counts = substituted(spark, sf_dir).groupBy("sample", F.col("seq").alias("hap")).agg(F.count("*").alias("n"), F.min("read_id").alias("first_seen"))
    return relational.ranked(counts, "n", "first_seen", by=BY).drop("first_seen")


@query("g9_protein_collapse", f"""WITH {SUBSTITUTED}, h AS (SELECT {codons_sql('seq', 63)} AS protein, seq AS hap, count(*) AS n FROM substituted GROUP BY 1, 2)
SELECT protein, CAST(sum(n) AS BIGINT) AS reads, count(*) AS n_haplotypes, string_agg(hap, ';' ORDER BY n DESC, hap) AS haplotypes FROM h GROUP BY 1""")  # fmt: skip
def collapse(spark, sf_dir):
    """Haplotypes of one protein, commonest first."""
    h = substituted(spark, sf_dir).groupBy(dna.translate(F.col("seq")).alias("protein"), F.col("seq").alias("hap")).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "hap")))
    return h.groupBy("protein").agg(F.sum("n").alias("reads"), F.count("*").alias("n_haplotypes"), F.array_join(F.transform(parts, lambda x: x["hap"]), ";").alias("haplotypes"))


_PAIR = f"{COUNTS}, a AS (SELECT variant, n FROM counts WHERE sample = 'click'), b AS (SELECT variant, n FROM counts WHERE sample = 'view'), joint AS (SELECT coalesce(a.variant, b.variant) AS variant, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM a FULL OUTER JOIN b ON a.variant = b.variant)"


def pair(spark, sf_dir):
    c = variant_counts(spark, sf_dir)
    return relational.outer_aligned(c.filter("sample = 'click'"), c.filter("sample = 'view'"), "variant")


@query("j3_u5_outer_alignment", f"WITH {_PAIR} SELECT * FROM joint WHERE n_a + n_b > 0")
def outer(spark, sf_dir):
    return pair(spark, sf_dir)


@query("j4_sample_alignment", f"WITH {COUNTS} SELECT variant, CAST(coalesce(sum(n) FILTER (sample = 'click'), 0) AS BIGINT) AS click, CAST(coalesce(sum(n) FILTER (sample = 'view'), 0) AS BIGINT) AS view, CAST(coalesce(sum(n) FILTER (sample = 'signup'), 0) AS BIGINT) AS signup FROM counts GROUP BY 1 HAVING count(*) FILTER (sample IN ('click', 'view', 'signup')) > 0")
def aligned(spark, sf_dir):
    return relational.aligned_counts(variant_counts(spark, sf_dir), "variant", "sample", F.col("n"), ["click", "view", "signup"])


@query("f19_minimum_count", f"WITH {COUNTS}, t AS (SELECT variant, CAST(sum(n) AS BIGINT) AS total FROM counts GROUP BY 1) SELECT total >= 5 AS kept, count(*) AS variants, CAST(sum(total) AS BIGINT) AS n FROM t GROUP BY 1")
def minimum(spark, sf_dir):
    t = variant_counts(spark, sf_dir).groupBy("variant").agg(F.sum("n").alias("total"))
    return t.groupBy((F.col("total") >= 5).alias("kept")).agg(F.count("*").alias("variants"), F.sum("total").alias("n"))


_TRAITS = f"{PROTEINS}, traits AS (SELECT sample, user_id, round(value) AS x, count(*) AS w FROM proteins GROUP BY 1, 2, 3)"


def traits(spark, sf_dir):
    return proteins(spark, sf_dir).groupBy("sample", "user_id", F.round("value").alias("x")).agg(F.count("*").alias("w"))


@query("g16_g17_f21_weighted_summary", f"""WITH {_TRAITS}, s AS (SELECT sample, sum(w) AS n, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) AS m2 FROM traits GROUP BY 1), e AS (SELECT sample, median(x) AS med FROM (SELECT sample, x, unnest(range(w)) FROM traits) GROUP BY 1)
SELECT s.sample, CAST(n AS BIGINT) AS n, round(m, 9) AS weighted_mean, round(sqrt(m2 - m * m), 6) AS weighted_sd, med AS weighted_median FROM s JOIN e USING (sample)""")  # fmt: skip
def weighted(spark, sf_dir):
    got = statistics.weighted(traits(spark, sf_dir), BY, "x", "w")
    return got.select("sample", "n", r9("weighted_mean").alias("weighted_mean"), F.round("weighted_sd", 6).alias("weighted_sd"), "weighted_median")


@query("g18_trait_summary", """WITH m AS (SELECT l_returnflag AS cluster, feature, value FROM (SELECT l_returnflag, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR feature IN (quantity, discount, tax)))
SELECT cluster, feature, count(*) AS n, round(sum(value), 3) AS total, round(avg(value), 9) AS mean, median(value) AS median, round(stddev_pop(value), 6) AS sd, min(value) AS low, max(value) AS high FROM m GROUP BY 1, 2""")  # fmt: skip
def trait_summary(spark, sf_dir):
    """Every feature of every cluster, melted first."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cluster"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    m = statistics.melted(rows, ["cluster"], ["quantity", "discount", "tax"])
    sums = m.groupBy("cluster", "feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), r9(F.avg("value")).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    medians = order.percentiles(m, ["cluster", "feature"], "value", [0.5]).withColumnRenamed("p0", "median")
    return order.with_percentiles(sums, medians, ["cluster", "feature"])


@query("j4_sketch_overlaps", """WITH v AS (SELECT DISTINCT event_type AS s, user_id AS v FROM events), n AS (SELECT s, count(*) AS n FROM v GROUP BY 1), b AS (SELECT x.s AS a, y.s AS b, count(*) AS shared FROM v x JOIN v y ON x.v = y.v AND x.s < y.s GROUP BY 1, 2)
SELECT p.s AS a, q.s AS b, p.n AS in_a, q.n AS in_b, coalesce(shared, 0) AS shared, p.n + q.n - coalesce(shared, 0) AS either, round(coalesce(shared, 0) / (p.n + q.n - coalesce(shared, 0)), 9) AS jaccard FROM n p JOIN n q ON p.s < q.s LEFT JOIN b ON b.a = p.s AND b.b = q.s""")  # fmt: skip
def sketch_overlaps(spark, sf_dir):
    """Variants that samples share, from stored sketches of each sample's days; exact, as each slice of the variants has sketches that hold them all."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), F.to_date("ts").alias("day"), "user_id")
    events = sketches.sliced(events, "user_id", sketches.slices(events, "user_id", 16))
    days = written(sketches.sketched(events, ["sample", "day", "slice"], "user_id", 16), "sketches")
    return sketches.overlaps(sketches.merged(days, ["sample", "slice"], 16), "sample", 16, "slice").withColumn("jaccard", r9("jaccard"))


@query("g19_w10_abundance_change", f"""WITH {COUNTS}, c AS (SELECT sample, variant % 4 AS cluster, count(*) AS unique_variants, sum(n) AS reads FROM counts GROUP BY 1, 2), f AS (SELECT *, reads / sum(reads) OVER (PARTITION BY sample) AS fraction FROM c)
SELECT sample, cluster, unique_variants, CAST(reads AS BIGINT) AS reads, round(fraction, 9) AS fraction, round(coalesce(100 * (fraction - lag(fraction) OVER (PARTITION BY cluster ORDER BY sample)), 0), 9) AS change_points FROM f""")  # fmt: skip
def abundance(spark, sf_dir):
    """Shares of clusters, and their change in percentage points from sample to sample."""
    c = variant_counts(spark, sf_dir).groupBy("sample", (F.col("variant") % 4).alias("cluster")).agg(F.count("*").alias("unique_variants"), F.sum("n").alias("reads"))
    f = c.withColumn("fraction", F.col("reads") / F.sum("reads").over(Window.partitionBy("sample")))
    change = F.coalesce(100 * (F.col("fraction") - F.lag("fraction").over(Window.partitionBy("cluster").orderBy("sample"))), F.lit(0.0))
    return f.withColumn("change_points", r9(change)).withColumn("fraction", r9("fraction"))


@query("g20_contingency", f"WITH {COUNTS} SELECT variant % 4 AS cluster, a.sample AS sample_a, b.sample AS sample_b, CAST(sum(a.n) AS BIGINT) AS in_a, CAST(sum(b.n) AS BIGINT) AS in_b FROM (SELECT sample, variant, n FROM counts) a JOIN counts b USING (variant) WHERE a.sample < b.sample GROUP BY 1, 2, 3")
def contingency(spark, sf_dir):
    """Reads of each cluster in each pair of samples, over variants that both hold."""
    c = variant_counts(spark, sf_dir)
    a, b = c.select(F.col("sample").alias("sample_a"), "variant", F.col("n").alias("na")), c.select(F.col("sample").alias("sample_b"), "variant", F.col("n").alias("nb"))
    return a.join(b, "variant").filter("sample_a < sample_b").groupBy((F.col("variant") % 4).alias("cluster"), "sample_a", "sample_b").agg(F.sum("na").alias("in_a"), F.sum("nb").alias("in_b"))


@query("g21_correlations", "SELECT a, b, round(r, 6) AS r FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)")
def correlations(spark, sf_dir):
    return statistics.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 6))


@query("g22_chi_square", f"""WITH {_PAIR}, t AS (SELECT sum(n_a) AS na, sum(n_b) AS nb, sum(n_a) + sum(n_b) AS n FROM joint), e AS (SELECT n_a, n_b, (n_a + n_b) * na / n AS ea, (n_a + n_b) * nb / n AS eb, n FROM joint, t)
SELECT round(sum((n_a - ea) ** 2 / ea + (n_b - eb) ** 2 / eb), 6) AS chi2, count(*) - 1 AS dof, round(sqrt(sum((n_a - ea) ** 2 / ea + (n_b - eb) ** 2 / eb) / max(n)), 9) AS cramers_v, CAST(sum((ea < 5)::INT + (eb < 5)::INT) AS BIGINT) AS cells_below_5 FROM e""")  # fmt: skip
def chi_square(spark, sf_dir):
    got = statistics.chi_square(pair(spark, sf_dir), "n_a", "n_b")
    return got.select(F.round("chi2", 6).alias("chi2"), "dof", r9("cramers_v").alias("cramers_v"), "cells_below_5")


@query("g23_monte_carlo_p")
def monte_carlo(spark, sf_dir):
    """Order priorities of two statuses: the table has one row for each priority, so that it is small."""
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "O").alias("a"), F.count_if(F.col("o_orderstatus") == "F").alias("b")).orderBy("o_orderpriority").limit(100).collect()
    return statistics.chi_square_monte_carlo(spark, [r["a"] for r in rows], [r["b"] for r in rows], 20_000)


_MW = f"""{_TRAITS}, c AS (SELECT x, sum(CASE WHEN sample = 'click' THEN w ELSE 0 END) AS wa, sum(CASE WHEN sample = 'view' THEN w ELSE 0 END) AS wb FROM traits WHERE sample IN ('click', 'view') GROUP BY 1),
r AS (SELECT *, coalesce(sum(wb) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
u AS (SELECT sum(wa * (below + 0.5 * wb))::DOUBLE AS u, sum(wa)::DOUBLE AS na, sum(wb)::DOUBLE AS nb, sum((wa + wb) ** 3 - (wa + wb))::DOUBLE AS ties FROM r)"""


@query("g24_j11_mann_whitney", f"WITH {_MW} SELECT u, na, nb, round(greatest(0, abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 9) AS z FROM u")
def mann_whitney(spark, sf_dir):
    return statistics.mann_whitney(traits(spark, sf_dir), "x", "w", "sample", "click", "view").withColumn("z", r9("z"))


@query("g24_p_values", f"""WITH {_MW}, z AS (SELECT u, greatest(0, abs(u - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) / sqrt(2) AS x FROM u)
SELECT u, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda n: pow(-1, n) * pow(x, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))), 9) AS p FROM z""")  # fmt: skip
def p_values(spark, sf_dir):
    """The two-sided p of the test; its SQL sums up the series of the error function."""
    got = statistics.mann_whitney(traits(spark, sf_dir), "x", "w", "sample", "click", "view")
    return got.select("u", r9(statistics.normal_tail("z")).alias("p"))


@query("g25_w12_holm", f"""WITH {COUNTS}, p AS (SELECT variant, 1.0 / (1 + sum(n)) AS p FROM counts GROUP BY 1), s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, variant) + 1) * p AS scaled FROM p)
SELECT variant, round(p, 9) AS p, round(least(1.0, max(scaled) OVER (ORDER BY p, variant ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM s""")  # fmt: skip
def holm(spark, sf_dir):
    p = variant_counts(spark, sf_dir).groupBy("variant").agg((1 / (1 + F.sum("n"))).alias("p"))
    return statistics.holm(p, "p", tie="variant").select("variant", r9("p").alias("p"), r9("adjusted").alias("adjusted"))


@query("g41_block_means", """WITH b AS (SELECT user_id, ntile(5) OVER (PARTITION BY user_id ORDER BY event_id) AS block, value FROM events), m AS (SELECT user_id, block, avg(value) AS m FROM b GROUP BY 1, 2)
SELECT user_id, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem FROM m GROUP BY 1""")  # fmt: skip
def block_means(spark, sf_dir):
    got = statistics.block_means(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")
    return got.select("user_id", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query("w5_rolling_mean", """SELECT event_id, CASE WHEN count(value) OVER w = 20 THEN round(avg(value) OVER w, 6) ELSE -1 END AS rolling_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)""")
def rolling(spark, sf_dir):
    got = relational.centred_mean(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 20)
    return got.select("event_id", F.coalesce(F.round("rolling_mean", 6), F.lit(-1.0)).alias("rolling_mean"))


@query("g39_blank_correction", "WITH m AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, avg(value) AS od FROM events GROUP BY 1, 2) SELECT event_type, day, round((od - 0.05) * 4.1, 6) AS corrected FROM m")
def blank_correction(spark, sf_dir):
    """Replicate means, less the blank, times the path factor."""
    day = F.floor(F.unix_timestamp("ts") / 86400)
    return table(spark, sf_dir, "events").groupBy("event_type", day.alias("day")).agg(F.round((F.avg("value") - 0.05) * 4.1, 6).alias("corrected"))


@query("g40_survival", """WITH c AS (SELECT event_type AS strain, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS cycle, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strain, cycle, round(n / first_value(n) OVER (PARTITION BY strain ORDER BY cycle), 9) AS survival, round(log10(n / first_value(n) OVER (PARTITION BY strain ORDER BY cycle)), 9) AS log_survival FROM c""")  # fmt: skip
def survival(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strain"), F.floor(F.unix_timestamp("ts") / 86400).alias("cycle")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.first("n").over(Window.partitionBy("strain").orderBy("cycle"))
    return c.select("strain", "cycle", r9(share).alias("survival"), r9(F.log10(share)).alias("log_survival"))


@query("g38_count_statistics", f"WITH {COUNTS} SELECT sample, round(avg(n), 9) AS mean, median(n)::DOUBLE AS median, min(n) AS low, max(n) AS high FROM counts GROUP BY 1")
def count_statistics(spark, sf_dir):
    counts = variant_counts(spark, sf_dir)
    sums = counts.groupBy("sample").agg(r9(F.avg("n")).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"))
    return order.with_percentiles(sums, order.percentiles(counts, ["sample"], "n", [0.5]).withColumnRenamed("p0", "median"), ["sample"])


@query("g45_pivot_predictions", f"WITH {COUNTS} SELECT variant, round(coalesce(avg(n) FILTER (sample = 'click'), 0), 9) AS click, round(coalesce(avg(n) FILTER (sample = 'view'), 0), 9) AS view FROM counts GROUP BY 1")
def pivot(spark, sf_dir):
    wide = variant_counts(spark, sf_dir).groupBy("variant").pivot("sample", ["click", "view"]).avg("n").na.fill(0.0, ["click", "view"])
    return wide.select("variant", r9("click").alias("click"), r9("view").alias("view"))


@query("g46_conflicting_traits", "SELECT user_id, min(event_type) AS first_type, count(DISTINCT event_type) AS types, max(value) - min(value) > 1e-8 + 1e-8 * abs(min(value)) AS conflict FROM events GROUP BY 1")
def conflicts(spark, sf_dir):
    """One trait row a key, and whether its values disagree."""
    spread = F.max("value") - F.min("value") > 1e-8 + 1e-8 * F.abs(F.min("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_type").alias("first_type"), F.count_distinct("event_type").alias("types"), spread.alias("conflict"))
