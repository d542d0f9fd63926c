"""Queries of the iterative, simulating and fuzzy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.functions.tables import IUPAC
from helixframe.operators import agglomeration, clusters, expansion, fuzzy, intervals, power, trajectory
from helixframe.plans.core import HEX, PROTEINS, READS, SAM, SUBSTITUTED, alignments, proteins, query, r9, reads, substituted, table
from helixframe.plans.sequences import _TAG

_HAPS = f"{SUBSTITUTED}, haps AS (SELECT sample, seq AS hap, count(*) AS n FROM substituted GROUP BY 1, 2)"
MAPPED = "NNKRYSWM" * 8
CENTRES = ("ACGT" * 16, "T" * 64, "GGGCCC" * 10 + "ACTG")


def haps(spark, sf_dir):
    return substituted(spark, sf_dir).groupBy("sample", F.col("seq").alias("hap")).agg(F.count("*").alias("n"))


@query("j7_nearest_centres", f"""WITH {_HAPS}, c(ord, centre) AS (VALUES {', '.join(f"({k}, '{c}')" for k, c in enumerate(CENTRES))}), d AS (SELECT sample, hap, ord, centre, hamming(hap, centre) AS distance FROM haps, c)
SELECT sample, hap, centre, CAST(distance AS INTEGER) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY sample, hap ORDER BY distance, ord) = 1""")  # fmt: skip
def nearest(spark, sf_dir):
    from helixframe.operators.relational import nearest as to_nearest

    return to_nearest(haps(spark, sf_dir), "hap", CENTRES, dna.hamming).select("sample", "hap", "centre", "distance")


@query("j8_hamming_totals", f"WITH {_HAPS} SELECT a.sample, a.hap, CAST(sum(hamming(a.hap, b.hap)) AS BIGINT) AS total FROM haps a JOIN haps b ON a.sample = b.sample GROUP BY 1, 2")
def totals(spark, sf_dir):
    """Sums of all pairwise distances, without pairs."""
    from helixframe.operators.relational import hamming_totals

    return hamming_totals(haps(spark, sf_dir), "hap", "sample").select("sample", "hap", "total")


@query("x26_within_two", f"WITH {_HAPS} SELECT a.sample, a.hap AS a, b.hap AS b FROM haps a JOIN haps b ON a.sample = b.sample AND a.hap < b.hap WHERE hamming(a.hap, b.hap) <= 2")
def within(spark, sf_dir):
    """Pairs of haplotypes up to two bases apart, by shared parts."""
    return clusters.within_distance(haps(spark, sf_dir), "hap", 2, ["sample"])


_FRAMED = f"framed AS (SELECT DISTINCT event_type AS sample, '{'ACGT' * 7}' || substr(s, 1, 5) || '{'GATTACA' * 3}' || substr(s, 6, 10) AS seq FROM (SELECT event_type, translate(md5(CAST(event_id AS VARCHAR)), '{HEX}', '{'AAAAAAAACCCCGGTT'}') AS s FROM events))"


@query("x26_constant_frame", f"WITH {_FRAMED} SELECT a.sample, a.seq AS a, b.seq AS b FROM framed a JOIN framed b ON a.sample = b.sample AND a.seq < b.seq WHERE hamming(a.seq, b.seq) <= 2")
def framed(spark, sf_dir):
    """Pairs up to two bases apart of a library that varies, unevenly, at 15 of 64 places."""
    bases = F.translate(F.md5(F.col("event_id").cast("string")), HEX, "AAAAAAAACCCCGGTT")
    seq = F.concat(F.lit("ACGT" * 7), F.substring(bases, 1, 5), F.lit("GATTACA" * 3), F.substring(bases, 6, 10))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), seq.alias("seq"))
    return clusters.within_distance(rows, "seq", 2, ["sample"])


@query("x26_directional_clusters")
def directional(spark, sf_dir):
    """Haplotypes with the cluster that absorbs them."""
    return clusters.directional(haps(spark, sf_dir), "hap", "n", ["sample"])


@query("x23_medoids")
def medoids(spark, sf_dir):
    return clusters.medoids(substituted(spark, sf_dir), "seq", 4)


@query("x25_ward_clusters")
def ward(spark, sf_dir):
    """Users by their events: count, mean and extreme value."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
    return agglomeration.ward(users, "user_id", ["n", "mean", "most"]).select("user_id", "cluster")


@query("x25_principal_components")
def components(spark, sf_dir):
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = clusters.standardised(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *features), features)
    axes, _ = clusters.principal_axes(rows, features)
    return clusters.projected(rows, features, axes).select("l_orderkey", "l_linenumber", *(F.round(f"pc{k}", 6).alias(f"pc{k}") for k in (1, 2, 3)))


_SPAN = "least(k.e, x[1].e) - greatest(k.s, x[1].s) + 1 >= 0.5 * least(k.e - k.s + 1, x[1].e - x[1].s + 1)"


_TERMS = "t AS (SELECT l_suppkey, l_orderkey, l_linenumber, s, s + CAST(l_quantity AS BIGINT) AS e FROM (SELECT *, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s FROM lineitem))"


def terms(spark, sf_dir):
    """l_suppkey, l_orderkey, l_linenumber, start, end: days from each item's delivery until it is used up, a piece a day."""
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))


@query("j9_interval_join", f"WITH {_TERMS} SELECT x.l_suppkey, count(*) AS pairs, CAST(sum(least(x.e, y.e) - greatest(x.s, y.s) + 1) AS BIGINT) AS days FROM t x JOIN t y ON x.l_suppkey = y.l_suppkey AND x.s <= y.e AND y.s <= x.e AND (x.l_orderkey, x.l_linenumber) < (y.l_orderkey, y.l_linenumber) GROUP BY 1")
def interval_join(spark, sf_dir):
    """Items of a supplier that were in use at the same time, and for how many days together."""
    name = lambda side: F.struct(f"{side}.l_orderkey", f"{side}.l_linenumber")
    t = terms(spark, sf_dir)
    pairs = intervals.overlapping(t, t, ["l_suppkey"]).filter(name("left") < name("right"))
    common = F.least("left.end", "right.end") - F.greatest("left.start", "right.start") + 1
    return pairs.groupBy("left.l_suppkey").agg(F.count("*").alias("pairs"), F.sum(common).alias("days"))


@query("j9_within_join", f"WITH {_TERMS} SELECT x.l_suppkey, count(*) AS pairs FROM t x JOIN t y ON x.l_suppkey = y.l_suppkey AND x.s <= y.s AND y.e <= x.e AND NOT (x.l_orderkey = y.l_orderkey AND x.l_linenumber = y.l_linenumber) GROUP BY 1")
def within_join(spark, sf_dir):
    """Items of a supplier that were in use while another one was."""
    t = terms(spark, sf_dir)
    other = ~((F.col("left.l_orderkey") == F.col("right.l_orderkey")) & (F.col("left.l_linenumber") == F.col("right.l_linenumber")))
    return intervals.overlapping(t, t, ["l_suppkey"], within=True).filter(other).groupBy("left.l_suppkey").agg(F.count("*").alias("pairs"))


@query("j9_without_overlaps", f"""WITH {PROTEINS}, f AS (SELECT protein_id, first AS start, n AS len, substr(p.seq, CAST(first AS INTEGER), CAST(n AS INTEGER)) AS seq FROM proteins p, unnest([20, 30]) AS l(n), unnest(range(1, 64 - n + 2)) AS t(first)),
scored AS (SELECT protein_id, CAST(start AS INTEGER) AS s, CAST(start + len - 1 AS INTEGER) AS e, round({_TAG}, 9) AS score FROM f),
ranked AS (SELECT protein_id, list([{{'s': s, 'e': e, 'score': score}}] ORDER BY score DESC, s, e) AS c FROM scored GROUP BY 1),
kept AS (SELECT protein_id, unnest(list_reduce(c, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_SPAN})) = 0 THEN list_concat(acc, x) ELSE acc END)) AS k FROM ranked)
SELECT protein_id, k.s AS start, k.e AS "end", k.score AS score FROM kept""")  # fmt: skip
def overlaps(spark, sf_dir):
    """Fragments of each protein by score, without those half covered by a better one."""
    frags = expansion.separate_fragments(proteins(spark, sf_dir).select("protein_id", "seq").distinct(), "seq", (20, 30))  # a protein's sequence follows from its id
    return frags.select("protein_id", "start", (F.col("start") + F.col("len") - 1).alias("end"), r9("score").alias("score"))


# --- expansion and simulation -------------------------------------------


@query("x1_random_mutants")
def random_mutants(spark, sf_dir):
    rows = proteins(spark, sf_dir).select("protein_id", "seq", F.lit("3-5, 9").alias("regions"), (F.col("protein_id") % 4).cast("string").alias("copies"))
    return expansion.mutants(rows, "protein_id", "seq", "regions", "copies").select("protein_id", "copy", "mode", "mutant")


@query("x2_x4_conservative_mutants")
def conservative_mutants(spark, sf_dir):
    region = F.when(F.col("protein_id") % 5 == 0, "").otherwise("3-5, 4")
    rows = proteins(spark, sf_dir).select("protein_id", "seq", region.alias("regions"), F.lit("2").alias("copies"))
    return expansion.mutants(rows, "protein_id", "seq", "regions", "copies", "conservative").select("protein_id", "copy", "mode", "mutant")


@query("x5_copy_precount", "SELECT CAST(sum(CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END) AS BIGINT) AS copies FROM events")
def precount(spark, sf_dir):
    from helixframe.functions.protein import copy_count

    text = F.get(F.array(F.lit(""), F.lit("2"), F.lit("0"), F.lit("3.0")), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").agg(F.sum(copy_count(text)).alias("copies"))


@query("x9_error_prone_pcr")
def error_prone(spark, sf_dir):
    """Mutants of each read at 0.6 percent over 25 cycles."""
    rows = reads(spark, sf_dir).select("read_id", "seq")
    return expansion.error_prone(rows, "read_id", "seq", expansion.compounded(0.006, 25)).select("read_id", "mutant", "mutations", "n_mutations")


@query("x6_u8_unique_designs")
def unique_designs(spark, sf_dir):
    """As many different proteins of a design as there are users."""
    n = table(spark, sf_dir, "events").select("user_id").distinct().count()
    return expansion.unique_proteins(expansion.sampled(spark, "NNKNNKNNKNNK", 3 * n), n)


@query("x12_x13_repeated_motifs")
def repeated_motifs(spark, sf_dir):
    """Motifs from the proteins' first residues, repeated to the target lengths in seven versions, capped and deduplicated."""
    motifs = proteins(spark, sf_dir).select(F.concat(F.substring("seq", 1, 4), F.lit("+")).alias("motif")).distinct()
    patches = [a + b for a in "GAVIL" for b in "GAVIL"]
    rows = expansion.triplicated(expansion.repeats(motifs, "motif", (25, 50)).withColumn("key", F.concat_ws("|", "motif", "target_length", "n_repeats")), "key", "raw", patches)
    rows = rows.withColumn("actual_length", F.length("sequence")).filter("actual_length <= 60")
    first = rows.groupBy("sequence").agg(F.min(F.struct("motif", "target_length", "n_repeats", "set", "attempt", "actual_length")).alias("x"))
    return first.select("x.*", "sequence").orderBy("actual_length", "sequence")


@query("x13_repeat_counts", f"""WITH {PROTEINS}, m AS (SELECT DISTINCT substr(seq, 1, CAST(4 + protein_id % 7 AS INTEGER)) AS motif FROM proteins), r AS (SELECT motif, target, unnest(range(1, 54)) AS n FROM m, (SELECT unnest([25, 50]) AS target))
SELECT motif || '+' AS motif, target AS target_length, CAST(n AS INTEGER) AS n_repeats FROM r WHERE n * length(motif) BETWEEN target - 3 AND target + 3""")  # fmt: skip
def repeat_counts(spark, sf_dir):
    motifs = proteins(spark, sf_dir).select(F.concat(F.substr("seq", F.lit(1), (4 + F.col("protein_id") % 7).cast("int")), F.lit("+")).alias("motif")).distinct()
    return expansion.repeats(motifs, "motif", (25, 50)).select("motif", "target_length", "n_repeats")


def _recombined(spark, sf_dir):
    from helixframe.operators.relational import numbered

    base = proteins(spark, sf_dir)
    pool = lambda first, n: numbered(base.select(F.concat(F.substring("seq", first, n), F.lit("+")).alias("motif")).distinct(), ["motif"])
    return expansion.recombined({4: pool(30, 4), 5: pool(1, 5), 10: pool(11, 10)}, (25, 50), 3, 10)


@query("x14_recombined_motifs")
def recombined(spark, sf_dir):
    """Recombined motifs of all four categories, in seven versions, within a cap."""
    rows = _recombined(spark, sf_dir).withColumn("key", F.concat_ws("|", "motif_type", "target_length", "n_repeats", "draw"))
    patches = [a + b for a in "GAVIL" for b in "GAVIL"]
    done = expansion.triplicated(rows, "key", "raw", patches).withColumn("actual_length", F.length("sequence"))
    return done.filter("actual_length <= 60").drop("key")


@query("x14_recombination_lengths", f"""WITH {PROTEINS}, t(target) AS (VALUES (25), (50)), alone AS (SELECT k || 'aa' AS motif_type, target, n, n * k AS residues FROM t, (VALUES (4), (5), (10)) kinds(k), range(1, 20) r(n)),
mixed AS (SELECT 'mixed_' || a || 'x5aa_' || b || 'x10aa', target, a + b, 5 * a + 10 * b FROM t, range(1, 12) x(a), range(1, 12) y(b)), plans AS (SELECT * FROM alone UNION ALL SELECT * FROM mixed)
SELECT motif_type, CAST(target AS INTEGER) AS target_length, CAST(n AS INTEGER) AS n_repeats, CAST(residues AS INTEGER) AS residues, 10::BIGINT AS draws FROM plans WHERE abs(residues - target) <= 3 AND (SELECT count(*) FROM proteins) > 0""")  # fmt: skip
def recombination_lengths(spark, sf_dir):
    """How many draws of each plan have how many residues."""
    n = F.length(F.replace("raw", F.lit("+"), F.lit(""))).alias("residues")
    return _recombined(spark, sf_dir).groupBy("motif_type", "target_length", "n_repeats", n).agg(F.count("*").alias("draws"))


@query("x29_split_and_oversample")
def split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("length"))
    return clusters.oversampled(rows, "length").groupBy("bucket", "part").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


@query("x29_length_buckets", """SELECT CASE WHEN length(text) > 1199 THEN 10 ELSE CAST(greatest(ceil((length(text) - 155) / 116.0), 0) AS INTEGER) END AS bucket, count(*) AS ids FROM documents GROUP BY 1""")
def length_buckets(spark, sf_dir):
    """How many rows each bucket holds, whatever their part and copies."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("length"))
    return clusters.oversampled(rows, "length").filter("copy = 1").groupBy("bucket").agg(F.count("*").alias("ids"))


@query("x27_proportion_sweep")
def sweep(spark, sf_dir):
    """For each proportion: kept residues, designs, their space, and the share of aligned sequences they cover."""
    from helixframe.operators import codons, profiles
    from helixframe.operators.graph import written
    from helixframe.plans.core import alignment

    p = profiles.proportions(profiles.cells(alignment(spark, sf_dir), "seq", (), "seq_id"))
    parts = []
    for share in (0.25, 0.5, 1.0):
        kept = profiles.top_and_extras(p, share)
        best = codons.best_codons(codons.columns_of(kept), codons.safe(codons.codon_table(spark)), codons.direct())
        space = codons.encoded_space(best)
        covered = codons.coverage(alignment(spark, sf_dir), "seq_id", "seq", best)
        parts.append(space.crossJoin(covered).select(F.lit(share).alias("proportion"), "space", r9("log10_space").alias("log10_space"), "n", r9("coverage").alias("coverage")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- fuzzy reads ---------------------------------------------------------

LEFT, RIGHT = "ACGTTGCAAGCT", "GGATCCTTAACC"


def constructs(spark, sf_dir):
    """Reads with anchors around a window; some reversed, some with an edit in an anchor, some cut short."""
    k = F.col("read_id")
    left = F.when(k % 5 == 0, "ACGTTGCTAGCT").when(k % 7 == 0, "ACGTTGCAGCT").otherwise(LEFT)
    whole = F.concat(F.substring("seq", 40, 6), left, F.substring("seq", 1, 18), F.lit(RIGHT), F.substring("seq", 50, 4))
    whole = F.when(k % 11 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    return reads(spark, sf_dir).select("read_id", F.when(k % 3 == 0, dna.reverse_complement(whole)).otherwise(whole).alias("seq"), F.repeat(F.lit("I"), F.length(whole)).alias("qual"))


_NEAR = "SELECT min(1000 * levenshtein(substr({t}, e - n + 1, n), '{p}') + e) FROM (SELECT unnest(range(1, length({t}) + 1)) AS e), unnest([10, 11, 12, 13, 14]) AS l(n) WHERE n <= e"


@query("d24_anchored_windows", f"""WITH {READS}, made AS (SELECT read_id, substr(seq, 40, 6) || CASE WHEN read_id % 5 = 0 THEN 'ACGTTGCTAGCT' WHEN read_id % 7 = 0 THEN 'ACGTTGCAGCT' ELSE '{LEFT}' END || substr(seq, 1, 18) || '{RIGHT}' || substr(seq, 50, 4) AS w FROM reads),
cut AS (SELECT read_id, CASE WHEN read_id % 11 = 0 THEN substr(w, 1, 20) ELSE w END AS w FROM made),
strands AS (SELECT read_id, unnest(['+', '-']) AS strand, unnest(CASE WHEN read_id % 3 = 0 THEN [reverse(translate(w, 'ACGT', 'TGCA')), w] ELSE [w, reverse(translate(w, 'ACGT', 'TGCA'))] END) AS t FROM cut),
placed AS (SELECT read_id, strand, t, ({_NEAR.format(t='t', p=LEFT)}) AS best FROM strands),
one AS (SELECT read_id, CASE WHEN best < 3000 THEN strand ELSE '?' END AS strand, CASE WHEN best < 3000 THEN substr(t, best % 1000 + 1, 18) END AS "window", CASE WHEN best < 3000 THEN substr(t, best % 1000 + 19, 12) ELSE '' END AS after
  FROM placed QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY best >= 3000, strand) = 1)
SELECT read_id, strand, "window", CASE WHEN strand = '?' THEN 'no_left_anchor' WHEN length("window") < 18 THEN 'short_window' WHEN coalesce(({_NEAR.format(t='after', p=RIGHT)}), 9000) < 3000 THEN 'direct' ELSE 'indel_in_right_window' END AS status FROM one""")  # fmt: skip
def windows(spark, sf_dir):
    got = fuzzy.anchored_windows(constructs(spark, sf_dir), "seq", "qual", LEFT, RIGHT, 18, 2)
    return got.select("read_id", "strand", "status", "window")


@query("d23_k14_w11_alignment_blocks")
def blocks(spark, sf_dir):
    """Edit alignments of the two halves of each read, as text blocks."""
    halves = reads(spark, sf_dir).select("read_id", F.substring("seq", 1, 32).alias("a"), F.substring("seq", 33, 32).alias("b"))
    return fuzzy.alignment_blocks(fuzzy.aligned(halves, "a", "b"), 10).select("read_id", "distance", "block", "line_top", "line_marks", "line_bottom", "end_top", "end_bottom")


@query("d23_edit_distances", f"WITH {SUBSTITUTED} SELECT read_id, CAST(levenshtein(seq, substr(seq, 3 + read_id % 5)) AS INTEGER) AS distance FROM substituted")
def edit_distances(spark, sf_dir):
    """Edit distances of each read from what is left of it without its first bases."""
    s = F.col("seq")
    pairs = substituted(spark, sf_dir).select("read_id", s.alias("a"), F.substr(s, (3 + F.col("read_id") % 5).cast("int"), F.lit(64)).alias("b"))
    return fuzzy.aligned(pairs, "a", "b").select("read_id", "distance")


@query("d25_rescued_reads")
def rescued(spark, sf_dir):
    k = F.col("read_id")
    read = F.when(k % 4 == 0, F.concat(F.lit("ACGTACGTT"), F.substring("seq", 1, 6), F.lit("GGCC"))).otherwise(F.concat(F.lit("ACGTACGT"), F.substring("seq", 1, 5), F.lit("GGCC")))
    return fuzzy.rescued(reads(spark, sf_dir).select("read_id", read.alias("read")), "read", "ACGTACGTNNNNNNGGCC", 9, 14, 6)


@query("d17_cigar_walk", f"""WITH {SAM} SELECT read_id, CAST(pos + x[1] AS INTEGER) AS ref_pos, CASE WHEN x[2] = 0 THEN '-' ELSE substr(seq, x[2], 1) END AS base,
CAST(CASE WHEN x[2] = 0 THEN 0 WHEN qual = '*' THEN 99 ELSE ascii(substr(qual, x[2], 1)) - 33 END AS INTEGER) AS q FROM walk""")  # fmt: skip
def cigar(spark, sf_dir):
    return fuzzy.observed_bases(alignments(spark, sf_dir)).select("read_id", "ref_pos", "base", "q")


@query("f10_alignment_flags", "SELECT user_id, min(event_id) AS pos FROM events WHERE (CAST(event_id % 4096 AS INTEGER) & 2308) = 0 GROUP BY 1")
def flags(spark, sf_dir):
    sam = table(spark, sf_dir, "events").select(F.col("user_id"), (F.col("event_id") % 4096).cast("int").alias("flag"), F.col("event_id").alias("pos"))
    return fuzzy.usable_alignments(sam, "flag", "user_id", "pos").select("user_id", "pos")


# --- trajectories --------------------------------------------------------

BOX = 10.0
_HASHED = ", ".join(f"CAST(CAST('0x' || substr(md5('{c}' || CAST(event_id AS VARCHAR)), 1, 4) AS INTEGER) AS DOUBLE) / 6553.6 AS {c}" for c in "xyz")
_BEADS = f"beads AS (SELECT event_id // 60 AS frame, CAST((event_id % 60) // 4 AS INTEGER) AS chain, CAST(event_id % 4 AS INTEGER) AS bead, {_HASHED} FROM events)"
_IMAGE = lambda d: f"({d} - {BOX} * round(({d}) / {BOX}))"
_STEPS = ", ".join(f"coalesce({_IMAGE(f'{c} - lag({c}) OVER w')}, {c}) AS d{c}" for c in "xyz")
_UNWRAPPED = ", ".join(f"sum(d{c}) OVER (PARTITION BY frame, chain ORDER BY bead) AS {c}" for c in "xyz")
_SPREAD = " + ".join(f"avg({c} * {c}) - avg({c}) * avg({c})" for c in "xyz")
_SQUARE = " + ".join(f"{_IMAGE(f'(p.{c} - q.{c})')} ** 2" for c in "xyz")


def beads(spark, sf_dir):
    """A frame of 15 chains of four beads for each sixty events: coordinates from digits of the event's digest."""
    hashed = lambda s: F.conv(F.substring(F.md5(F.concat(F.lit(s), F.col("event_id").cast("string"))), 1, 4), 16, 10).cast("double") / 6553.6
    k = F.pmod("event_id", F.lit(60))
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 60).alias("frame"), F.floor(k / 4).cast("int").alias("chain"), F.pmod(k, F.lit(4)).cast("int").alias("bead"), *(hashed(c).alias(c) for c in "xyz"))


@query("g42_radius_of_gyration", f"""WITH {_BEADS}, s AS (SELECT frame, chain, bead, {_STEPS} FROM beads WINDOW w AS (PARTITION BY frame, chain ORDER BY bead)), u AS (SELECT frame, chain, {_UNWRAPPED} FROM s)
SELECT frame, chain, round(sqrt({_SPREAD}), 6) AS rg FROM u GROUP BY 1, 2""")  # fmt: skip
def gyration(spark, sf_dir):
    return trajectory.gyration(beads(spark, sf_dir), BOX).withColumn("rg", F.round("rg", 6))


@query("j10_g44_chain_contacts", f"WITH {_BEADS} SELECT p.frame, p.chain AS a, q.chain AS b, count(*) AS n FROM beads p JOIN beads q ON p.frame = q.frame AND p.chain < q.chain WHERE {_SQUARE} <= 0.7 * 0.7 GROUP BY 1, 2, 3")
def contacts(spark, sf_dir):
    return trajectory.contacts(beads(spark, sf_dir), BOX, 0.7)


@query("g43_chain_clusters", f"""WITH RECURSIVE {_BEADS}, pairs AS (SELECT p.frame, p.chain AS a, q.chain AS b, count(*) AS n FROM beads p JOIN beads q ON p.frame = q.frame AND p.chain < q.chain WHERE {_SQUARE} <= 0.7 * 0.7 GROUP BY 1, 2, 3),
t(threshold) AS (VALUES (1), (5), (10)), edges AS (SELECT threshold, frame, a, b FROM pairs, t WHERE n >= threshold UNION SELECT threshold, frame, b, a FROM pairs, t WHERE n >= threshold),
reach AS (SELECT threshold, frame, chain, chain AS other FROM t, (SELECT DISTINCT frame, chain FROM beads) UNION SELECT r.threshold, r.frame, r.chain, e.b FROM reach r JOIN edges e ON r.threshold = e.threshold AND r.frame = e.frame AND r.other = e.a),
sizes AS (SELECT threshold, frame, c, count(*) AS size FROM (SELECT threshold, frame, chain, min(other) AS c FROM reach GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)
SELECT CAST(threshold AS INTEGER) AS threshold, frame, count(*) AS clusters, max(size) AS largest, round(coalesce(sum(size) FILTER (size > 1), 0) / sum(size), 9) AS bound_share, round(sum(size * size) / sum(size), 9) AS mean_size FROM sizes GROUP BY 1, 2""")
def chain_clusters(spark, sf_dir):
    rows = beads(spark, sf_dir)
    got = trajectory.chain_clusters(trajectory.contacts(rows, BOX, 0.7), rows.select("frame", "chain").distinct())
    return got.withColumns({"bound_share": r9("bound_share"), "mean_size": r9("mean_size")})




ORIGINAL = "ACGTACGTACGTACGTACGTACGT"
DESIGNED = "ANGTACKTACGTACRTACGTACGT"


def sam(spark, sf_dir):
    k = F.col("read_id")
    return reads(spark, sf_dir).select(
        F.concat(F.lit("q"), k).alias("qname"), F.when(k % 17 == 0, 4).otherwise(0).alias("flag"), F.lit("ref").alias("rname"), F.lit(1).alias("pos"), (k % 60).cast("int").alias("mapq"),
        F.when(k % 5 == 0, "6M2D16M").otherwise("24M").alias("cigar"), F.substring("seq", 1, 24).alias("seq"), F.substring("qual", 1, 24).alias("qual"),
    )


_CALLED = f"""{READS}, sam AS (SELECT read_id, read_id % 5 = 0 AS gap, substr(seq, 1, 24) AS seq, substr(qual, 1, 24) AS qual, read_id % 60 AS mapq FROM reads WHERE read_id % 17 <> 0),
cells AS (SELECT *, substr(seq, 2, 1) AS b1, ascii(substr(qual, 2, 1)) - 33 AS q1, CASE WHEN gap THEN '-' ELSE substr(seq, 7, 1) END AS b2, ascii(substr(qual, 7, 1)) - 33 AS q2,
  substr(seq, CASE WHEN gap THEN 13 ELSE 15 END, 1) AS b3, ascii(substr(qual, CASE WHEN gap THEN 13 ELSE 15 END, 1)) - 33 AS q3 FROM sam),
called AS (SELECT *, CASE WHEN mapq < 20 THEN 'low_mapq' WHEN q1 < 8 OR b2 = '-' OR q2 < 8 OR q3 < 8 THEN 'incomplete_or_low_baseq' WHEN b2 NOT IN ('G', 'T') OR b3 NOT IN ('A', 'G') THEN 'invalid_design' ELSE 'assigned' END AS status FROM cells)"""


@query("k8_haplotype_calling", f"WITH {_CALLED} SELECT status, CASE WHEN status IN ('assigned', 'invalid_design') THEN b1 || b2 || b3 ELSE '' END AS hap, count(*) AS n FROM called GROUP BY 1, 2")
def haplotype_calling(spark, sf_dir):
    """Aligned reads to statuses and haplotypes at the designed positions."""
    from helixframe.operators import calling

    got = calling.call(sam(spark, sf_dir), ORIGINAL, DESIGNED)
    return got.reads.groupBy("status", F.coalesce("hap", F.lit("")).alias("hap")).agg(F.count("*").alias("n"))


@query("k8_position_tallies", f"""WITH {_CALLED}, good AS (SELECT * FROM called WHERE mapq >= 20), p AS (SELECT 2 AS pos, b1 AS b, q1 AS q FROM good UNION ALL SELECT 7, b2, q2 FROM good WHERE q1 >= 8 UNION ALL SELECT 15, b3, q3 FROM good WHERE q1 >= 8 AND b2 <> '-' AND q2 >= 8)
SELECT pos, count(*) FILTER (b = 'A' AND q >= 8) AS "A", count(*) FILTER (b = 'C' AND q >= 8) AS "C", count(*) FILTER (b = 'G' AND q >= 8) AS "G", count(*) FILTER (b = 'T' AND q >= 8) AS "T", 0::BIGINT AS missing, count(*) FILTER (b = '-') AS deletion, count(*) FILTER (b <> '-' AND q < 8) AS low_quality FROM p GROUP BY 1""")  # fmt: skip
def position_tallies(spark, sf_dir):
    from helixframe.operators import calling

    return calling.call(sam(spark, sf_dir), ORIGINAL, DESIGNED).positions


@query("d18_d19_called_variants", f"""WITH {_CALLED}, h AS (SELECT b1 || b2 || b3 AS hap, count(*) AS reads FROM called WHERE status = 'assigned' GROUP BY 1)
SELECT hap, reads, round(reads / sum(reads) OVER (), 9) AS frequency, 'A' || hap[1] || 'GTAC' || hap[2] || 'TACGTAC' || hap[3] || 'TACGTACGT' AS sequence,
concat_ws(';', CASE WHEN hap[1] <> 'C' THEN 'C2' || hap[1] END, CASE WHEN hap[2] <> 'G' THEN 'G7' || hap[2] END, CASE WHEN hap[3] <> 'G' THEN 'G15' || hap[3] END) AS nt_changes FROM h""")  # fmt: skip
def called_variants(spark, sf_dir):
    from helixframe.operators import calling

    got = calling.variants(calling.call(sam(spark, sf_dir), ORIGINAL, DESIGNED).reads, ORIGINAL, DESIGNED)
    return got.select("hap", "reads", r9("frequency").alias("frequency"), "sequence", "nt_changes")


@query("q5_kappa")
def kappa(spark, sf_dir):
    from helixframe.operators import models

    return proteins(spark, sf_dir).select("protein_id", r9(models.kappa(F.col("seq"))).alias("kappa"))


@query("q21_combinations", f"""WITH {PROTEINS}, s AS (SELECT protein_id, list_transform([1, 2, 3, 5], lambda p: {{'G': 1, 'A': 3, 'V': 3, 'L': 3, 'I': 3, 'M': 2, 'F': 2, 'Y': 3, 'W': 2, 'S': 3, 'T': 3, 'N': 3, 'Q': 3, 'K': 2, 'R': 2, 'H': 3, 'D': 2, 'E': 2, 'C': 2, 'P': 2}}[substr(seq, p, 1)]) AS k FROM proteins)
SELECT protein_id, CAST(k[1] * k[2] * k[3] * k[4] AS VARCHAR) AS conservative, '130321' AS random FROM s""".replace("{'G': 1", "map {'G': 1"))  # fmt: skip
def combinations(spark, sf_dir):
    s, r = F.col("seq"), F.lit("1-3, 2, 5")
    return proteins(spark, sf_dir).select("protein_id", expansion.combinations(s, r).alias("conservative"), expansion.combinations(s, r, "random").alias("random"))


@query("q22_model_predictions", f"WITH {PROTEINS} SELECT protein_id, round((length(seq) - length(replace(seq, 'A', ''))) / length(seq), 9) AS alanine FROM proteins")
def predictions(spark, sf_dir):
    """A stand-in model over tokens: the adapter's shape, with the share of alanine."""
    from helixframe.operators import models

    def load():
        return lambda texts: [t.count("A") / max(1, len(t.split())) for t in texts]

    return models.predicted(proteins(spark, sf_dir).select("protein_id", "seq"), "seq", "alanine", load).select("protein_id", r9("alanine").alias("alanine"))


@query("d20_mapping_reference", f"WITH {READS} SELECT read_id, " + " || ".join(f"CASE WHEN contains('{IUPAC[d]}', substr(seq, {k}, 1)) THEN substr(seq, {k}, 1) ELSE '{min(IUPAC[d])}' END" for k, d in enumerate(MAPPED, 1)) + " AS reference FROM reads")
def mapping_reference(spark, sf_dir):
    """A concrete reference for a design from each read as the original."""
    return reads(spark, sf_dir).select("read_id", dna.mapping_reference(F.col("seq"), MAPPED).alias("reference"))


@query("q22_to_real", """WITH p AS (SELECT event_id, user_id % 3 AS model, (value - 55) / 40 AS y FROM events), l AS (SELECT * FROM (VALUES (0, 0.35, 3.5, 2.25), (1, 0.0, 0.5, 1.5), (2, 2.0, -0.25, 0.75)) AS t(model, e, m, d)),
r AS (SELECT event_id, e, CAST(y * d + m AS DOUBLE) AS z FROM p JOIN l USING (model))
SELECT event_id, round(CASE WHEN z >= 0 THEN CASE WHEN e = 0 THEN exp(z) - 1 WHEN e * z > -1 THEN pow(e * z + 1, 1 / e) - 1 END ELSE CASE WHEN e = 2 THEN 1 - exp(-z) WHEN (e - 2) * z > -1 THEN 1 - pow(1 - (2 - e) * z, 1 / (2 - e)) END END, 6) AS real FROM r""")
def to_real(spark, sf_dir):
    """Predictions of three models on the scale of their measurements, by the inverse of each one's transform."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("model"), ((F.col("value") - 55) / 40).alias("y"))
    powers = [power.Power(0.35, 3.5, 2.25), power.Power(0.0, 0.5, 1.5), power.Power(2.0, -0.25, 0.75)]
    real = F.coalesce(*(F.when(F.col("model") == k, power.to_real(F.col("y"), p)) for k, p in enumerate(powers)))
    return rows.select("event_id", F.round(real, 6).alias("real"))


@query("q22_power_round_trip", "SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE), 6) AS quantity, round(CAST(l_extendedprice AS DOUBLE), 4) AS price FROM lineitem")
def power_round_trip(spark, sf_dir):
    """Two columns to what a model is trained on and back, with fitted exponents."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"))
    found = power.fitted(rows, ["quantity", "price"])
    back = {c: F.round(power.to_real(power.from_real(F.col(c), p), p), digits) for (c, p), digits in zip(found.items(), (6, 4), strict=True)}
    return rows.withColumns(back)


@query("x11_motif_pools")
def motif_pools(spark, sf_dir):
    """A five- and a ten-residue motif for each event, of the pattern that its number gives."""
    rows = table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(405)).alias("p5"), F.pmod("event_id", F.lit(196_830)).alias("p10"))
    five = expansion.patterned_motifs(rows, "p5", ["event_id"], 5).withColumnRenamed("motif", "five")
    ten = expansion.patterned_motifs(five, "p10", ["event_id"], 10).withColumnRenamed("motif", "ten")
    return expansion.anchored_motifs(ten, ["event_id"]).select("event_id", "five", "ten", "motif")


@query("x24_binned_designs")
def binned(spark, sf_dir):
    """Sequences in bins by medoids, a design for each bin, and its space."""
    from helixframe.operators import codons, profiles
    from helixframe.operators.graph import written
    from helixframe.plans.core import alignment

    rows = alignment(spark, sf_dir)
    centres = clusters.medoid_sequences(written(rows.select("seq").distinct(), "sequences"), "seq", 3)
    rows = written(clusters.to_centres(rows.select("seq_id", "seq"), "seq", centres), "binned")
    cells = profiles.cells(rows, "seq", ["medoid"], "seq_id")
    best = codons.best_codons(codons.columns_of(profiles.proportions(cells, ["medoid"]), ["medoid"]), codons.safe(codons.codon_table(spark)), codons.direct(), ["medoid", "pos"])
    space = codons.encoded_space(best, ["medoid"])
    sizes = rows.groupBy("medoid").agg(F.count("*").alias("rows"))
    return sizes.join(space, "medoid").select("medoid", "rows", "space", r9("log10_space").alias("log10_space"))



@query("x31_equilibration", """WITH s AS (SELECT series, list(value ORDER BY event_id) AS v FROM (SELECT concat_ws('-', user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT)) AS series, event_id, value FROM events) GROUP BY 1),
x AS (SELECT series, v, start, list_slice(v, start + 1, len(v)) AS x FROM (SELECT series, v, unnest(CASE WHEN len(v) > 2 AND list_max(v) > list_min(v) THEN range(0, len(v) - 2, greatest(1, len(v) // 20)) ELSE [0] END) AS start FROM s)),
d AS (SELECT series, start, len(v) AS n, len(x) AS k, list_transform(x, lambda y: y - list_avg(x)) AS d FROM x),
lags AS (SELECT *, list_sum(list_transform(range(1, k - t + 1), lambda i: d[i] * d[i + t])) / nullif((k - t) * list_avg(list_transform(d, lambda y: y * y)), 0) AS c FROM (SELECT *, unnest(range(1, k - 1)) AS t FROM d)),
stops AS (SELECT series, start, coalesce(min(t) FILTER (WHERE t > 3 AND c <= 0), 1e9) AS stop FROM lags GROUP BY 1, 2),
g AS (SELECT d.series, d.start, d.n, greatest(1, 1 + 2 * coalesce(sum(c * (1 - t / l.k)) FILTER (WHERE t < stop), 0)) AS g FROM d LEFT JOIN lags l USING (series, start) LEFT JOIN stops USING (series, start) GROUP BY 1, 2, 3)
SELECT series, start, round(g, 6) AS g, round((n - start) / g, 6) AS n_effective FROM g QUALIFY row_number() OVER (PARTITION BY series ORDER BY round((n - start) / g, 9) DESC, start) = 1""")  # fmt: skip
def equilibration(spark, sf_dir):
    """Where the values of each user's day settle."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", F.floor(F.unix_timestamp("ts") / 86400)).alias("series"), "event_id", "value")
    got = trajectory.equilibration(rows, "series", "event_id", "value")
    return got.select("series", "start", F.round("g", 6).alias("g"), F.round("n_effective", 6).alias("n_effective"))
