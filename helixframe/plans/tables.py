"""Queries of readers, writers and column choice on tables that are written to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import dna
from helixframe.operators import columns, expansion, fuzzy, profiles
from helixframe.plans.core import CELLS, COUNTS, READS, SUBSTITUTED, alignment, query, r9, reads, substituted, table, variant_counts
from helixframe.plans.files import place
from helixframe.sources import text


@query("s13_leading_metadata", "SELECT CASE WHEN event_id % 5 = 0 THEN '#' ELSE '' END || event_id AS id, event_type AS kind FROM events")
def leading(spark, sf_dir):
    """Only the # lines before the header are metadata: later ones are rows."""
    path = place(spark, "csv")
    rows = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 5 == 0, "#").otherwise(""), "event_id", F.lit(","), "event_type").alias("value"))
    rows.mapInArrow(_headed, "value string").write.text(path)
    return text.read_csv(spark, path, "leading").select("id", "kind")


def _headed(batches):
    """Two metadata lines and a header in front of each partition's lines."""
    import pyarrow as pa

    yield pa.RecordBatch.from_pydict({"value": ["# made by hand", "# of events", "id,kind"]})
    yield from batches


@query("s12_comment_lines", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events WHERE event_id % 5 <> 0")
def comment_lines(spark, sf_dir):
    """All lines that begin with # go, wherever they stand."""
    path = place(spark, "csv")
    rows = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_id") % 5 == 0, "  #").otherwise(""), "event_id", F.lit(","), "event_type").alias("value"))
    rows.mapInArrow(_headed, "value string").write.text(path)
    return text.read_csv(spark, path).select("id", "kind")


@query("s11_quoted_line_feeds", "SELECT CAST(event_id AS VARCHAR) AS id, event_type || chr(10) || 'of user ' || user_id AS note FROM events")
def quoted(spark, sf_dir):
    path = place(spark, "csv")
    note = F.concat("event_type", F.lit("\n"), F.lit("of user "), "user_id")
    table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), note.alias("note")).write.option("header", True).csv(path)
    return text.read_csv(spark, path, multi_line=True)


@query("s5_bare_fasta", f"WITH {READS} SELECT seq FROM reads UNION ALL SELECT 'ACGTACGT'")
def bare(spark, sf_dir):
    """Files that begin with a sequence without a header, which is one record each."""
    path = place(spark, "fasta")

    def with_bare(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": ["ACGT", "ACGT"]})
        yield from batches

    reads(spark, sf_dir).select(F.concat(F.lit(">r"), "read_id", F.lit("\n"), "seq").alias("value")).mapInArrow(with_bare, "value string").write.text(path)
    got = text.read_fasta(spark, path, strict=False)
    return got.filter("header <> ''").select("seq").unionByName(got.filter("header = ''").select("seq").distinct())


_SAMPLE = f"""{SUBSTITUTED}, sample AS (SELECT seq AS aa_variant, count(*) AS n, round(avg(read_id), 3) AS mean_id, CAST(min(read_id) AS DOUBLE) AS first_id FROM substituted GROUP BY 1)"""


@query("s16_s17_sample_with_features", f"WITH {_SAMPLE} SELECT upper(aa_variant) AS sequence, n, mean_id, first_id FROM sample")
def sample(spark, sf_dir):
    """A sample's counts and features, checked as they are read; the sequence column is found by its name."""
    path = place(spark, "csv")
    rows = substituted(spark, sf_dir).groupBy(F.lower("seq").alias("aa_variant")).agg(F.count("*").alias("count"), F.round(F.avg("read_id"), 3).alias("mean_id"), F.min("read_id").alias("first_id"))
    rows.write.option("header", True).csv(path)
    found = columns.find_column(spark.read.option("header", True).csv(path).columns, None, ("variant", "aa_variant"), fuzzy=True)
    return text.read_sample(spark, path, ["mean_id", "first_id"], found)


@query("s18_cluster_bundle", f"WITH {COUNTS}, m AS (SELECT variant % 7 AS cluster, sample, n FROM counts) SELECT CAST(cluster AS VARCHAR) AS cluster, CAST(sum(n) FILTER (sample = 'click') AS VARCHAR) AS click_reads, CAST(sum(n) AS VARCHAR) AS all_reads FROM m GROUP BY 1")
def bundle(spark, sf_dir):
    """Counts, traits and members of a clustering, read together and checked against each other."""
    paths = [place(spark, "csv") for _ in range(3)]
    click = F.sum(F.when(F.col("sample") == "click", F.col("n")))
    each = variant_counts(spark, sf_dir).groupBy("variant").agg(click.alias("click_reads"), F.sum("n").alias("all_reads")).withColumn("cluster", F.col("variant") % 7)
    total = each.groupBy("cluster").agg(F.sum("click_reads").alias("click_reads"), F.sum("all_reads").alias("all_reads"))
    for df, path in zip((total, total.select("cluster", (F.col("cluster") * 2).alias("trait")), each), paths, strict=True):
        df.write.option("header", True).csv(path)
    return text.read_clusters(spark, *paths, ["click", "all"])["counts"].select("cluster", "click_reads", "all_reads")


@query("s20_s23_template_distances", f"WITH {READS}, t AS (SELECT seq AS template FROM reads ORDER BY read_id LIMIT 1) SELECT read_id, CAST(hamming(seq, template) AS INTEGER) AS distance FROM reads, t")
def template(spark, sf_dir):
    """The first read as a template in a file of its own, and each read's distance to it."""
    path = place(spark, "fasta")
    text.write_fasta(reads(spark, sf_dir).orderBy("read_id").limit(1), path, F.lit("template"), F.lower("seq"), 20)
    return reads(spark, sf_dir).select("read_id", dna.hamming(F.col("seq"), F.lit(text.read_template(spark, path))).cast("int").alias("distance"))


@query("s21_bias_weights", f"""WITH {READS}, c AS (SELECT substr(seq, 1, 1) AS base, substr(seq, 2, 1) AS alt, count(*) AS n FROM reads GROUP BY 1, 2)
SELECT base, alt, round(n / sum(n) OVER (PARTITION BY base), 9) AS weight FROM c WHERE base <> alt""")  # fmt: skip
def bias(spark, sf_dir):
    """How often each other base follows a first one, as weights in a JSON file."""
    path = place(spark, "json")
    pairs = reads(spark, sf_dir).groupBy(F.substring("seq", 1, 1).alias("base"), F.substring("seq", 2, 1).alias("alt")).agg(F.count("*").alias("n")).filter("base <> alt")
    by_base = F.create_map(*(x for b in "ACGT" for x in (F.lit(b), F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.when(F.col("base") == b, F.struct("alt", "n")))), lambda e: e.isNotNull())))))
    pairs.agg(F.to_json(by_base).alias("value")).write.text(path)
    rows = [(b, a, w) for b, weights in text.read_bias(spark, path).items() for a, w in weights.items()]  # twelve
    return spark.createDataFrame(rows, "base string, alt string, weight double").withColumn("weight", r9("weight"))


@query("s22_hotspot_weights", "WITH w AS (SELECT CAST(1 + event_id % 50 AS INTEGER) AS position, CAST(count(*) AS DOUBLE) / 8 AS weight FROM events GROUP BY 1) SELECT CAST(p AS INTEGER) AS position, coalesce(weight, 1.0) AS weight FROM range(1, 65) t(p) LEFT JOIN w ON w.position = p")
def weights(spark, sf_dir):
    """Weights of 50 positions in a text file with comments; the 14 others weigh 1."""
    path = place(spark, "weights")
    rows = table(spark, sf_dir, "events").groupBy((1 + F.col("event_id") % 50).cast("int").alias("position")).agg((F.count("*") / 8).alias("weight"))
    rows.select(F.concat_ws(" ", "position", "weight", F.lit("# count"))).write.text(path)
    return text.read_weights(spark, path, 64)


@query("s24_p1_p2_variant_column", "SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS sequence, true AS with_blanks FROM events UNION ALL SELECT event_type, false FROM events WHERE event_id % 9 <> 0")
def variant_column(spark, sf_dir):
    """The variant column alone, with its blank cells and without them."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 9 != 0, F.col("event_type")).alias("aa_variant"), "value")
    kept = columns.sequences(rows, "AA_Variant", keep_blank=True).withColumn("with_blanks", F.lit(True))
    return kept.unionByName(columns.sequences(rows, "aa_variant").withColumn("with_blanks", F.lit(False)))


@query("s26_residue_parameters", "SELECT chr(CAST(65 + p_partkey % 26 AS INTEGER)) AS one, p_brand AS three, p_retailprice AS \"MW\", CAST(p_size AS DOUBLE) / 50 AS lambdas, 0.5 AS sigmas, CAST(p_partkey % 3 - 1 AS INTEGER) AS q, 0.38 AS bondlength FROM part")
def residues(spark, sf_dir):
    """A table of residue parameters in its fixed columns."""
    path = place(spark, "csv")
    k = F.col("p_partkey")
    table(spark, sf_dir, "part").select(F.char(65 + k % 26).alias("one"), F.col("p_brand").alias("three"), F.col("p_retailprice").alias("MW"), (F.col("p_size").cast("double") / 50).alias("lambdas"), F.lit(0.5).alias("sigmas"), (k % 3 - 1).alias("q"), F.lit(0.38).alias("bondlength")).write.option("header", True).csv(path)
    return text.read_residues(spark, path)


@query("k4_k5_plain_numbers", f"WITH {READS} SELECT CAST(row_number() OVER (ORDER BY seq, read_id) AS VARCHAR) AS name, seq FROM reads")
def plain_numbers(spark, sf_dir):
    path = place(spark, "fasta")
    text.write_numbered_fasta(reads(spark, sf_dir).select("read_id", "seq"), path, ["seq", "read_id"], "seq")
    return text.read_fasta(spark, path).select("name", "seq")


@query("k7_annotated_positions", f"""WITH {CELLS}, p AS (SELECT pos, max(aa) FILTER (rank = 1) AS top_aa, max(proportion) AS score, string_agg(aa || ':' || printf('%.2f', 100 * proportion) || '%', ',' ORDER BY rank) AS breakdown FROM profile WHERE sample = 'view' GROUP BY 1)
SELECT CAST(pos AS VARCHAR) AS position, top_aa, breakdown AS proportion_breakdown, printf('%.4f', score) AS score, printf('%.4f', 2 * score) AS z, CAST(score > 0.3 AS VARCHAR) AS hotspot FROM p""")  # fmt: skip
def annotated(spark, sf_dir):
    path = place(spark, "tsv")
    p = profiles.proportions(profiles.cells(alignment(spark, sf_dir).filter("sample = 'view'"), "seq", (), "seq_id"))
    scores = p.groupBy("pos").agg(F.max("proportion").alias("score")).select("pos", "score", (2 * F.col("score")).alias("z"), (F.col("score") > 0.3).alias("hotspot"))
    text.write_annotated_table(p, scores, path)
    return spark.read.option("sep", "\t").option("header", True).csv(path)


_MUTANTS = f"""{SUBSTITUTED}, m AS (SELECT seq, min(read_id) AS read_id FROM substituted GROUP BY 1)"""


@query("k10_u9_mutant_table", f"WITH {_MUTANTS} SELECT 'mutant_' || lpad(CAST(row_number() OVER (ORDER BY read_id) AS VARCHAR), 6, '0') AS sequence_id, CAST(read_id % 4 AS VARCHAR) AS mutation_count, CASE WHEN read_id % 4 = 0 THEN 'WT' ELSE 'A1C,G2T' END AS mutations, CAST(NULL AS VARCHAR) AS effective_error_rate_per_base, seq AS sequence FROM m")
def mutant_table(spark, sf_dir):
    """Different mutants in order, as a table with tabs."""
    path = place(spark, "tsv")
    rows = substituted(spark, sf_dir).select("read_id", F.col("seq").alias("mutant"), F.when(F.col("read_id") % 4 == 0, "WT").otherwise("A1C;G2T").alias("mutations"), (F.col("read_id") % 4).alias("n_mutations"))
    text.write_mutants(expansion.unique_mutants(rows, "read_id"), path, ["read_id"], "\t")
    return spark.read.option("sep", "\t").option("header", True).csv(path)


@query("k13_input_digests", "SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10)) AS sha256, CAST(sum(length(r_name) + 1) AS BIGINT) AS length FROM region")
def input_digests(spark, sf_dir):
    """Length and digest of an input file, for a run's metadata."""
    path = place(spark, "text")
    table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").coalesce(1).write.text(path)  # five rows
    return text.digests(spark, f"{path}/*.txt").select("sha256", "length")


@query("k15_metrics_text", "SELECT 'Events by type' AS line UNION ALL SELECT event_type || ': ' || count(*) FROM events GROUP BY event_type UNION ALL SELECT 'Users by events' UNION ALL SELECT lpad(CAST(n AS VARCHAR), 6, '0') || ': ' || count(*) FROM (SELECT count(*) AS n FROM events GROUP BY user_id) GROUP BY n")
def metrics(spark, sf_dir):
    path = place(spark, "metrics")
    events = table(spark, sf_dir, "events")
    by_user = events.groupBy("user_id").count().groupBy(F.lpad(F.col("count").cast("string"), 6, "0").alias("label")).agg(F.count("*").alias("n"))
    text.write_metrics({"Events by type": events.groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n")), "Users by events": by_user}, path)
    return spark.read.text(f"{path}/*").withColumnRenamed("value", "line")


@query("p4_p6_resolved_columns", "SELECT s_suppkey AS id, s_name AS sequence FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def resolved(spark, sf_dir):
    """A name column found exactly, another one as a part of a name, and columns bound by place."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer").withColumnRenamed("c_name", "protein_sequence_1")
    first = columns.by_position(supplier.select("s_suppkey", columns.find_column(supplier.columns, "S_NAME")), ["id", "sequence"])
    return first.unionByName(customer.select(F.col("c_custkey").alias("id"), F.col(columns.find_column(customer.columns, fuzzy=True)).alias("sequence")))


@query("p7_u6_shared_features", "WITH b AS (SELECT s_nationkey AS nation, s_acctbal AS balance FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer) SELECT 'nation' AS feature, round(avg(nation), 6) AS mean FROM b UNION ALL SELECT 'balance', round(avg(balance), 6) FROM b")
def shared(spark, sf_dir):
    """Means of the numeric columns that two tables share."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("s_name"))
    features = columns.shared_features([a, b], exclude=["id"])
    both = a.select(*features).unionByName(b.select(*features)).agg(*(F.avg(c).alias(c) for c in features))
    return both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("mean")) for c in features))))


@query("p11_p12_all_columns", "SELECT event_id, event_type, CAST(NULL AS DOUBLE) AS score, '' AS error FROM events")
def all_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return columns.with_columns(rows, {"event_type": "string", "score": "double", "error": "string"}, blank=["error"])


@query("p13_q23_names_and_numbers", """SELECT event_id, CASE WHEN s = '' THEN 'property' ELSE s END AS name, CASE WHEN n >= 1e9 THEN printf('%.2fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.2fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fK', n / 1e3) ELSE CAST(CAST(n AS BIGINT) AS VARCHAR) END AS short,
CASE WHEN p < 0.001 THEN printf('%.2e', p) ELSE printf('%.3f', p) END AS p FROM (SELECT event_id, trim(regexp_replace(props, '[^A-Za-z0-9._-]+', '_', 'g'), '._') AS s, CAST(event_id AS DOUBLE) * event_id * 7 AS n, (1 + event_id) / 1048576.0 AS p FROM events)""")  # fmt: skip
def names_and_numbers(spark, sf_dir):
    k = F.col("event_id")
    n = k.cast("double") * k * 7
    return table(spark, sf_dir, "events").select("event_id", columns.safe_name(F.col("props")).alias("name"), columns.short_number(n).alias("short"), columns.p_label((1 + k) / 1048576.0).alias("p"))


@query("d26_code_matches", f"""WITH {READS}, codes(code, bases) AS (VALUES ('A', 'A'), ('C', 'C'), ('G', 'G'), ('T', 'T'), ('R', 'AG'), ('Y', 'CT'), ('S', 'CG'), ('W', 'AT'), ('K', 'GT'), ('M', 'AC'), ('B', 'CGT'), ('D', 'AGT'), ('H', 'ACT'), ('V', 'ACG'), ('N', 'ACGT'))
SELECT code, count(*) AS n FROM reads, codes WHERE contains(bases, substr(seq, 1, 1)) GROUP BY 1""")  # fmt: skip
def code_matches(spark, sf_dir):
    """How many reads begin with a base that each ambiguity code stands for."""
    first = reads(spark, sf_dir).groupBy(F.substring("seq", 1, 1).alias("base")).agg(F.count("*").alias("n"))
    return first.join(fuzzy.equalities(spark), "base").groupBy("code").agg(F.sum("n").alias("n"))


@query("x7_stalled_sampler", "SELECT least(count(DISTINCT user_id), 20) AS n FROM events")
def stalled(spark, sf_dir):
    """A design of twenty proteins, asked for as many as there are users: it ends when a batch brings none."""
    n = table(spark, sf_dir, "events").select("user_id").distinct().count()
    return expansion.unique_until_stalled(spark, "NNKATG", n).agg(F.count("*").alias("n"))


_V1 = """WITH e AS (SELECT DISTINCT user_id FROM events), t AS (SELECT unnest(range(15, 251, 5)) AS target), r AS (SELECT user_id, target, unnest(range(1, 60)) AS k FROM e, t)"""


@query("x15_uncapped_lengths", f"{_V1} SELECT CAST(target AS INTEGER) AS target_length, count(*) AS n FROM r WHERE 5 * k BETWEEN target - 3 AND target + 3 GROUP BY 1")
def uncapped(spark, sf_dir):
    """Five-residue motifs of each user, repeated to all target lengths from 15 to 250 without a cap."""
    users = table(spark, sf_dir, "events").select("user_id", F.pmod("user_id", F.lit(405)).alias("p")).distinct()
    motifs = expansion.patterned_motifs(users, "p", ["user_id"], 5)
    return expansion.repeats(motifs, "motif", range(15, 251, 5)).groupBy("target_length").agg(F.count("*").alias("n"))
