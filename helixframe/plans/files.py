"""Queries that write derived data in a format and read it back, and queries on streams and through SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helixframe.functions.register import register_functions
from helixframe.functions.table_functions import register_table_functions
from helixframe.operators.graph import written
from helixframe.plans.core import CELLS, READS, SAM, alignment, alignments, query, reads, table
from helixframe.plans.sequences import codons_sql
from helixframe.sources import text
from helixframe.streaming import reads as streams


def place(spark, what: str) -> str:
    """A new path in the shared folder."""
    written(spark.range(0), what)  # the folder exists from now on
    return f"{spark.conf.get('spark.checkpoint.dir')}/{what}-{uuid.uuid4().hex}"


@query("s1_s5_fasta_round_trip", f"WITH {READS} SELECT 'r' || read_id AS name, 'r' || read_id || ' ' || sample AS header, seq FROM reads")
def fasta(spark, sf_dir):
    """Lower-case records wrapped at 25, read in upper case."""
    path = place(spark, "fasta")
    text.write_fasta(reads(spark, sf_dir), path, F.concat(F.lit("r"), "read_id", F.lit(" "), "sample"), F.lower("seq"), 25)
    return text.read_fasta(spark, path, aligned=True)


@query("k2_k3_numbered_fasta", f"WITH {READS} SELECT 'V_' || lpad(CAST(row_number() OVER (ORDER BY seq, read_id) AS VARCHAR), 7, '0') AS name, seq FROM reads")
def numbered_fasta(spark, sf_dir):
    path = place(spark, "fasta")
    text.write_numbered_fasta(reads(spark, sf_dir).select("read_id", "seq"), path, ["seq", "read_id"], "seq", "V", 7)
    return text.read_fasta(spark, path).select("name", "seq")


@query("s6_k9_fastq_round_trip", f"WITH {READS} SELECT read_id || ' ' || sample AS read_id, seq, qual FROM reads")
def fastq(spark, sf_dir):
    path = place(spark, "fastq")
    text.write_fastq(reads(spark, sf_dir).select(F.concat("read_id", F.lit(" "), "sample").alias("read_id"), "seq", "qual"), path)
    return text.read_fastq(spark, path, numbered=False).select("read_id", "seq", "qual")


@query("s8_sam_scan", f"WITH {READS} SELECT 'q' || read_id AS qname, CAST(read_id % 4096 AS INTEGER) AS flag, CAST(100 + read_id % 50 AS INTEGER) AS pos, CAST(read_id % 60 AS INTEGER) AS mapq, '64M' AS cigar, seq FROM reads WHERE read_id % 10 <> 3")
def sam(spark, sf_dir):
    """SAM text with header lines and rows that are too short."""
    path = place(spark, "sam")
    k = F.col("read_id")
    line = F.concat_ws("\t", F.concat(F.lit("q"), k), k % 4096, F.lit("ref"), 100 + k % 50, k % 60, F.lit("64M"), F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual")
    rows = reads(spark, sf_dir).select(F.when(k % 10 == 3, F.concat_ws("\t", F.lit("short"), k)).otherwise(line).alias("value"))
    rows.union(spark.range(1).select(F.lit("@HD\tVN:1.6"))).write.text(path)
    return text.read_sam(spark, path).select("qname", "flag", "pos", "mapq", "cigar", "seq")


@query("s9_s13_tolerant_csv", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind FROM events")
def csv(spark, sf_dir):
    """CSV with comment lines, comments behind values, trailing commas and a column without values; the header stands in one of the files."""
    path = place(spark, "csv")
    rows = table(spark, sf_dir, "events").select(F.concat("event_id", F.lit(","), "event_type", F.when(F.col("event_id") % 2 == 0, ",, # note").otherwise(",,")).alias("value"))
    rows.union(spark.range(1).select(F.explode(F.array(F.lit("# made by hand"), F.lit("id,kind,empty"))))).write.text(path)
    return text.read_csv(spark, path, "anywhere", header="id,kind,empty").select("id", "kind")


@query("s14_k1_metadata", "SELECT 'rows' AS key, CAST(count(*) AS VARCHAR) AS value FROM region UNION ALL SELECT 'largest', CAST(max(r_regionkey) AS VARCHAR) FROM region UNION ALL SELECT 'orders', CAST(count(*) AS VARCHAR) FROM orders")
def metadata(spark, sf_dir):
    path = place(spark, "csv")
    regions = table(spark, sf_dir, "region")
    n, most = regions.agg(F.count("*"), F.max("r_regionkey")).first()
    text.write_csv_with_metadata(regions, path, {"rows": n, "largest": most, "orders": table(spark, sf_dir, "orders").count()})
    return text.read_metadata(spark, f"{path}.metadata")


@query("s15_variant_counts", "SELECT upper('v' || user_id) AS variant, CAST(sum(event_id % 7) AS BIGINT) AS n FROM events GROUP BY 1")
def counts(spark, sf_dir):
    path = place(spark, "csv")
    table(spark, sf_dir, "events").select(F.concat(F.lit(" v"), "user_id").alias("aa_variant"), (F.col("event_id") % 7).alias("count")).write.option("header", True).csv(path)
    return text.read_counts(spark, path)


@query("s19_k6_position_table", f"WITH {CELLS} SELECT sample, pos, aa, CAST(printf('%.1f', 100 * proportion) AS DOUBLE) AS pct FROM profile WHERE sample = 'click' AND rank = 1")
def positions(spark, sf_dir):
    """The position table of one sample, written and parsed back."""
    from helixframe.operators import profiles

    path = place(spark, "tsv")
    p = profiles.proportions(profiles.cells(alignment(spark, sf_dir).filter("sample = 'click'"), "seq", (), "seq_id"))
    text.write_position_table(p, path)
    got = text.read_position_table(spark, path)
    return got.select(F.lit("click").alias("sample"), F.col("position").alias("pos"), F.col("top_aa").alias("aa"), F.element_at("shares", F.col("top_aa")).alias("pct"))


@query("k11_size_chunks", f"""WITH {READS}, c AS (SELECT read_id, sum(length(sample || ',' || seq) + 1) OVER (ORDER BY read_id) AS ended FROM reads) SELECT CAST((ended - 1) // 20000 AS BIGINT) AS chunk, count(*) AS n FROM c GROUP BY 1""")
def chunks(spark, sf_dir):
    got = text.size_chunks(reads(spark, sf_dir).select("read_id", "sample", "seq"), ["read_id"], F.concat_ws(",", "sample", "seq"), 20_000)
    return got.groupBy("chunk").agg(F.count("*").alias("n"))


@query("k12_by_length", "SELECT length(p_name) AS len, p_name AS piece, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1, 2")
def by_length(spark, sf_dir):
    path = place(spark, "lengths")
    text.write_by_length(table(spark, sf_dir, "part").filter("p_name is not null").select(F.col("p_name").alias("piece")), path, "piece")
    return spark.read.parquet(path).groupBy("len", "piece").agg(F.count("*").alias("n"))


@query("sql_functions", f"""WITH {READS} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, {codons_sql('seq', 63)} AS aa, hamming(substr(seq, 1, 30), substr(seq, 31, 30)) AS distance,
round((length(seq) - length(translate(seq, 'GC', ''))) / length(seq), 9) AS gc FROM reads""")  # fmt: skip
def sql_functions(spark, sf_dir):
    """The registered SQL functions, called from SQL."""
    register_functions(spark)
    reads(spark, sf_dir).createOrReplaceTempView("helixframe_reads")
    return spark.sql("SELECT read_id, revcomp(seq) AS rc, translate_dna(seq) AS aa, CAST(hamming(substr(seq, 1, 30), substr(seq, 31, 30)) AS BIGINT) AS distance, round(gc_fraction(seq), 9) AS gc FROM helixframe_reads")


@query("sql_explode_residues", f"WITH {READS}, c AS (SELECT sample, CAST(k AS INTEGER) AS pos, substr(seq, 3 * k - 2, 3) AS codon FROM (SELECT sample, seq, CAST(unnest(range(1, 22)) AS INTEGER) AS k FROM reads)) SELECT sample, pos, codon, count(*) AS n FROM c GROUP BY 1, 2, 3")
def sql_residues(spark, sf_dir):
    """Codons at each place, by a table function beside each row."""
    register_table_functions(spark)
    reads(spark, sf_dir).createOrReplaceTempView("helixframe_reads")
    return spark.sql("SELECT sample, pos, codon, count(*) AS n FROM helixframe_reads, LATERAL explode_residues(seq, 3) GROUP BY sample, pos, codon")


@query("sql_cigar_obs", f"""WITH {SAM} SELECT read_id, CAST(pos + x[1] AS INTEGER) AS ref_pos, CASE WHEN x[2] = 0 THEN '-' ELSE substr(seq, x[2], 1) END AS base,
CAST(CASE WHEN x[2] = 0 THEN 0 WHEN qual = '*' THEN 99 ELSE ascii(substr(qual, x[2], 1)) - 33 END AS INTEGER) AS q FROM walk""")  # fmt: skip
def sql_observations(spark, sf_dir):
    """What alignments show at each position, by a table function over groups of rows."""
    register_table_functions(spark)
    alignments(spark, sf_dir).createOrReplaceTempView("helixframe_alignments")
    return spark.sql("SELECT * FROM cigar_obs(TABLE(helixframe_alignments) PARTITION BY read_id)")


@query("sql_edit_alignment", f"WITH {READS} SELECT read_id, CAST(levenshtein(substr(seq, 1, 24), substr(seq, 3, 24)) AS INTEGER) AS distance, 24 AS in_top, 24 AS in_bottom FROM reads")
def sql_alignments(spark, sf_dir):
    """Alignments in blocks of ten columns, by a table function beside each row: the distance, and what the blocks hold together."""
    register_table_functions(spark)
    reads(spark, sf_dir).createOrReplaceTempView("helixframe_reads")
    letters = lambda c: f"CAST(sum(length(replace({c}, '-', ''))) AS INT)"
    return spark.sql(f"SELECT read_id, max(distance) AS distance, {letters('top')} AS in_top, {letters('bottom')} AS in_bottom FROM helixframe_reads, LATERAL edit_alignment(substr(seq, 1, 24), substr(seq, 3, 24), 10) GROUP BY read_id")


def _streamed(spark, sf_dir, make, mode="append"):
    """A stream over the events, run to its end into a table in the shared folder."""
    schema = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).schema
    out, state = place(spark, "stream"), place(spark, "stream-state")
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as the table may be one file
    q = make(source).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out)


@query("stream_translated_reads", f"WITH {READS}, t AS (SELECT read_id, {codons_sql('seq', 24)} AS aa FROM reads) SELECT read_id, aa FROM t WHERE NOT contains(aa, '*')")
def stream_reads(spark, sf_dir):
    from helixframe.plans.core import BASES, _digits

    rows = lambda s: s.select(F.col("event_id").alias("read_id"), F.substring(_digits("", BASES), 1, 24).alias("seq"))
    return _streamed(spark, sf_dir, lambda s: streams.translated(rows(s)).select("read_id", "aa"))


@query("stream_windowed_counts", """WITH w AS (SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, event_type AS aa, count(*) AS n FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + 3600 <= (SELECT floor(epoch(max(ts))) - 600 FROM events)""")  # fmt: skip
def stream_counts(spark, sf_dir):
    """Events of each type in closed windows; the last windows stay open in append mode."""
    got = _streamed(spark, sf_dir, lambda s: streams.variant_counts(s.withColumn("aa", F.col("event_type")), "ts"))
    return got.withColumn("window_start", F.unix_timestamp("window_start"))


@query("stream_unique_types", "SELECT DISTINCT user_id % 50 AS slot FROM events")
def stream_unique(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: streams.unique_sequences(s.withColumn("slot", F.col("user_id") % 50), "ts", "slot", "10000 days").select("slot"))

