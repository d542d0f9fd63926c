"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites (column `source`) is kept for each line hash;
partial sketches merge by aggregation, so that a line of a third of all rows
costs one small sketch a task. Lines whose estimate is clearly below or above
`min_sites` are decided by it; those within `band` of it get an exact distinct
count. A line that reaches `min_sites` sites is boilerplate: it goes from every
document but the one with the smallest doc_id that holds it.

A line is what stands between two line feeds, compared without outer spaces;
blank lines are never boilerplate. Defined results: a null text stays null; a
null site counts for nothing; a row with a null doc_id is left as it is;
repeated rows are each cleaned; rows of one doc_id count as one document, so that
ties for the smallest doc_id are no ties; an empty table gives an empty result;
other columns pass through `clean` untouched, whatever their names. A long text
takes a small multiple of its size in memory, for its lines and their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import shielded, table, written

MIN_SITES = 10
BROADCAST_ROWS = 250_000  # of 16 bytes


def _hashes(text: F.Column) -> F.Column:
    return F.transform(F.split(text, "\n"), lambda x: F.xxhash64(F.trim(x)))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = 0.25, lg_k: int = 12) -> DataFrame:
    """line (its hash) and first_doc of every line that stands on at least min_sites sites."""
    lines = docs.filter("doc_id is not null").select("doc_id", F.col("source").alias("site"), F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line"))
    lines = lines.select("doc_id", "site", F.xxhash64(F.trim("line")).alias("line"))
    often = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch")).filter(F.col("n") >= min_sites)
    spread = written(often.select("line", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - band)), "line-spread")
    clear = spread.filter(F.col("sites") >= min_sites * (1 + band)).select("line", "first_doc")
    near = spread.filter(F.col("sites") < min_sites * (1 + band)).select("line", "first_doc")
    if near.count() <= BROADCAST_ROWS:
        exact = lines.select("line", "site").join(F.broadcast(near), "line").distinct()
    else:
        exact = lines.select("line", "site").distinct().join(near, "line")  # distinct first: no line then has more rows than sites
    exact = exact.groupBy("line", "first_doc").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites).select("line", "first_doc")
    return clear.unionByName(exact)


def clean(docs: DataFrame, min_sites: int = MIN_SITES, salts: int = 16) -> DataFrame:
    """docs with boilerplate lines taken from `text`; the columns stay."""
    own, back = shielded(docs, "doc_id", "source", "text")
    found = written(boilerplate(own, min_sites), "boilerplate")
    lines = own.filter("doc_id is not null").select("doc_id", F.explode(F.array_distinct(_hashes(F.col("text")))).alias("line"))
    if found.count() <= BROADCAST_ROWS:
        held = lines.join(F.broadcast(found), "line")
    else:
        lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        held = lines.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["line", "salt"])
    gone = held.filter("doc_id <> first_doc").groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("line").alias("__gone"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__gone", F.xxhash64(F.trim(x)))), "\n")
    out = own.join(gone, F.col("doc_id") == F.col("__doc"), "left").withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept))
    return back(out)


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_kept (lines of the cleaned text; an empty text is one line, a null text none), n_chars and the SHA-256 of the cleaned text."""
    n_lines = F.coalesce(F.array_size(F.split("text", "\n")), F.lit(0)).cast("long")
    done = clean(docs.select("doc_id", "source", "text", n_lines.alias("n_lines")), min_sites)
    return done.select("doc_id", "n_lines", n_lines.alias("n_kept"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("clean_sha256"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), spread AS (
  SELECT trim(line) AS line, min(doc_id) AS first_doc FROM lines
  WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN spread s ON trim(l.line) = s.line
  WHERE s.line IS NULL OR l.doc_id = s.first_doc GROUP BY 1
), cleaned AS (
  SELECT d.doc_id, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines, coalesce(k.text, '') AS text
  FROM documents d LEFT JOIN kept k USING (doc_id)
)
SELECT doc_id, n_lines, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_kept,
       CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS clean_sha256
FROM cleaned
"""
