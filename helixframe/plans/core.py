"""Registration, and the inputs that both engines derive alike from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HEX = "0123456789abcdef"
BASES = "ACGTACGTACGTACGT"
PHRED = "#%&*+.29:;=?ADGI"
RESIDUES_1 = "ACDEFGHIKLMNPQRS"
RESIDUES_2 = "TVWYACDEKRGSPLNH"
ALIGNED = "AAAAGGSSTKRE-X.D"


def query(name: str, sql: str | None = None):
    """Register a query under its name, with the DuckDB SQL for the same rows if SQL can express it."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK = 25_000  # rows of a task, about


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, and in tasks of about TASK rows: files are cut by bytes and at row groups, so that few or uneven tasks would hold all work on rows."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK))  # the files' footers tell
    return df.repartition(n)


def _digits(salt: str, to: str) -> Column:
    return F.translate(F.md5(F.concat(F.lit(salt), F.col("event_id").cast("string"))), HEX, to)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, sample, user_id, seq (64 bases), qual: a sequencing read for each event."""
    return spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")).select(
        F.col("event_id").alias("read_id"), F.col("event_type").alias("sample"), "user_id", F.concat(_digits("", BASES), _digits("s", BASES)).alias("seq"), F.concat(_digits("q", PHRED), _digits("r", PHRED)).alias("qual")
    )


def substituted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, sample, seq: 64 bases of the read's user, with one base changed in a quarter of the reads and two in another."""
    seq = F.concat(*(F.translate(F.md5(F.concat(F.lit(k), F.col("user_id").cast("string"))), HEX, BASES) for k in "hi"))

    def changed(s: Column, step: int) -> Column:
        at = (1 + F.pmod(F.col("event_id") * step, F.lit(64))).cast("int")
        return F.overlay(s, F.translate(F.substr(s, at, F.lit(1)), "ACGT", "CGTA"), at, F.lit(1))

    k = F.pmod("event_id", F.lit(4))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").withColumn("s", seq)
    rows = rows.withColumn("s", F.when(k >= 2, changed(F.col("s"), 7919)).otherwise(F.col("s")))
    return rows.select(F.col("event_id").alias("read_id"), F.col("event_type").alias("sample"), F.when(k == 3, changed(F.col("s"), 104_729)).otherwise(F.col("s")).alias("seq"))


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """protein_id, sample, user_id, value, seq (64 residues of all 20)."""
    return spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")).select(F.col("event_id").alias("protein_id"), F.col("event_type").alias("sample"), "user_id", "value", F.concat(_digits("p", RESIDUES_1), _digits("t", RESIDUES_2)).alias("seq"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, sample, seq: 12 aligned residues with gaps (- and .) and unknowns (X)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq_id"), F.col("event_type").alias("sample"), F.substring(_digits("m", ALIGNED), 1, 12).alias("seq"))


def variant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, variant, n: events of each user in each type."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sample"), F.col("user_id").alias("variant")).agg(F.count("*").alias("n"))


def _sql_digits(salt: str, to: str) -> str:
    return f"translate(md5('{salt}' || CAST(event_id AS VARCHAR)), '{HEX}', '{to}')"


READS = f"""reads AS (
  SELECT event_id AS read_id, event_type AS sample, user_id, {_sql_digits('', BASES)} || {_sql_digits('s', BASES)} AS seq,
         {_sql_digits('q', PHRED)} || {_sql_digits('r', PHRED)} AS qual FROM events)"""
_AT = "CAST(1 + (event_id * {}) % 64 AS INTEGER)"
_CHANGED = "substr({s}, 1, {at} - 1) || translate(substr({s}, {at}, 1), 'ACGT', 'CGTA') || substr({s}, {at} + 1)"
SUBSTITUTED = f"""substituted AS (
  SELECT event_id AS read_id, event_type AS sample, CASE WHEN event_id % 4 = 3 THEN {_CHANGED.format(s='s1', at=_AT.format(104729))} ELSE s1 END AS seq
  FROM (SELECT *, CASE WHEN event_id % 4 >= 2 THEN {_CHANGED.format(s='s', at=_AT.format(7919))} ELSE s END AS s1
        FROM (SELECT *, translate(md5('h' || CAST(user_id AS VARCHAR)) || md5('i' || CAST(user_id AS VARCHAR)), '{HEX}', '{BASES}') AS s FROM events)))"""
PROTEINS = f"""proteins AS (
  SELECT event_id AS protein_id, event_type AS sample, user_id, value, {_sql_digits('p', RESIDUES_1)} || {_sql_digits('t', RESIDUES_2)} AS seq FROM events)"""
ALIGNMENT = f"""alignment AS (SELECT event_id AS seq_id, event_type AS sample, substr({_sql_digits('m', ALIGNED)}, 1, 12) AS seq FROM events)"""
COUNTS = "counts AS (SELECT event_type AS sample, user_id AS variant, count(*) AS n FROM events GROUP BY 1, 2)"
#: cells(sample, pos, aa, n): what stands at each position of the alignment.
CELLS = f"""{ALIGNMENT}, cells AS (
  SELECT sample, CAST(pos AS INTEGER) AS pos, aa, count(*) AS n, min(seq_id) AS first_seen
  FROM (SELECT seq_id, sample, unnest(range(1, 13)) AS pos, unnest(string_split(seq, '')) AS aa FROM alignment) GROUP BY 1, 2, 3),
profile AS (
  SELECT *, sum(n) OVER (PARTITION BY sample, pos) AS total, n / sum(n) OVER (PARTITION BY sample, pos) AS proportion,
         row_number() OVER (PARTITION BY sample, pos ORDER BY n DESC, first_seen, aa) AS rank
  FROM cells WHERE aa NOT IN ('-', '.', 'X', 'x'))"""


#: Alignments of the first bases of each read, and the place of each reference position (from the start) in the read (from 1; 0: deleted).
SAM = f"""{READS}, sam AS (SELECT read_id, 100 + read_id % 50 AS pos, CASE read_id % 3 WHEN 0 THEN '2S4M1D3M' WHEN 1 THEN '5M2I3M' ELSE '10M' END AS cigar, substr(seq, 1, 10) AS seq, CASE WHEN read_id % 9 = 0 THEN '*' ELSE substr(qual, 1, 10) END AS qual FROM reads),
walk AS (SELECT *, unnest(CASE read_id % 3 WHEN 0 THEN [(0, 3), (1, 4), (2, 5), (3, 6), (4, 0), (5, 7), (6, 8), (7, 9)] WHEN 1 THEN [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 8), (6, 9), (7, 10)] ELSE list_transform(range(0, 10), lambda i: (i, i + 1)) END) AS x FROM sam)"""


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_id, pos, cigar, seq (10 bases), qual (`*` for some)."""
    k = F.col("read_id")
    cigar = F.when(k % 3 == 0, "2S4M1D3M").when(k % 3 == 1, "5M2I3M").otherwise("10M")
    return reads(spark, sf_dir).select("read_id", (100 + k % 50).cast("int").alias("pos"), cigar.alias("cigar"), F.substring("seq", 1, 10).alias("seq"), F.when(k % 9 == 0, "*").otherwise(F.substring("qual", 1, 10)).alias("qual"))


def r9(c: Column | str) -> Column:
    """Nine decimals: sums of doubles differ in their last bits between engines and partitionings."""
    return F.round(F.col(c) if isinstance(c, str) else c, 9) + F.lit(0.0)  # no negative zero


def count_sql(letters: str, of: str = "seq") -> str:
    return f"(length({of}) - length(translate({of}, '{letters}', '')))"
