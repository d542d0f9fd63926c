"""Readers of FASTA, FASTQ, SAM and annotated CSV text, and their writers.

Lines keep their order by Spark's own readers: records are cut by a separator
where the format allows it, so that files split and no line numbers are needed.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.columns import fixed
from helixframe.operators.relational import numbered, running_before
from helixframe.sources.fastq import FastqSource
from helixframe.sources.quoted import read_rows


def read_fasta(spark: SparkSession, path: str, upper: bool = True, aligned: bool = False, strict: bool = True) -> DataFrame:
    """name, header, seq: one row a record; wrapped lines are joined, white space and a leading byte-order mark go.

    A record begins at a line's `>`. With `strict`, text before a file's first header
    raises, at the cost of counting headers; else it is a sequence without a header.
    With `aligned`, unequal lengths raise.
    """
    records = _placed(spark.read.option("lineSep", "\n>").text(path))
    text = F.regexp_replace("value", "^\\uFEFF?>?", "")
    if not strict:  # only the first record of a file still has its mark
        first = _firsts(records, F.lit(True))
        bare = (F.col("__id") == F.col("__first")) & ~F.regexp_replace("value", "^\\uFEFF", "").startswith(">")
        records, text = records.join(first, "__file"), F.when(bare, F.concat(F.lit("\n"), text)).otherwise(text)
    lines = records.filter(F.trim("value") != "").select(F.regexp_replace(text, "\r", "").alias("r"))
    if strict:
        headers = spark.read.text(path).filter(F.regexp_replace("value", "^\\uFEFF", "").startswith(">")).count()
        if lines.count() != headers:
            raise ValueError(f"{path} has text before a first header, or a header without a line")
    header = F.trim(F.substring_index("r", "\n", 1))
    body = F.regexp_replace(F.when(F.contains("r", F.lit("\n")), F.substr("r", F.length(F.substring_index("r", "\n", 1)) + 2)).otherwise(""), r"\s", "")
    seq = F.upper(body) if upper else body
    out = lines.select(F.substring_index(F.regexp_replace(header, r"\s", " "), " ", 1).alias("name"), header.alias("header"), seq.alias("seq"))
    if aligned:
        n = out.agg(F.min(F.length("seq")), F.max(F.length("seq")), F.count("*")).first()
        if n[2] == 0 or n[0] != n[1]:
            raise ValueError(f"sequences are not aligned: lengths {n[0]} to {n[1]} in {n[2]} records")
    return out


def _placed(lines: DataFrame) -> DataFrame:
    """value, __file, __block, __id: where each line of text files stands; ids rise within a block."""
    return lines.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))


def _firsts(lines: DataFrame, what: Column) -> DataFrame:
    """__file, __first: the id of the first line of each file (in its first block) that is `what`."""
    return lines.filter(what & (F.col("__block") == 0)).groupBy("__file").agg(F.min("__id").alias("__first"))


def last_by_name(records: DataFrame, order: str) -> DataFrame:
    """One record a name, the last one in an order."""
    return records.groupBy("name").agg(F.max_by("seq", order).alias("seq"))


def write_fasta(df: DataFrame, path: str, header: Column, seq: Column, width: int = 0) -> None:
    """Records as text, wrapped at a width if given."""
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq
    df.select(F.concat(F.lit(">"), header, F.lit("\n"), body).alias("value")).write.text(path)


def write_numbered_fasta(df: DataFrame, path: str, order: Sequence[str], seq: str, prefix: str = "", digits: int = 0) -> None:
    """Records `>1`, `>2`, ... (or `>PREFIX_0001`) in an order."""
    n = F.col("ord") + 1
    label = F.lpad(n.cast("string"), digits, "0") if digits else n.cast("string")
    write_fasta(numbered(df, order), path, F.concat(F.lit(f"{prefix}_" if prefix else ""), label), F.col(seq))


def read_fastq(spark: SparkSession, path: str, numbered: bool = True, range_bytes: int = 64 << 20) -> DataFrame:
    """read_id, seq, qual of FASTQ text, and ord, the record's number in the order of files and lines; without `numbered`, file and at (its first byte) instead.

    The files are read in byte ranges, each of which finds its first record, whatever
    a quality line begins with; no line is shuffled. Numbers need the ranges' counts, one
    row each, and so a pass before. Bad records raise with their file and byte.
    """
    spark.dataSource.register(FastqSource)
    source = spark.read.format("fastq").option("rangeBytes", range_bytes)
    rows = source.load(path)
    if not numbered:
        return rows.select("read_id", "seq", "qual", "file", "at")
    counts = dict(rows.groupBy("range").count().collect())
    firsts = list(accumulate((counts.get(k, 0) for k in range(max(counts, default=-1) + 1)), initial=0))
    return source.option("firsts", json.dumps(firsts)).load(path).select("read_id", "seq", "qual", F.col("number").alias("ord"))


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def count_fastq(spark: SparkSession, path: str) -> int:
    """Reads of a file: lines over four."""
    return spark.read.text(path).count() // 4


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """qname, flag, rname, pos, mapq, cigar, seq, qual of SAM text; header lines and rows of fewer than 11 fields go."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.size(f) >= 11))
    pick = {"qname": (0, "string"), "flag": (1, "int"), "rname": (2, "string"), "pos": (3, "int"), "mapq": (4, "int"), "cigar": (5, "string"), "seq": (9, "string"), "qual": (10, "string")}
    return rows.select(*(F.get(f, F.lit(k)).cast(t).alias(n) for n, (k, t) in pick.items()))


def read_csv(spark: SparkSession, path: str, comments: str = "lines", drop_empty: bool = True, header: str | None = None, multi_line: bool = False, range_bytes: int = 64 << 20) -> DataFrame:
    """CSV of strings with a header, tolerant of metadata.

    The header is the first line of the first file by name, or given for files of
    which some have none; a file's first line that equals it is no row.
    comments: `lines` drops lines whose first visible character is #, `leading` only
    those before a file's first other line, `anywhere` cuts each line at its first #.
    Trailing commas go; columns without a name or (with drop_empty) without any value
    are dropped. With `multi_line`, quoted fields may hold line feeds; each file then
    has its header and is read in ranges of `range_bytes`, and only `lines` is understood.
    """
    if multi_line:
        if comments != "lines" or header is not None:
            raise ValueError("multi_line reads files with their own headers and comment lines")
        found = read_rows(spark, path, range_bytes)
        first = found.groupBy("file").agg(F.min_by("fields", "at").alias("header"), F.min("at").alias("first"))  # a row a file
        top = first.agg(F.min_by("header", "file")).first()[0]
        if top is None:
            raise ValueError(f"{path} has no header")
        names = [n if n.strip() else f"Unnamed: {k}" for k, n in enumerate(top)]
        rows = found.join(F.broadcast(first.select("file", "first")), "file").filter("at > first").select(*(F.get("fields", F.lit(k)).alias(n) for k, n in enumerate(names)))
    else:
        value = F.regexp_replace("value", "^\\uFEFF", "")
        if comments == "anywhere":
            value = F.substring_index(value, "#", 1)
        lines = _placed(spark.read.text(path)).withColumn("value", F.regexp_replace(F.rtrim(value), ",+$", "")).filter(F.ltrim("value") != "")
        noted = F.ltrim("value").startswith("#")
        if comments != "leading":
            lines = lines.filter(~noted)
        placed = lines.join(_firsts(lines, ~noted), "__file", "left")
        top = F.coalesce(F.col("__id") == F.col("__first"), F.lit(False))
        if header is None:
            header = placed.filter(top).agg(F.min_by("value", "__file")).first()[0]
            if header is None:
                raise ValueError(f"{path} has no header")
        names = [n.strip() or f"Unnamed: {k}" for k, n in enumerate(next(csv.reader([header], skipinitialspace=True)))]
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        before = noted & (F.col("__block") == 0) & (F.col("__id") < F.col("__first"))
        keep = ~(top & (F.col("value") == header)) & ~F.coalesce(before, F.lit(False))
        # The value hangs on both sides of the join, so that no filter on it is moved to before this one and sees a header.
        rows = placed.filter(keep).select(F.from_csv(F.when(keep, F.col("value")), F.lit(schema)).alias("r")).select("r.*")
    rows = rows.select(*(F.nullif(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))
    if not drop_empty:
        return rows
    counts = rows.agg(*(F.count(f"`{n}`").alias(str(k)) for k, n in enumerate(names))).first()
    return rows.select(*(F.col(f"`{n}`") for k, n in enumerate(names) if counts[k] and not n.startswith("Unnamed:")))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """key, value of lines such as `# key: value`."""
    rows = spark.read.text(path).filter(F.col("value").rlike(r"^\s*#[^:]*:"))
    key = F.trim(F.regexp_replace(F.substring_index("value", ":", 1), r"^\s*#+", ""))
    return rows.select(key.alias("key"), F.trim(F.regexp_replace("value", "^[^:]*:", "")).alias("value"))


def write_csv_with_metadata(df: DataFrame, path: str, metadata: Mapping[str, object]) -> None:
    """CSV files, and a file of their metadata beside the data, in the comment form that read_metadata takes."""
    df.write.option("header", True).csv(path)
    spark = df.sparkSession
    spark.createDataFrame([(f"# {k}: {v}",) for k, v in metadata.items()], "value string").coalesce(1).write.text(f"{path}.metadata")


def read_counts(spark: SparkSession, path: str, variant: str = "aa_variant", count: str = "count") -> DataFrame:
    """variant, n: trimmed, upper case, repeats added up; blanks, inner white space and counts that are no digits raise."""
    rows = read_csv(spark, path)
    v, n = F.upper(F.trim(F.col(variant))), F.trim(F.col(count))
    good = (v != "") & ~v.rlike(r"\s") & n.rlike(r"^\d+$")
    checked = rows.filter(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit("a variant or count that can't be read"))))
    return checked.groupBy(v.alias("variant")).agg(F.sum(n.cast("long")).alias("n"))


def read_position_table(spark: SparkSession, path: str) -> DataFrame:
    """position, top_aa, shares (residue to percent) of a table with cells such as `A:50.0%, S:25.0%`."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    shares = F.transform_values(F.str_to_map(F.regexp_replace("proportion_breakdown", "[% ]", ""), F.lit(","), F.lit(":")), lambda _, v: v.cast("double"))
    return rows.select(F.col("position").cast("int").alias("position"), "top_aa", shares.alias("shares"))


def write_position_table(profile: DataFrame, path: str) -> None:
    """The table that read_position_table reads, from a profile with ranks."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("rank", "aa", "proportion"))), lambda x: F.concat(x["aa"], F.lit(":"), fixed(100 * x["proportion"], 1), F.lit("%")))
    rows = profile.groupBy(F.col("pos").alias("position")).agg(F.max(F.when(F.col("rank") == 1, F.col("aa"))).alias("top_aa"), F.array_join(said, ", ").alias("proportion_breakdown"))
    rows.write.option("sep", "\t").option("header", True).csv(path)


def read_weights(spark: SparkSession, path: str, n: int) -> DataFrame:
    """position, weight for 1..n: lines of two fields, 1.0 where there is none; positions outside raise."""
    f = F.split(F.trim(F.substring_index("value", "#", 1)), r"\s+")
    rows = spark.read.text(path).filter(F.trim(F.substring_index("value", "#", 1)) != "").select(F.get(f, F.lit(0)).cast("int").alias("position"), F.get(f, F.lit(1)).cast("double").alias("weight"))
    checked = rows.filter(F.when(F.col("position").between(1, n) & (F.col("weight") >= 0), True).otherwise(F.raise_error(F.lit("a position or weight out of range"))))
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("position")).join(checked, "position", "left").na.fill(1.0, ["weight"])


def read_bias(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """Substitution weights of each base, scaled to 1: four bases with three alternatives each."""
    row = spark.read.option("multiLine", True).schema("A map<string,double>, C map<string,double>, G map<string,double>, T map<string,double>").json(path).first()
    out = {}
    for base in "ACGT":
        weights = row[base] or {}
        if set(weights) != set("ACGT") - {base} or min(weights.values()) < 0 or not sum(weights.values()):
            raise ValueError(f"weights of {base} are not three non-negative numbers with a positive sum")
        out[base] = {k: v / sum(weights.values()) for k, v in weights.items()}
    return out


def write_by_length(df: DataFrame, path: str, seq: str) -> None:
    """One folder for each sequence length."""
    df.withColumn("len", F.length(seq)).write.partitionBy("len").parquet(path)


def size_chunks(df: DataFrame, order: Sequence[str], line: Column, most_bytes: int) -> DataFrame:
    """df with `chunk`: consecutive rows in an order whose lines (with their line feeds) stay within a size.

    Chunk numbers follow running sums; a chunk never crosses a multiple of the
    size, so that no row has to wait for all before it.
    """
    rows = running_before(df.withColumn("__b", F.octet_length(line) + 1), order, "__b", "__before")
    return rows.withColumn("chunk", F.floor((F.col("__before") + F.col("__b") - 1) / most_bytes)).drop("__b", "__before")


def read_residues(spark: SparkSession, path: str) -> DataFrame:
    """Residue parameters: one, three, MW, lambdas, sigmas, q, bondlength."""
    return spark.read.option("header", True).schema("one string, three string, MW double, lambdas double, sigmas double, q int, bondlength double").csv(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of input files, for a run's metadata. A file is held whole, so that one beyond 2 GB raises."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def first_record(spark: SparkSession, path: str) -> str:
    """The sequence of the first record of a FASTA file, or of a file of bare text."""
    lines = spark.read.text(path, wholetext=True).first()
    body = (lines["value"] if lines else "").lstrip("\ufeff").strip()
    if body.startswith(">"):
        body = body[1:].split("\n>")[0].partition("\n")[2]
    return "".join(body.split()).upper()


def read_template(spark: SparkSession, path: str) -> str:
    """A template of ACGT alone; several records raise."""
    if spark.read.text(path).filter(F.col("value").startswith(">")).count() > 1:
        raise ValueError(f"{path} has more than one record")
    seq = first_record(spark, path)
    if not seq or set(seq) - set("ACGT"):
        raise ValueError(f"{path} is no plain DNA sequence")
    return seq


def read_sample(spark: SparkSession, path: str, features: Sequence[str], sequence: str = "aa_variant", count: str = "count") -> DataFrame:
    """sequence, n and the features of a sample: rows of a count above 0; a missing column, a blank or infinite number or a filled `error` raises."""
    rows = read_csv(spark, path, drop_empty=False)
    missing = [c for c in (sequence, count, *features) if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    finite = lambda c: F.coalesce(~F.isnan(number(c)) & (F.abs(number(c)) < float("inf")), F.lit(False))
    checks = {"counts": ~F.coalesce(F.col(count).rlike(r"^\d+$"), F.lit(False)), **{c: ~finite(c) for c in features}}
    if "error" in rows.columns:
        checks["error"] = F.coalesce(F.trim("error"), F.lit("")) != ""
    bad = rows.agg(*(F.count_if(f).alias(n) for n, f in checks.items())).first().asDict()
    if any(bad.values()):
        raise ValueError(f"{path} has rows that can't be used: { {k: v for k, v in bad.items() if v} }")
    kept = rows.select(F.upper(F.trim(sequence)).alias("sequence"), F.col(count).cast("long").alias("n"), *(number(c).alias(c) for c in features))
    return kept.filter("n > 0")


def read_clusters(spark: SparkSession, counts: str, traits: str, members: str, samples: Sequence[str]) -> dict[str, DataFrame]:
    """Three tables of one clustering; clusters that one of them lacks, or totals of members that differ from the counts, raise."""
    found = {"counts": read_csv(spark, counts), "traits": read_csv(spark, traits), "members": read_csv(spark, members)}
    sets = [t.select("cluster").distinct() for t in found.values()]
    if any(not a.exceptAll(b).isEmpty() for a in sets for b in sets if a is not b):
        raise ValueError("the tables hold different clusters")
    total = found["members"].groupBy("cluster").agg(*(F.sum(F.col(f"{s}_reads").cast("long")).alias(s) for s in samples))
    said = found["counts"].select("cluster", *(F.col(f"{s}_reads").cast("long").alias(f"__{s}") for s in samples))
    differ = F.lit(False)
    for s in samples:
        differ = differ | (F.col(s) != F.col(f"__{s}"))
    if not total.join(said, "cluster").filter(differ).isEmpty():
        raise ValueError("members don't add up to the counts")
    return found


def write_mutants(df: DataFrame, path: str, order: Sequence[str], sep: str = ",", rate: Column | None = None) -> None:
    """sequence_id (mutant_000001 in an order), mutation_count, mutations (comma between, WT for none), effective_error_rate_per_base, sequence; from mutant, mutations (; between) and n_mutations."""
    name = F.concat(F.lit("mutant_"), F.lpad((F.col("ord") + 1).cast("string"), 6, "0"))
    rows = numbered(df.withColumn("__rate", F.lit(None).cast("double") if rate is None else rate), order)
    rows.select(
        name.alias("sequence_id"), F.col("n_mutations").alias("mutation_count"), F.replace("mutations", F.lit(";"), F.lit(",")).alias("mutations"),
        F.col("__rate").alias("effective_error_rate_per_base"), F.col("mutant").alias("sequence"),
    ).write.option("header", True).option("sep", sep).csv(path)


def write_annotated_table(profile: DataFrame, scores: DataFrame, path: str) -> None:
    """The table of write_position_table with score and z of each position (four decimals) and whether it is a hotspot; scores has pos, score, z, hotspot."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("rank", "aa", "proportion"))), lambda x: F.concat(x["aa"], F.lit(":"), fixed(100 * x["proportion"], 2), F.lit("%")))
    rows = profile.groupBy("pos").agg(F.max(F.when(F.col("rank") == 1, F.col("aa"))).alias("top_aa"), F.array_join(said, ",").alias("proportion_breakdown"))
    four = lambda c: fixed(F.col(c), 4).alias(c)
    rows.join(scores, "pos").select(F.col("pos").alias("position"), "top_aa", "proportion_breakdown", four("score"), four("z"), "hotspot").write.option("sep", "\t").option("header", True).csv(path)


def write_metrics(sections: Mapping[str, DataFrame], path: str) -> None:
    """Counts as text: a title, then a line `label: n` for each row of (label, n) in the order of labels; a file for each section's number."""
    for k, (title, rows) in enumerate(sections.items()):
        lines = rows.orderBy("label").select(F.concat("label", F.lit(": "), F.col("n").cast("string")).alias("value"))
        lines.unionByName(rows.sparkSession.range(1).select(F.lit(title).alias("value"))).write.text(f"{path}/{k:02d}")
