"""Document fingerprints: SimHash, and a search within a Hamming radius by permuted block tables.

Each distinct word of a text has a 64-bit hash and a weight, the root of its
count; its bits vote with that weight for or against each bit of the
fingerprint.

`neighbours` finds all fingerprints within a radius of 3. The 64 bits are cut
into five blocks; three wrong bits leave two blocks intact, so that one of the
ten tables, each keyed by two blocks, brings every such pair together. Equal
fingerprints are one entry with a count, so that copies don't multiply, and a
pair counts in the first table that has it, so that no pairs are deduplicated.

The documents stand in ranges of doc_id, one range a partition, and rows stream
through a task in order; each waits for its successor.

Defined results: a null text counts as empty; a text without words has the
fingerprint 0; the order for the next document is by doc_id, null first, equal
ids by text; a table of one row has itself as next; an empty table gives an
empty result; other columns are not read. Each of repeated rows has a row of its own.
A long text takes a small multiple of its size in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import small, table, word_hashes, written

ROWS_PER_BUCKET = 4000
MOST_BUCKETS = 50_000  # edges that the driver holds; larger tables get larger ranges, which stream
WORDS = 1 << 14  # distinct words that vote at once
SALTS = 16
RADIUS = 3
_LEAST = -(2**63)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    words, first, _ = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((words, of))
    words, of = words[order], of[order]
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(fresh)
    weight = np.sqrt(np.diff(at, append=len(words))).astype(np.float64)
    total = np.zeros((len(texts), 64))
    for a in range(0, len(at), WORDS):
        some = at[a : a + WORDS]
        bits = np.unpackbits(words[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = np.where(bits, weight[a : a + WORDS, None], -weight[a : a + WORDS, None])
        begin = np.flatnonzero(np.diff(of[some], prepend=-1))
        total[of[some][begin]] += np.add.reduceat(votes, begin, axis=0)
    return np.packbits(total > 1e-9, axis=1, bitorder="little").view("<u8").ravel()


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, place, bucket, look: the documents in ranges of doc_id; each range also gets what follows it, marked `look`. And the number of ranges.

    The edges are doc_ids themselves, found from the ids alone, so that texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("place"))
    n, least = rows.agg(F.count("*"), F.min("place")).first()
    parts = max(1, min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET)))
    edges: list[int] = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        edges = sorted({e for e in rows.agg(F.percentile_approx("place", shares, 10 * parts)).first()[0] if e > least})
    bounds = np.array(edges, np.int64)

    @F.pandas_udf("long")
    def bucket(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy(), "right"))

    @F.pandas_udf("boolean")
    def is_edge(place: pd.Series) -> pd.Series:
        return pd.Series(np.isin(place.to_numpy(), bounds))

    own = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("look"))
    before = F.struct((F.col("own") - 1).alias("bucket"), F.lit(True).alias("look"))
    last = F.struct(F.lit(len(edges)).cast("long").alias("bucket"), F.lit(True).alias("look"))
    sent = F.array_compact(F.array(own, F.when(F.col("edge"), before), F.when(F.col("place") == F.lit(least if least is not None else 0), last)))
    placed = rows.select("*", bucket("place").alias("own"), is_edge("place").alias("edge")).select("doc_id", "text", "place", F.explode(sent).alias("to"))
    return placed.select("doc_id", "text", "place", "to.bucket", "to.look"), len(edges) + 1


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / 64


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprints of the text and of its edited text, and likenesses."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range and order, what follows a range last: each row waits for its successor."""
        waiting: list[tuple] = []
        for batch in (part for whole in batches for part in small(whole)):
            rows = waiting + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "look")), strict=True))
            waiting = rows[-1:]
            own = [k for k in range(len(rows) - 1) if not rows[k][3] and rows[k][2] == rows[k + 1][2]]
            if not own:
                continue
            texts, edited = [r[1] for r in rows], []
            for k in own:
                n = len(texts[k]) // 4
                edited.append((texts[k][: len(texts[k]) - n] + texts[k + 1][:n]).encode())
            prints, changed = fingerprints([t.encode() for t in texts]), fingerprints(edited)
            here, then = prints[own], prints[np.array(own) + 1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][0] for k in own], pa.int64()), pa.array([len(texts[k]) for k in own], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array([f"{x:016x}" for x in here.tolist()], pa.string()), pa.array([f"{x:016x}" for x in changed.tolist()], pa.string()), pa.array(_likeness(here, changed)), pa.array(_likeness(here, then)),
                ],
                names,
            )

    rows, n_ranges = with_next(docs)
    ordered = rows.repartitionById(n_ranges, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "look", "place", "text").select("doc_id", "text", "bucket", "look")
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_BLOCKS = [((1 << 13) - 1) << k for k in (0, 13, 26, 39)] + [((1 << 12) - 1) << 52]
_TABLES = [a | b for a, b in combinations(_BLOCKS, 2)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """print, n_near: for each distinct print (long) of queries, how many rows of prints are within the radius (its own rows included)."""
    if radius > RADIUS:
        raise ValueError(f"the tables guarantee radii up to {RADIUS}")
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("print").bitwiseAND(_signed(m)).alias("key")) for t, m in enumerate(_TABLES)))).alias("k")
    entries = prints.groupBy("print").agg(F.count("*").alias("n")).select("print", "n", keys).select(F.col("print").alias("other"), "n", "k.t", "k.key")
    asked = queries.select("print").distinct().select("print", keys).select("print", "k.t", "k.key")
    differ = F.col("print").bitwiseXOR(F.col("other"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(_signed(m)) == 0, t) for t, m in enumerate(_TABLES)))
    pairs = asked.join(entries, ["t", "key"]).filter((F.bit_count(differ) <= radius) & (first == F.col("t")))
    return pairs.groupBy("print").agg(F.sum("n").alias("n_near"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: for each doc_id divisible by 20, other documents within the radius (else null)."""
    rows = written(fingerprinted(table(spark, sf_dir, "documents")), "simhash")
    high, low = (F.conv(F.substring("fingerprint", k, 8), 16, 10).cast("long") for k in (1, 9))
    rows = rows.withColumn("print", F.shiftleft(high, 32).bitwiseOR(low))
    asked = rows.filter("doc_id % 20 = 0")
    others = rows.filter("doc_id is null or doc_id % 20 <> 0").withColumn("n_near", F.lit(None).cast("long"))
    # By fingerprint, of which neighbours() has one row each: a doc_id may repeat, with other texts. Salted, as copies share one.
    near = neighbours(rows, asked).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    counted = asked.withColumn("salt", salt).join(near, ["print", "salt"]).withColumn("n_near", F.col("n_near") - 1)
    return others.unionByName(counted.select(*others.columns)).drop("print")
