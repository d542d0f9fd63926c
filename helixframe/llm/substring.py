"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is all that documents with smaller ids hold. It is
indexed in blocks by content: of every `WINDOW` words in a row, the run of `RUN`
words with the least hash is an anchor, so that equal windows have equal anchors
at equal places; an anchor's hash tells its block, and the block keeps where the
anchor stands first (least doc_id). Anchors follow each other at most `RUN`
words apart, so that anchors in a row cover their text without a gap.

A document is factored greedily against all blocks: its factor is the longest
chain of anchors that stand at the same distances in one earlier document, and so
a run of words that the earlier document holds too. Factors of `WINDOW` words or
more are duplicate spans at once.

At the boundaries of factors - where a chain ends, or turns to another
reference - an anchor's first place need not show all windows that earlier
documents share. The windows of these anchors are compared whole: they get a
128-bit hash, whose least doc_id is found by aggregation over these windows of
all documents (an anchor's first holders, and whoever has the anchor at a
boundary). A window's first holder is always among them: it can't lie within a
factor of a document that has no earlier one.

Nothing multiplies: every step is linear in the anchors, frequent anchors are
combined before they are shuffled, and their lookups are broadcast (a key with
more than one in `SHARES` of all rows, so that there are at most so many).

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Two windows count as equal if their
128-bit hashes do, two factors if all their 64-bit anchors (two at least) do.

Defined results: a null or blank text has no words, and the hash of the empty
string; a row with a null doc_id keeps all its words and is no reference; rows of
one doc_id are no references for each other, and repeated rows have equal
results; an empty table gives an empty result; other columns are not read by
`parsed` and pass through `cleaned`, whatever their names. A long text takes a
small multiple of its size in memory, as windows are hashed in slices.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import SLICE, mixed, shielded, small, table, utf8, word_hashes, written

WINDOW = 50
RUN = 26
NEAREST = WINDOW - RUN + 1  # runs in a window; not above RUN
SHARES = 100_000
_PIECE = 1 << 20  # bytes of a text that are split into words at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _runs(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of `size` words, by doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, width = None, 0, mixed(hashes + np.uint64(seed)), 1
    while True:
        if size & width:
            out = power[:n] if out is None else mixed(out + np.uint64(3) * power[done : done + n])
            done += width
        if done == size:
            return out
        power = mixed(power[: len(power) - width] + np.uint64(5) * power[width:])
        width *= 2


def _least_places(values: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` values the place of its first least one, by doubling."""
    value, place, width = values, np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        later = value[step:] < value[: len(value) - step]
        value = np.where(later, value[step:], value[: len(value) - step])
        place = np.where(later, place[step:], place[: len(place) - step])
        width += step
    return place


def window_anchors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text's windows: first window, the place of each window's anchor, the hashes of runs from the slice's first word on, the slice's words."""
    n = len(words) - WINDOW + 1
    for a in range(0, n, SLICE):
        part = words[a : min(a + SLICE, n) + WINDOW - 1]
        runs = _runs(part, RUN)
        yield a, _least_places(runs, NEAREST) + a, runs, part


def _texts(part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) of the texts of a batch that have a window."""
    words, first, _ = word_hashes([t or b"" for t in utf8(part.column("text"))], lower=False)
    for k in np.flatnonzero(np.diff(first) >= WINDOW).tolist():
        yield k, words[first[k] : first[k + 1]]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text: a row's text is known by both."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, at (a word), anchor: the anchors of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                rows, places, found = [], [], []
                for k, words in _texts(part):
                    last = -1
                    for a, place, runs, _ in window_anchors(words):
                        place = np.unique(place)
                        place = place[place > last]  # a slice may begin with the anchor that the last one ended with
                        if len(place):
                            last = place[-1]
                            rows.append(np.full(len(place), k))
                            places.append(place.astype(np.int32))
                            found.append(runs[place - a].view(np.int64))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(places)), pa.array(np.concatenate(found))], ["doc_id", "text_hash", "at", "anchor"])

    return _keyed(docs).filter("doc_id is not null").mapInArrow(run, "doc_id long, text_hash long, at int, anchor long")


def looked_up(rows: DataFrame, few: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows join few, which has one row a key and the number `n` of its rows; the few frequent keys are broadcast."""
    frequent = F.col("n") * SHARES > total
    hot = F.broadcast(few.filter(frequent).drop("n"))  # at most SHARES rows, as their n add up to total
    cold = few.filter(~frequent).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def parses(found: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, until, anchor: the greedy parse of each text by its anchors' first places.

    A row with `until` is a factor of WINDOW words or more (anchor is null); one
    without is an anchor whose windows aren't all within such a factor.
    """
    names, columns = ["doc_id", "text_hash", "at", "until", "anchor"], found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def parsed(t: pa.Table) -> pa.RecordBatch:
            doc, text, at, anchor, ref, ref_text, ref_at = (t.column(c).to_numpy() for c in columns)
            fresh = np.ones(len(at), bool)  # a repeated row has each anchor twice
            fresh[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
            doc, text, at, anchor, ref, ref_text, ref_at = (x[fresh] for x in (doc, text, at, anchor, ref, ref_text, ref_at))
            chained = np.zeros(len(at), bool)
            chained[1:] = (doc[1:] == doc[:-1]) & (text[1:] == text[:-1]) & (ref[1:] == ref[:-1]) & (ref_text[1:] == ref_text[:-1]) & (np.diff(at) == np.diff(ref_at)) & (np.diff(at) <= RUN)
            begin = np.flatnonzero(~chained)
            end = np.append(begin[1:], len(at))
            of = np.repeat(np.arange(len(begin)), end - begin)
            start, until = at[begin], at[end - 1] + RUN
            long = until - start >= WINDOW
            within = long[of] & (np.maximum(at - (WINDOW - RUN), 0) >= start[of]) & (at + WINDOW <= until[of])
            left = ~within
            none = np.full(int(long.sum()), 0, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([doc[begin][long], doc[left]])), pa.array(np.concatenate([text[begin][long], text[left]])), pa.array(np.concatenate([start[long], at[left]])),
                    pa.array(np.concatenate([until[long], np.zeros(int(left.sum()), np.int32)]).astype(np.int32)), pa.array(np.concatenate([none, anchor[left]])),
                ],
                names,
            )

        for batch in batches:
            now = pa.Table.from_batches([batch])
            if kept is not None:
                now = pa.concat_tables([kept, now])
            if not now.num_rows:
                continue
            doc, text = now.column("doc_id").to_numpy(), now.column("text_hash").to_numpy()
            whole = int(np.flatnonzero((doc != doc[-1]) | (text != text[-1])).max(initial=-1)) + 1  # the last text may go on
            if whole:
                yield parsed(now.slice(0, whole))
            kept = now.slice(whole)
        if kept is not None and kept.num_rows:
            yield parsed(kept)

    by = ["doc_id", "text_hash"]
    rows = found.repartition(*by).sortWithinPartitions(*by, "at").mapInArrow(run, "doc_id long, text_hash long, at int, until int, anchor long")
    return rows.select(*by, "at", F.expr("nullif(until, 0)").alias("until"), F.expr("if(until = 0, anchor, null)").alias("anchor"))


def windows(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, high, low: the windows of given anchors (doc_id, text_hash, at), by 128-bit hash."""
    listed = places.groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text")).agg(F.collect_set("at").alias("places"))
    rows = _keyed(docs).join(listed, (F.col("doc_id") == F.col("__doc")) & (F.col("text_hash") == F.col("__text"))).select("doc_id", "text_hash", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                for k, words in _texts(part):
                    wanted = np.sort(part.column("places")[k].values.to_numpy(zero_copy_only=False))
                    for a, place, _, own in window_anchors(words):
                        at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, place), len(wanted) - 1)] == place)
                        if len(at):
                            high, low = (_runs(own, WINDOW, seed)[at].view(np.int64) for seed in (1, 2))
                            same = [pa.array(np.full(len(at), part.column(c)[k].as_py(), np.int64)) for c in (0, 1)]
                            yield pa.RecordBatch.from_arrays([*same, pa.array((at + a).astype(np.int32)), pa.array(high), pa.array(low)], ["doc_id", "text_hash", "at", "high", "low"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, at int, high long, low long")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, at, until: runs of words whose windows an earlier document holds; they may overlap."""
    every = written(anchors(docs), "anchors")
    total = every.count()
    first = F.min(F.struct("doc_id", "text_hash", "at"))
    shared = every.groupBy("anchor").agg(first.alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first.doc_id < last")
    shared = written(shared.select("anchor", "n", F.col("first.doc_id").alias("ref"), F.col("first.text_hash").alias("ref_text"), F.col("first.at").alias("ref_at")), "reference-blocks")
    columns = ["doc_id", "text_hash", "at", "anchor", "ref", "ref_text", "ref_at"]
    held = written(looked_up(every, shared, ["anchor"], total).select(*columns), "held-anchors")
    parse = written(parses(held.filter("ref < doc_id")), "parse")
    open_ = parse.filter("until is null")
    asked = open_.select("anchor").distinct()
    holders = held.filter("ref = doc_id").join(asked, "anchor", "left_semi")
    places = open_.select("doc_id", "text_hash", "at").union(holders.select("doc_id", "text_hash", "at"))
    whole = written(windows(docs, places), "boundary-windows")
    both = ["high", "low"]
    least = whole.groupBy(*both).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("least < last").drop("last")
    again = looked_up(whole, written(least, "shared-windows"), both, whole.count()).filter("least < doc_id")
    factors = parse.filter("until is not null").select("doc_id", "text_hash", "at", "until")
    return factors.union(again.select("doc_id", "text_hash", "at", (F.col("at") + WINDOW).alias("until")))


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs with `__spans`, an array of (at, until) or null."""
    listed = spans(docs).groupBy(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__text")).agg(F.array_sort(F.collect_set(F.struct("at", "until"))).alias("__spans"))
    return docs.join(listed, (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64("text") == F.col("__text")), "left").drop("__doc", "__text")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of some `_PIECE` bytes at once."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def kept_words(text: bytes | None, removed: list[tuple[int, int]]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, those that stay) of each piece of a text. removed: sorted spans of words."""
    merged: list[list[int]] = []
    for a, b in removed:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    at = k = 0
    for words in _pieces(text or b""):
        end, kept, here = at + len(words), [], at
        while k < len(merged) and merged[k][0] < end:
            kept += words[here - at : max(merged[k][0], here) - at]
            here = max(here, min(merged[k][1], end))
            if merged[k][1] > end:
                break
            k += 1
        kept += words[here - at :]
        yield len(words), kept
        at = end


def _removed(part: pa.RecordBatch, k: int) -> list[tuple[int, int]]:
    return [(s["at"], s["until"]) for s in part.column("__spans")[k].as_py() or ()]


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words, joined by one space."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                made = []
                for k, text in enumerate(utf8(part.column("text"))):
                    total, left, digest = 0, 0, hashlib.sha256()
                    for n, kept in kept_words(text, _removed(part, k)):
                        if left and kept:
                            digest.update(b" ")
                        digest.update(b" ".join(kept))
                        total, left = total + n, left + len(kept)
                    made.append((total, total - left, digest.hexdigest()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x) for x in zip(*made, strict=True))], names)

    return _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with their duplicate spans gone from the text, whose other words are joined by one space; a text without such spans and a null stay. The columns stay."""
    own, back = shielded(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                texts = utf8(part.column("text"))
                for k in np.flatnonzero(part.column("__spans").is_valid().to_numpy(zero_copy_only=False)).tolist():
                    texts[k] = b" ".join(w for _, kept in kept_words(texts[k], _removed(part, k)) for w in kept)
                place = part.schema.get_field_index("text")
                columns = list(part.columns)
                columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(columns[:-1], part.schema.names[:-1])

    return back(_with_spans(own).mapInArrow(run, own.schema))


def op13_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + {WINDOW - 1}), ' ')) AS window_hash
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM words WHERE len(w) >= {WINDOW})
), gone AS (
  SELECT DISTINCT doc_id, s + o.i AS pos
  FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY window_hash) AS least FROM windows), range(0, {WINDOW}) o(i)
  WHERE least < doc_id
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
