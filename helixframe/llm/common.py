"""What the operators share: tables, cut lineage, batches of bounded bytes, vectorised hashing of words and shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from helixframe.operators.graph import written

__all__ = ["SLICE", "distinct_sets", "mixed", "shielded", "shingle_hashes", "small", "table", "utf8", "word_hashes", "written"]

SLICE = 1 << 18  # bytes of text that are worked on at once; a multiple of 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def small(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of some `most` bytes of text, so that what a task needs beside the batch is bounded."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size // most)) + 1):
        if len(rows):
            yield batch.slice(rows[0], len(rows))


def shielded(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but `used` named by position, so that none clashes with an operator's own, and what gives names and order back."""
    own = [c if c in used else f"_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*own), lambda df: df.select(*own).toDF(*docs.columns)


# Bytes that separate words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(raw: np.ndarray, at: np.ndarray, left: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A mixed integer for the (up to) eight bytes at each `at`, that also depends on their place in the word."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    part = np.lib.stride_tricks.sliding_window_view(padded, 8)[at].view("<u8").ravel()
    short = np.minimum(left, 8).astype(np.uint64)
    part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short)
    return mixed(part ^ mixed(place.astype(np.uint64)))


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of bytes that end with a space."""
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True))
    start, length = edge[0::2], edge[1::2] - edge[0::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    many = length + 7 >> 3
    first = np.cumsum(many) - many
    place = np.arange(many.sum()) - np.repeat(first, many)
    parts = _eights(raw, np.repeat(start, many) + 8 * place, np.repeat(length, many) - 8 * place, place)
    return mixed(np.add.reduceat(parts, first) + length.astype(np.uint64)), start


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, each text's first word (one more entry closes it), and where the words start.

    Starts count the bytes of the texts joined with one byte between them.

    A word's hash depends on its bytes and its length alone: it mixes the sum of
    its mixed runs of eight bytes. The bytes are worked on in slices that end
    between words; a word that is longer than a slice is summed up by itself.
    """
    whole = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(whole):
        raw = whole[at : at + SLICE]
        raw = _LOWER[raw] if lower else raw
        gaps = np.flatnonzero(_SPACE[raw])
        if len(gaps):
            raw = raw[: gaps[-1] + 1]
            found, start = _hashed(raw)
            hashes.append(found)
            starts.append(start + at)
            at += len(raw)
            continue
        begin, total = at, np.uint64(0)
        while True:
            raw = whole[at : at + SLICE]
            raw = _LOWER[raw] if lower else raw
            gap = _SPACE[raw]
            end = int(gap.argmax()) if gap.any() else len(raw)
            k = np.arange(0, end, 8)
            total = (np.array([total]) + _eights(raw, k, end - k, (k + at - begin) // 8).sum(dtype=np.uint64))[0]
            at += end
            if end < len(raw):
                break
        hashes.append(mixed(np.array([total]) + np.uint64(at - begin)))
        starts.append(np.array([begin]))
    start = np.concatenate(starts)
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return np.concatenate(hashes), np.searchsorted(start, begins), start


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of each text; a shorter text is one run; a text without words has none.

    Returns the hashes in order and each text's first one, closed by one more entry.
    """
    words, first, _ = word_hashes(texts)
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(begin[-1], np.uint64)
    for a in range(0, len(out), SLICE):
        now = np.arange(a, min(a + SLICE, len(out)))
        of = np.searchsorted(begin, now, "right") - 1
        at, last = now - begin[of] + first[of], first[of + 1]
        got = np.zeros(len(now), np.uint64)
        for k in range(size):
            there = at + k < last
            got = np.where(there, mixed(got ^ words[np.minimum(at + k, len(words) - 1)]) + np.uint64(k + 1), got)
        out[a : a + SLICE] = got
    return out, begin


def distinct_sets(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats."""
    if len(begin) == 2:
        hashes = np.unique(hashes)
        return hashes, np.array([0, len(hashes)])
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[fresh], of[fresh]
    return hashes, np.searchsorted(of, np.arange(len(begin)))
