"""Byte-level BPE: encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The leaves of a word's tree hold `rank * width + position` of the pair that
begins at each symbol, inner nodes the least of their two children. The root is
then the leftmost pair of the lowest rank. Merging it changes three leaves - the
pair itself, its left neighbour and the symbol that vanished - each repaired in
logarithmic time, until the root is empty. Short words take that walk together,
one NumPy step for all words of a batch; long ones walk alone.

Words repeat, so that each worker keeps the ids of those it has met, in two
halves of about `CACHE` words. The ids depend on the text alone.

Defined results: a null text counts as empty and has no tokens; the special
token's string in a text is the special token, as the tokenizers library has
it; equal rows have equal results; an empty table gives an empty result; other
columns are not read. A long text is worked on in pieces that end between words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from helixframe.llm.common import table

CACHE = 200_000
SHORT = 32
SLICE = 1_000_000  # characters or ids that are worked on at once
_NONE = np.iinfo(np.int32).max

# White space as the published pattern has it (Unicode's White_Space).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Chunks: a run of anything but white space, with the one space before it; else white space.
CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The published pattern's words; within a chunk none of them crosses white space.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if visible, else the next one from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """A byte-level BPE vocabulary, read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level files with the published word pattern and without a normalizer are read")
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("the model has an option that isn't read")
        if any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("an added token has an option that isn't read")
        alphabet = _byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.first = np.array([vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(pairs)
        self._pairs, self._ranks = pairs[order], order.astype(np.int32)
        self.rank = dict(zip(pairs.tolist(), range(len(pairs)), strict=True))
        pair = self.first.astype(np.int64)
        self._byte_pairs = np.array([self.rank.get(int(k), _NONE) for k in ((pair[:, None] << 20) | pair[None]).ravel()], np.int32)  # by 256 * byte + next byte
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or _NONE; a symbol below 0 makes no pair."""
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where((a >= 0) & (b >= 0) & (self._pairs[at] == key), self._ranks[at], _NONE)

    def short_words(self, joined: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[bytes, list[int]]:
        """The ids, as bytes of int32 one after the other, and the ends, of words of at most `width` bytes (a power of two), merged in step.

        A word is `size` bytes from `start` on in `joined`.
        """
        n = len(size)
        inside = np.arange(width) < size[:, None]
        raw = joined[np.minimum(start[:, None] + np.arange(width), len(joined) - 1)]
        symbols = np.full((n, width + 1), -1, np.int32)
        symbols[:, :width] = np.where(inside, self.first[raw], -1)
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int32)

        def leaf(ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(ranks == _NONE, _NONE, ranks * width + at)

        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self._byte_pairs[raw[:, :-1].astype(np.int32) * 256 + raw[:, 1:]], _NONE)
        tree[:, width:] = leaf(ranks, np.arange(width, dtype=np.int32))
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[row, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.arange(n)
        while len(row := row[tree[row, 1] != _NONE]):
            least = tree[row, 1]
            at, rank = least % width, least // width
            gone = after[row, at]
            then = after[row, gone]
            symbols[row, at] = self.made[rank]
            symbols[row, gone] = -1
            after[row, at] = then
            before[row, np.minimum(then, width)] = at
            put(row, gone, np.full(len(row), _NONE, np.int32))
            put(row, at, leaf(self._rank_of(symbols[row, at], symbols[row, np.minimum(then, width)]), at))
            has = np.flatnonzero(before[row, at] >= 0)
            if len(has):
                r, left = row[has], before[row[has], at[has]]
                put(r, left, leaf(self._rank_of(symbols[r, left], symbols[r, at[has]]), left))
        alive = symbols[:, :width] >= 0
        return symbols[:, :width][alive].tobytes(), (4 * np.cumsum(alive.sum(axis=1))).tolist()

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of int32."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        joined = np.frombuffer(b"".join(words) or b"\0", np.uint8)
        least = 0
        for width in (8, 16, SHORT):
            some = np.flatnonzero((size > least) & (size <= width))
            least = width
            for k in range(0, len(some), 10_000):
                part = some[k : k + 10_000]
                flat, ends = self.short_words(joined, start[part], size[part], width)
                at = 0
                for i, end in zip(part.tolist(), ends, strict=True):
                    out[i] = flat[at:end]
                    at = end
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = self.long_word(words[i]).tobytes()
        return out

    def long_word(self, word: bytes) -> np.ndarray:
        """The ids of one word of any length."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        symbols = self.first[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = 1 << 62
        rank = self.rank
        tree = [none] * (2 * width)

        def pair(i: int, j: int) -> int:
            found = rank.get((symbols[i] << 20) | symbols[j])
            return none if found is None else found * width + i

        for i in range(n - 1):
            tree[width + i] = pair(i, i + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] != none:
            r, at = divmod(tree[1], width)
            gone = after[at]
            then = after[gone]
            symbols[at], symbols[gone] = int(self.made[r]), -1
            after[at] = then
            put(gone, none)
            if then < n:
                before[then] = at
            put(at, pair(at, then) if then < n else none)
            if before[at] >= 0:
                put(before[at], pair(before[at], at))
        return np.array([s for s in symbols if s >= 0], np.int32)

    def _learn(self, chunks: list[str]) -> None:
        """Put the ids (int32 bytes) of new chunks into the cache."""
        plain = [c for c in chunks if c.isalpha() or c[1:].isalpha() and c[0] == " "]  # one word each
        mixed = {c: [w.encode() for w in WORD.findall(c)] for c in set(chunks).difference(plain)}
        self.cache.update(zip(plain, self.words(list(map(str.encode, plain))), strict=True))
        fresh = list(set(chain.from_iterable(mixed.values())))
        ids = dict(zip(fresh, self.words(fresh), strict=True))
        self.cache.update((c, b"".join([ids[w] for w in ws])) for c, ws in mixed.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of int32."""
        split = []
        for text in texts:
            parts = self._split.split(text) if self._split and any(s in text for s in self.special) else [text]
            found: list[str] = []
            for k, part in enumerate(parts):
                found += [part] if k % 2 else CHUNK.findall(part)
            split.append(found)
        if len(self.cache) > CACHE:  # what is met again moves to the younger half
            self.cache, self.older = {}, self.cache
        self.cache.update({s: np.int32(i).tobytes() for s, i in self.special.items()})
        new = set(chain.from_iterable(split)).difference(self.cache)
        known = new & self.older.keys()
        self.cache.update((c, self.older[c]) for c in known)
        new -= known
        if new:
            self._learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

    def pieces(self, text: str, most: int) -> Iterator[str]:
        """The text cut, after some `most` characters, before a space behind anything but white space: no word or special token spans it."""
        at = 0
        while len(text) - at > most and not any(" " in s for s in self.special):
            to = text.rfind(" ", at + 1, at + most)
            while to > at and text[to - 1].isspace():
                to = text.rfind(" ", at + 1, to)
            if to <= at:
                to = text.find(" ", at + most)
                while to > 0 and text[to - 1].isspace():
                    to = text.find(" ", to + 1)
            if to <= at:
                break
            yield text[at:to]
            at = to
        yield text[at:]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        parts = (ids[k : k + SLICE] for k in range(0, len(ids), SLICE))
        return b"".join([b"".join([self.bytes[i] for i in (p.tolist() if isinstance(p, np.ndarray) else p)]) for p in parts]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each file and worker."""
    return Tokenizer(path)


def _lists(rows: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids, the token ids of the whole text."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size // SLICE)) + 1):
                if len(rows):
                    part = batch.slice(rows[0], len(rows))
                    texts = [t or "" for t in part.column("text").to_pylist()]
                    ids = own.encode(texts) if len(texts) > 1 else [b"".join(own.encode([p])[0] for p in own.pieces(texts[0], SLICE))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with a column `decoded`, the text that its ids stand for."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            ids = batch.column("ids")
            texts = [own.decode(ids[k].values.to_numpy() if ids[k].is_valid else []) for k in range(len(ids))]  # row by row: lists of integers take ten times their room
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents"))
    return decode(ids).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
