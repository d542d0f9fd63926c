"""Phrase collocation mining by best-first branch-and-bound growth.

A phrase's score is the least, over all cuts into a first part and a rest, of
floor(1000 a n / (l r)) with the counts a of the phrase, l and r of the parts, and
n of all words of its language. As a <= r, no phrase that begins with a prefix P
scores above 1000 n / f(P); as a <= l, none that ends with a suffix S scores above
1000 n / f(S). So rare ends promise most, and the frontier grows from them: a
round admits, for each language, the words of the least counts up to a limit F,
and grows all phrases that begin or end with one, level by level from two words
to `MOST` (a phrase of count `LEAST` has no part below it, so that only occurrences
are counted whose known parts reach it). All that wasn't grown scores at most
U = floor(1000 n / (F + 1)). A language is settled once `TOP` surviving phrases
score above U, ties beyond them included as long as they do, or once every word is
admitted; the others go to the next round.

What a round grows holds all it needs: the first parts of a phrase with rare ends
begin with a rare word, its rests end with one, and so do all its extensions by a
word on one side. A phrase goes if such an extension is as frequent (in percent:
`PERCENT`); longer ones can't be more frequent than these.

A phrase is known by a 64-bit key of its words and its language. Which keys are
admitted or frequent reaches the tasks as a bitmap of bounded size; where two keys
share a bit, more is counted than needed, and never less. Counts are summed up
in tasks before they are shuffled. Scores are exact in decimals of 38 digits.

Defined results: null text is empty; null lang is `und`; ties of score and count
go by phrase in byte order; repeated rows count each; doc_ids aren't used; an
empty table gives an empty result; other columns are not read. A long text takes
a small multiple of its size in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import mixed, small, table, utf8, word_hashes, written
from helixframe.llm.near_dedup import _broadcast

LEAST = 100
PERCENT = 100
MOST = 5
TOP = 2000
SHARES = (1 / 8, 1.0)  # of a language's words that a round's rare words may make
BITS = 26  # of a place in a bitmap at the most: 8 MB
FLUSH = 2_000_000  # keys that are summed up at once
SALTS = 64

_FOLD = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Phrases:
    """The phrases of a batch by number of words: `keys[m][i]` is that of the m words from word i on, `whole[m][i]` tells whether they stand in one piece."""

    def __init__(self, texts: list[bytes], lang: np.ndarray, most: int) -> None:
        self.texts = [t.translate(_FOLD) for t in texts]
        words, first, start = word_hashes(self.texts, lower=False)
        breaks = np.cumsum(np.frombuffer(b"\n".join(self.texts) + b"\n", np.uint8) == 10)
        piece = breaks[start] if len(start) else np.zeros(0, np.int64)
        self.lang = np.repeat(lang, np.diff(first))
        self.keys, self.whole = [words, mixed(words ^ mixed(self.lang.view(np.uint64)))], [np.zeros(0, bool), np.ones(len(words), bool)]
        for m in range(2, most + 1):
            n = max(len(words) - m + 1, 0)
            self.keys.append(mixed(self.keys[-1][:n] * np.uint64(0x9E3779B97F4A7C15) + words[m - 1 :]))
            self.whole.append(piece[:n] == piece[m - 1 :])

    def words(self) -> list[bytes]:
        return b" ".join(self.texts).split()


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(64 * len(bits) - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bitmap(keys: DataFrame) -> np.ndarray:
    """The bits of all keys, which must be cheap to count: 16 or more a key, and 2 ** BITS at most, 64 a row, come to the driver."""
    width = min(BITS, max(10, (16 * keys.count()).bit_length()))
    place = F.col("key").bitwiseAND((1 << width) - 1)
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    set_ = keys.select(place.alias("place")).select(F.shiftright("place", 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << width - 6, np.uint64)
    out[set_.column("word").to_numpy()] = set_.column("bits").to_numpy().view(np.uint64)
    return out


def _rows(docs: DataFrame) -> DataFrame:
    """lang (by hash) and text."""
    return docs.select(F.xxhash64(F.coalesce("lang", F.lit("und"))).alias("lang"), "text")


def _scan(rows: DataFrame, most: int, pick: Callable[[Phrases], Iterator[tuple[np.ndarray, ...]]], names: list[str]) -> DataFrame:
    """lang, `names`, n: rows of longs that pick() yields (lang first), counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flushed() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            _, at, n = np.unique(columns[1], return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([*(pa.array(c[at].view(np.int64)) for c in columns), pa.array(n)], ["lang", *names, "n"])

        for batch in batches:
            for part in small(batch):
                found = Phrases([t or b"" for t in utf8(part.column("text"))], part.column("lang").to_numpy(), most)
                held += pick(found)
                if sum(len(x[0]) for x in held) > FLUSH:
                    yield flushed()
        if held:
            yield flushed()

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["lang", *names, "n"]))


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, key, n of all words."""
    return _scan(rows, 1, lambda p: iter([(p.lang, p.keys[1])]), ["key"]).groupBy("lang", "key").agg(F.sum("n").alias("n"))


def phrase_counts(rows: DataFrame, m: int, frequent: np.ndarray, rare: np.ndarray, parts: np.ndarray) -> DataFrame:
    """lang, key, n: phrases of m words that begin or end with a rare word, of LEAST occurrences or more."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast((frequent, rare, parts))

    def pick(p: Phrases) -> Iterator[tuple[np.ndarray, ...]]:
        frequent, rare, parts = sent.value
        n = len(p.keys[m])
        if not n:
            return
        good, ends = has(frequent, p.keys[1]), has(rare, p.keys[1])
        known = good if m == 2 else has(parts, p.keys[m - 1])
        first, last = ends[:n], ends[m - 1 :]
        grown = p.whole[m] & (first | last) & (~first | known[:n]) & (~last | known[1 : n + 1])
        for k in range(m):
            grown &= good[k : k + n]
        yield p.lang[:n][grown], p.keys[m][grown]

    return _scan(rows, m, pick, ["key"]).groupBy("lang", "key").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def phrase_parts(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """key, head, tail: the phrases of a bitmap without their last and without their first word."""
    sent = rows.sparkSession.sparkContext.broadcast(frequent)

    def pick(p: Phrases) -> Iterator[tuple[np.ndarray, ...]]:
        for m in range(2, MOST + 1):
            at = np.flatnonzero(p.whole[m])
            at = at[has(sent.value, p.keys[m][at])]
            yield p.lang[at], p.keys[m][at], p.keys[m - 1][at], p.keys[m - 1][at + 1]

    return _scan(rows, MOST, pick, ["key", "head", "tail"]).groupBy("key").agg(F.min("head").alias("head"), F.min("tail").alias("tail"))


def texts_of(rows: DataFrame, wanted: np.ndarray) -> DataFrame:
    """key, phrase: the phrases of a bitmap."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, phrases = [], []
            for part in small(batch):
                p = Phrases([t or b"" for t in utf8(part.column("text"))], part.column("lang").to_numpy(), MOST)
                words: list[bytes] | None = None
                for m in range(2, MOST + 1):
                    at = np.flatnonzero(p.whole[m])
                    at = at[has(sent.value, p.keys[m][at])]
                    found, one = np.unique(p.keys[m][at], return_index=True)
                    if len(found):
                        words = words or p.words()
                        keys.append(found.view(np.int64))
                        phrases += [b" ".join(words[i : i + m]) for i in at[one].tolist()]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(phrases, pa.binary()).cast(pa.string())], ["key", "phrase"])

    return rows.mapInArrow(run, "key long, phrase string").groupBy("key").agg(F.min("phrase").alias("phrase"))


#: The score at each cut, from a, n, and the counts of first parts and rests.
SCORES = "transform(first, (l, i) -> (decimal(1000) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(rest[i] as decimal(17,0))))"


def limits(words: DataFrame, share: float) -> DataFrame:
    """lang, total, rarest (the greatest count of an admitted word), bound (no other phrase scores above it; -1: there is none)."""
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    level = words.filter(F.col("n") >= LEAST).withColumn("level", F.floor(F.log2("n") * 8)).groupBy("lang", "level").agg(F.sum("n").alias("held"), F.max("n").alias("most"))
    up = Window.partitionBy("lang").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)  # of some 400 levels at most
    level = level.withColumn("held", F.sum("held").over(up)).join(total, "lang")
    top = F.max("most").alias("most"), F.coalesce(F.max(F.when(F.col("held") <= F.col("total") * share, F.col("most"))), F.min("most")).alias("rarest")
    found = level.groupBy("lang", "total").agg(*top)
    bound = F.expr("(decimal(1000) * cast(total as decimal(20,0))) div cast(rarest + 1 as decimal(20,0))")
    return found.select("lang", "total", "rarest", F.when(F.col("rarest") >= F.col("most"), F.lit(-1).cast("long")).otherwise(bound).alias("bound"))


def grown(rows: DataFrame, words: DataFrame, limit: DataFrame) -> DataFrame:
    """lang, key, a, l, r, n, score of all surviving phrases with rare ends. rows and words: of the languages of limit."""
    level = written(words.filter(F.col("n") >= LEAST).join(F.broadcast(limit.select("lang", "rarest")), "lang").withColumn("rare", F.col("n") <= F.col("rarest")).drop("rarest"), "frequent-words")
    frequent, rare = bitmap(level.select("key")), bitmap(level.filter("rare").select("key"))
    parts, counts = frequent, []
    for m in range(2, MOST + 1):
        counts.append(written(phrase_counts(rows, m, frequent, rare, parts), f"phrases-{m}"))
        parts = bitmap(counts[-1].select("key"))
    every = counts[0].select("key")
    for c in counts[1:]:
        every = every.union(c.select("key"))
    split = written(phrase_parts(rows, bitmap(every)), "phrase-parts")
    # Counts of first parts (`first`) and rests (`rest`) by cut, level by level; null where they weren't grown.
    below = level.select("key", "n", F.array().cast("array<long>").alias("first"), F.array().cast("array<long>").alias("rest"), F.col("rare").alias("opens"), F.col("rare").alias("closes"))
    levels = []
    for m, c in enumerate(counts, 2):
        head = below.select(F.col("key").alias("head"), F.concat("first", F.array("n")).alias("first"), "opens")
        tail = below.select(F.col("key").alias("tail"), F.concat(F.array("n"), "rest").alias("rest"), "closes")
        below = written(c.join(split, "key").join(head, "head", "left").join(tail, "tail", "left"), f"cuts-{m}")
        levels.append(below)
    found = None
    for k, now in enumerate(levels):
        own = now.filter("opens and closes")
        if k + 1 < len(levels):
            for side in ("head", "tail"):
                longer = levels[k + 1].filter(f"{side} is not null").groupBy(F.col(side).alias("key")).agg(F.max("n").alias("longer"))
                own = own.join(longer, "key", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < PERCENT * F.col("n"))).drop("longer")
        found = own if found is None else found.unionByName(own)
    scored = found.withColumnRenamed("n", "a").join(F.broadcast(limit.select("lang", F.col("total").alias("n"))), "lang")
    scored = scored.withColumn("scores", F.expr(SCORES)).withColumn("score", F.array_min("scores")).withColumn("cut", F.array_position("scores", F.col("score")).cast("int") - 1)
    return scored.select("lang", "key", "a", F.get("first", F.col("cut")).alias("l"), F.get("rest", F.col("cut")).alias("r"), "n", "score")


def _best(df: DataFrame, top: int) -> DataFrame:
    """The first `top` of each language by score and count, and what ties with the last; salted first."""
    order = [F.desc("score"), F.desc("a")]
    salted = df.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    return salted.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place", "salt")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases."""
    langs = written(docs.select(F.coalesce("lang", F.lit("und")).alias("name")).distinct().withColumn("lang", F.xxhash64("name")), "languages")
    rows = _rows(docs)
    words = written(word_counts(rows), "word-counts")
    done: list[DataFrame] = []
    for share in SHARES:
        limit = written(limits(words, share), "limits")
        if limit.isEmpty():
            break
        open_ = _broadcast(limit.select("lang"))
        found = _best(grown(rows.join(open_, "lang", "left_semi"), words, limit).join(_broadcast(limit.select("lang", "bound")), "lang").filter("score > bound"), top)
        found = written(found, "best-phrases")
        full = found.groupBy("lang").agg(F.count("*").alias("held"))
        settled = written(limit.join(full, "lang", "left").filter((F.col("bound") < 0) | (F.col("held") >= top)).select("lang"), "settled")
        done.append(found.drop("bound").join(_broadcast(settled), "lang", "left_semi"))
        words = words.join(_broadcast(limit.select("lang")), "lang", "left_semi").join(_broadcast(settled), "lang", "left_anti")
    if not done:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    best = done[0]
    for d in done[1:]:
        best = best.unionByName(d)
    best = written(best, "chosen")
    named = best.join(texts_of(rows, bitmap(best.select("key"))), "key").join(_broadcast(langs), "lang").drop("lang")
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return named.withColumn("rank", rank).filter(F.col("rank") <= top).select(F.col("name").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


def op12_best_first_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), counts AS (
  SELECT lang, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM words, range(1, {MOST + 1}) x(m) WHERE len(w) >= m) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY 1
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= {LEAST}
), cuts AS (
  SELECT c.lang, c.phrase, c.a, n, k, x.f AS l, y.f AS r, 1000 * c.a::HUGEINT * n::HUGEINT // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) c JOIN totals USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.m = k AND x.phrase = array_to_string(list_slice(w, 1, k), ' ')
  JOIN counts y ON y.lang = c.lang AND y.m = c.m - k AND y.phrase = array_to_string(list_slice(w, k + 1, c.m), ' ')
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), gone AS (
  SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates d
  ON d.lang = c.lang AND d.m > c.m AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * d.a >= {PERCENT} * c.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM least ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= {TOP}
"""
