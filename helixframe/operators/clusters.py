"""Clustering: directional clusters of counts, medoids, Ward's method on cells, length buckets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from helixframe.operators.graph import written
from helixframe.operators.relational import numbered, small_side


def _letters(s: pa.Array) -> np.ndarray:
    """A row for each string of one length, a column for each character."""
    text = "".join(s.to_pylist())
    found = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return found.reshape(len(s), -1)


class _Packed:
    """Strings of one length as rows of 64-bit words, in which each place where any of them differ has a field of `bits` bits."""

    def __init__(self, s: pa.Array):
        letters = _letters(s)
        self.length = letters.shape[1]
        self.places = np.flatnonzero((letters != letters[0]).any(0))
        letters = letters[:, self.places]
        kinds = np.unique(letters)
        self.bits = max(1, int(len(kinds) - 1).bit_length())
        self.fields = 64 // self.bits
        self.words = np.zeros((len(letters), max(1, -(-len(self.places) // self.fields))), np.uint64)
        for k in range(len(self.places)):
            self.words[:, k // self.fields] |= np.searchsorted(kinds, letters[:, k]).astype(np.uint64) << np.uint64(self.bits * (k % self.fields))
        self.low = np.uint64(sum(1 << (self.bits * f) for f in range(self.fields)))

    def masks(self, part: np.ndarray, parts: int) -> np.ndarray:
        """(..., parts, words): full fields where a place is in a part; part: (..., place), below 0 for none."""
        out = np.zeros((*part.shape[:-1], parts, self.words.shape[1]), np.uint64)
        for k, place in enumerate(self.places.tolist()):
            held = np.nonzero(part[..., place] >= 0)
            out[(*held, part[(*held, place)], k // self.fields)] |= np.uint64(((1 << self.bits) - 1) << (self.bits * (k % self.fields)))
        return out

    def distances(self, differ: np.ndarray) -> np.ndarray:
        """Fields that are not 0, of each row."""
        out = 0
        for word in differ.T:
            found = word | word >> np.uint64(1) if self.bits > 1 else word.copy()
            for s in range(2, self.bits):
                found |= word >> np.uint64(s)
            found &= self.low
            out = out + np.bitwise_count(found).astype(np.uint8 if len(self.places) < 256 else np.int64, copy=False)
        return out


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What differs between packed strings, row by row."""
    return a ^ b


CROWD = 8192  # sequences of a bucket that are compared with each other
CANDIDATES = 1 << 15  # pairs that are compared at once


def _parts(rows: DataFrame, group: Sequence[str], parts: int) -> DataFrame:
    """group, varies, places, deal: the positions (1-based) at which a group's sequences differ, dealt to parts of like information, each an array; and the part of each position, `-` for none.

    By falling entropy, forth and back over the parts; a position where all agree tells nothing and is in none.
    """
    each = rows.select(*group, F.posexplode(F.split("s", "")).alias("at", "c")).groupBy(*group, "at", "c").agg(F.count("*").alias("n"))
    total = F.sum("n")
    bits = each.groupBy(*group, "at").agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("bits"), F.count("*").alias("kinds")).filter("kinds > 1")
    turn = F.pmod(F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("bits"), "at")) - 1, F.lit(2 * parts))
    dealt = bits.withColumn("part", F.when(turn < parts, turn).otherwise(2 * parts - 1 - turn))
    places = F.array(*(F.sort_array(F.collect_list(F.when(F.col("part") == p, F.col("at") + 1))) for p in range(parts)))
    part_of = F.map_from_entries(F.collect_list(F.struct("at", F.char(F.col("part") + 48))))
    deal = F.array_join(F.transform(F.sequence(F.lit(1), F.col("len")), lambda at: F.coalesce(F.element_at("part_of", at - 1), F.lit("-"))), "")
    return dealt.groupBy(*group).agg(F.count("*").alias("varies"), places.alias("places"), part_of.alias("part_of")).withColumn("deal", deal).drop("part_of")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, from batches in which a group's rows follow each other, and each group's first row."""
    held = None
    for batch in batches:
        some = pa.Table.from_batches([batch])
        held = (some if held is None else pa.concat_tables([held, some])).combine_chunks()
        if held.num_rows > 1:
            other = np.zeros(held.num_rows - 1, bool)
            for k in keys:
                other |= pc.not_equal(held.column(k).slice(1), held.column(k).slice(0, held.num_rows - 1)).to_numpy()
            first = np.concatenate([[0], np.flatnonzero(other) + 1])
            if len(first) > 1:
                yield held.slice(0, first[-1]).combine_chunks(), first[:-1]
                held = held.slice(first[-1])
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0])


def _near(rows: DataFrame, by: Sequence[str], most: int, given: Sequence[str], crowd: int) -> DataFrame:
    """(by, a_x, b_x for each x of `given`): pairs of different s within the distance, a_s < b_s, each once. rows: a table of by, s and what is given; s is distinct within by.

    Nothing is shuffled but the buckets' rows. A pair may meet in several buckets, and
    counts in the first: that of the first two parts on which it agrees, at each
    cut. `cuts` has for each cut the number of the two parts and each position's part.
    """
    parts = most + 2
    two = list(combinations(range(parts), 2))
    carried = ["s", *(c for c in given if c != "s")]
    group = [*by, "len", "path"]
    rows = rows.select(*by, *carried, F.length("s").cast("int").alias("len"), F.lit(0).cast("long").alias("path"), F.lit("").alias("cuts")).na.drop(subset=[*by, "s"])
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def first_meeting(packed: _Packed, cuts: pa.Array, kind: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """Whether pairs, of the given ones of some cuts, meet in no bucket before, and not by equal hashes of different parts."""
        told = _letters(cuts).reshape(len(cuts), -1, packed.length + 1).astype(int) - 48
        i, j = (np.array(two)[told[:, :, 0]][..., k, None] for k in range(2))
        p = np.arange(parts)
        alike = (p == i) | (p == j)
        free = ~alike & (p > j)
        masks = packed.masks(told[:, :, 1:], parts)
        ok = np.ones(len(differ), bool)
        for cut in range(told.shape[1]):
            for p in range(parts):
                ok &= free[kind, cut, p] | (alike[kind, cut, p] ^ (differ & masks[kind, cut, p]).any(1))
        return ok

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_groups(batches, group):
            length = table.column("len").to_numpy()
            runs = [*first[np.flatnonzero(np.concatenate([[True], length[first[1:]] != length[first[:-1]]]))], table.num_rows]
            last = np.repeat(np.append(first[1:], table.num_rows), np.diff(np.append(first, table.num_rows)))
            for begin, end in zip(runs[:-1], runs[1:], strict=True):
                some = table.slice(begin, end - begin).combine_chunks()
                after = last[begin:end] - np.arange(begin, end) - 1  # rows of the group behind each row
                if not after.any():
                    continue
                packed = _Packed(some.column("s").chunk(0))
                words = packed.words if packed.words.shape[1] > 1 else packed.words.ravel()
                cuts = some.column("cuts").chunk(0).dictionary_encode()
                kind = cuts.indices.to_numpy()
                total = np.concatenate([[0], np.cumsum(after)])
                row, held, count = 0, [], 0
                while row < len(after):
                    stop = max(row + 1, int(np.searchsorted(total, total[row] + CANDIDATES, "right")) - 1)
                    n = after[row:stop]
                    differ = _differences(np.repeat(words[row:stop], n, axis=0), np.concatenate([words[r : r + k] for r, k in zip(range(row + 1, stop + 1), n.tolist(), strict=True)]))
                    differ = differ.reshape(-1, packed.words.shape[1])
                    distance = packed.distances(differ)
                    close = np.flatnonzero((distance <= most) & (distance > 0))
                    a = np.searchsorted(total, total[row] + close, "right") - 1
                    held.append((a, a + 1 + total[row] + close - total[a], differ[close]))
                    count, row = count + len(close), stop
                    if count and (count > CANDIDATES or row == len(after)):
                        a, b, differ = (np.concatenate(x) for x in zip(*held, strict=True))
                        ok = first_meeting(packed, cuts.dictionary, kind[a], differ)
                        a, b, held, count = pa.array(a[ok]), pa.array(b[ok]), [], 0
                        columns = [*(some.column(c).take(a) for c in by), *(some.column(c).take(x) for x in (a, b) for c in given)]
                        yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in columns], names)

    names = [*by, *(f"{side}_{c}" for side in "ab" for c in given)]

    def compared(some: DataFrame, tasks: int) -> DataFrame:
        # By rising s within a group, so that a < b; the path is first, as its order is cheap.
        dealt = some.select(*group, "cuts", *carried).repartition(tasks, *group).sortWithinPartitions("path", *by, "len", "s")
        kinds = {f.name: f.dataType for f in dealt.schema}
        schema = StructType([StructField(n, kinds[c]) for n, c in zip(names, [*by, *given, *given], strict=True)])
        return dealt.mapInArrow(near, schema)

    found = None
    while True:
        tasks = max(least, -(-rows.count() * len(two) // 1_000_000))
        placed = rows.join(small_side(written(_parts(rows, group, parts), "positions")), group)
        own = [F.xxhash64(F.array_join(F.transform(F.get("places", F.lit(p)), lambda at: F.substr(F.col("s"), at, F.lit(1))), "")) for p in range(parts)]
        wide = written(placed.filter(F.col("varies") >= parts).select(*group, "cuts", "deal", *carried, *(k.alias(f"k{p}") for p, k in enumerate(own))), "keys")
        keys = F.explode(F.array(*(F.struct(F.xxhash64("path", F.lit(t), f"k{i}", f"k{j}").alias("path"), F.concat("cuts", F.lit(chr(48 + t)), "deal").alias("cuts")) for t, (i, j) in enumerate(two)))).alias("key")
        buckets = wide.select(*by, "len", *carried, keys).select(*by, "len", *carried, "key.*")
        crowded = written(buckets.groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > crowd).drop("n"), "crowded")
        none = crowded.isEmpty()
        full = crowded if none else small_side(crowded)
        tight = compared(placed.filter(F.col("varies") < parts), least).unionByName(compared(buckets if none else buckets.join(full, group, "left_anti"), tasks))
        found = tight if found is None else found.unionByName(tight)
        if none:
            return found
        rows = written(buckets.join(full, group, "left_semi").select(*group, "cuts", *carried), "sequences")


def within_distance(df: DataFrame, seq: str, most: int, by: Sequence[str] = (), crowd: int = CROWD) -> DataFrame:
    """(by, a, b) a < b: pairs of distinct sequences of one length within a Hamming distance.

    The positions at which the sequences of a length differ are dealt to most + 2
    parts of like information; a pair within the distance agrees on two of them, and
    meets in the bucket of these two. What a constant frame holds is in no part. A
    bucket of more than `crowd` sequences is cut anew, by the positions at which its own
    sequences differ, and so on until its buckets are small or so few positions are
    left that most of its pairs are near. Buckets are compared by bits, and their
    pairs leave the task as they are: the answer is not moved.
    """
    rows = written(df.select(*by, F.col(seq).alias("s")).distinct(), "sequences")
    return _near(rows, by, most, ["s"], crowd).select(*by, F.col("a_s").alias("a"), F.col("b_s").alias("b"))


def directional(counts: DataFrame, seq: str, n: str, by: Sequence[str] = (), ratio: float = 3, most: int = 2) -> DataFrame:
    """counts with `representative`: sequences by falling count join the first cluster of at least ratio times their count within the distance.

    The greedy order is kept without walking it. Rows are numbered in this order, so
    that pairs are four numbers. Each sequence x knows the earlier ones y within the distance. A
    round sums up, for each of these that is a cluster or may become one, what it surely
    holds by then and what it may hold at the most. A sequence is settled where no
    cluster can be large enough, or where the first one that can be surely is. All
    settled ones of a round are settled together; the first one left always is. Pairs of
    which nothing can come, and those of settled sequences with other clusters, go.
    """
    rows = written(counts.select(*by, F.col(seq).alias("s"), F.col(n).cast("long").alias("n")), "variants")
    rows = numbered(rows.withColumn("__falling", -F.col("n")), ["__falling", "s", *by], "id").drop("__falling")
    pairs = _near(rows, by, most, ["id", "n"], CROWD)
    first = F.col("a_id") < F.col("b_id")
    of = lambda c, x, y: F.when(first, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}"))
    edges = pairs.select(of("id", "b", "a").alias("id"), of("n", "b", "a").alias("n"), of("id", "a", "b").alias("y"), of("n", "a", "b").alias("yn"))
    before = Window.partitionBy("y").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda what: F.coalesce(F.sum(F.when(what, F.col("n"))).over(before), F.lit(0))
    edges = edges.withColumn("most", F.col("yn") + so_far(F.lit(True))).filter(F.col("most") >= ratio * F.col("n")).drop("most")
    edges = written(edges, "variant-pairs")
    late = edges.select(F.col("id").alias("y")).distinct().withColumn("__late", F.lit(True))
    # joined: x is in y's cluster, else x is open; cluster: whether y is one, null where that is open.
    edges = written(edges.join(late, "y", "left").select("id", "n", "y", "yn", F.lit(False).alias("joined"), F.when(F.col("__late").isNull(), True).alias("cluster")), "variant-pairs")
    done = []
    while not edges.filter(~F.col("joined")).isEmpty():
        sums = edges.filter("cluster is null or cluster").withColumns({"sure": F.col("yn") + so_far(F.col("joined")), "open": so_far(~F.col("joined"))})
        may = F.when(F.col("sure") + F.col("open") >= ratio * F.col("n"), F.col("y"))
        does = F.when(F.col("cluster") & (F.col("sure") >= ratio * F.col("n")), F.col("y"))
        hopes = sums.filter(~F.col("joined")).select("id", may.alias("may"), does.alias("does"))
        none = edges.filter("not cluster").select("id", F.lit(None).cast("long").alias("may"), F.lit(None).cast("long").alias("does"))
        found = hopes.unionByName(none).groupBy("id").agg(F.min("may").alias("may"), F.min("does").alias("does"))
        settled = written(found.select("id", F.when(F.col("may").isNull(), F.col("id")).when(F.col("may") == F.col("does"), F.col("may")).alias("now")).filter("now is not null"), "settled")
        done.append(settled)
        left = edges.join(settled, "id", "left").filter("joined or now is null or now = y").withColumn("joined", F.col("joined") | F.col("now").isNotNull())
        left = left.drop("now").join(settled.select(F.col("id").alias("y"), F.col("now").alias("ynow")), "y", "left")
        edges = written(left.select("id", "n", "y", "yn", "joined", F.coalesce("cluster", F.col("ynow") == F.col("y")).alias("cluster")).filter("not joined or cluster"), "variant-pairs")
    name = F.col("s").alias("representative")
    if not done:
        return rows.select(*by, F.col("s").alias(seq), F.col("n").alias(n), name)
    members = reduce(DataFrame.unionByName, done).filter("now <> id").join(rows.select(F.col("id").alias("now"), name), "now").select("id", "representative")
    return rows.join(members, "id", "left").select(*by, F.col("s").alias(seq), F.col("n").alias(n), F.coalesce("representative", "s").alias("representative"))


def _by_length(s: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of strings of one length and their letters; nulls are in none."""
    size = pc.utf8_length(s).fill_null(-1).to_numpy(zero_copy_only=False)
    for length in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == length)
        yield at, _letters(s.take(pa.array(at))) if length else np.zeros((len(at), 0), np.uint8)


def _nearest_of(letters: np.ndarray, centres: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance) of each row's first nearest centre, over the shorter length."""
    each = []
    for c in centres:
        n = min(letters.shape[1], len(c))
        each.append((letters[:, :n] != c[:n]).sum(1, dtype=np.int32))
    each = np.stack(each)
    own = each.argmin(0)
    return own, each[own, np.arange(len(own))]


def to_centres(df: DataFrame, seq: str, centres: Sequence[str]) -> DataFrame:
    """df with `medoid`, the first of the nearest of few given sequences, and `distance`, over the shorter length; null for nulls."""
    told = [np.array([ord(x) for x in c], np.uint32) for c in centres]
    names = pa.array(centres, pa.string())
    schema = StructType([*df.schema.fields, StructField("medoid", StringType()), StructField("distance", IntegerType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, distance = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows, np.int32)
            for at, letters in _by_length(batch.column(seq)):
                own[at], distance[at] = _nearest_of(letters, told)
            yield pa.RecordBatch.from_arrays([*batch.columns, names.take(pa.array(own, mask=own < 0)), pa.array(distance, mask=own < 0)], schema.names)

    return df.mapInArrow(placed, schema)


def medoid_sequences(rows: DataFrame, seq: str, k: int, rounds: int = 10, seed: int = 42) -> list[str]:
    """The k medoids, sorted, of a table of distinct sequences.

    A round goes over the rows twice, and moves only counts of letters at each
    position, and a task's best row of each cluster.
    """
    rows = rows.select(F.col(seq).alias("s"))
    chosen = sorted(r.s for r in rows.orderBy(F.xxhash64(F.lit(seed), "s"), "s").limit(k).collect())
    seen = set()
    for _ in range(rounds):
        if not chosen or frozenset(chosen) in seen:
            break
        seen.add(frozenset(chosen))
        told = [np.array([ord(x) for x in c], np.uint32) for c in chosen]

        def counted(batches: Iterator[pa.RecordBatch], told: list = told) -> Iterator[pa.RecordBatch]:
            """Letters at each position of each cluster; position -1: its rows."""
            ascii_, names = {}, ["medoid", "pos", "letter", "n"]
            for batch in batches:
                for at, letters in _by_length(batch.column("s")):
                    own, _ = _nearest_of(letters, told)
                    length = letters.shape[1]
                    kinds = np.arange(256) if letters.dtype == np.uint8 else np.unique(letters)
                    codes = letters if letters.dtype == np.uint8 else np.searchsorted(kinds, letters)
                    cell = (own[:, None] * length + np.arange(length)) * len(kinds) + codes
                    got = np.bincount(cell.ravel(), minlength=len(told) * length * len(kinds)).reshape(len(told), length, len(kinds))
                    size = np.bincount(own, minlength=len(told))
                    if letters.dtype == np.uint8:
                        held = ascii_.setdefault(length, [np.zeros_like(got), np.zeros_like(size)])
                        held[0] += got
                        held[1] += size
                    else:
                        yield pa.RecordBatch.from_arrays(_cells(got, size, kinds), names)
            for got, size in ascii_.values():
                yield pa.RecordBatch.from_arrays(_cells(got, size, np.arange(256)), names)

        profile = rows.mapInArrow(counted, "medoid int, pos int, letter int, n long").groupBy("medoid", "pos", "letter").agg(F.sum("n").alias("n")).toPandas()  # clusters by positions by letters
        of_rows = profile["pos"] < 0
        size = np.zeros(len(told), np.int64)
        size[profile["medoid"][of_rows]] = profile["n"][of_rows]
        profile = profile[~of_rows]
        kinds = np.unique(profile["letter"])
        same = np.zeros((len(told), int(profile["pos"].max()) + 1 if len(profile) else 0, len(kinds)), np.int64)
        same[profile["medoid"], profile["pos"], np.searchsorted(kinds, profile["letter"])] = profile["n"]
        sent = rows.sparkSession.sparkContext.broadcast((told, size, kinds, same))

        def least(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            told, size, kinds, same = sent.value
            best = {}
            for batch in batches:
                for at, letters in _by_length(batch.column("s")):
                    own, _ = _nearest_of(letters, told)
                    length = letters.shape[1]
                    # An empty sequence differs from all others of its cluster.
                    total = length * size[own] - same[own[:, None], np.arange(length), np.searchsorted(kinds, letters)].sum(1) if length else size[own] - 1
                    for g in np.unique(own).tolist():
                        mine = np.flatnonzero(own == g)
                        first = mine[total[mine] == total[mine].min()]
                        s = min(batch.column("s").take(pa.array(at[first])).to_pylist(), key=str.encode)
                        best[g] = min([(int(total[first[0]]), s), *([best[g]] if g in best else [])], key=lambda x: (x[0], x[1].encode()))
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([x[0] for x in best.values()], pa.int64()), pa.array([x[1] for x in best.values()], pa.string())], ["medoid", "total", "s"])

        totals = rows.mapInArrow(least, "medoid int, total long, s string")
        chosen = sorted(r.s for r in totals.groupBy("medoid").agg(F.min_by("s", F.struct("total", "s")).alias("s")).collect())  # k rows
    return chosen


def _cells(got: np.ndarray, size: np.ndarray, kinds: np.ndarray) -> list[pa.Array]:
    g, pos, letter = np.nonzero(got)
    own = np.flatnonzero(size)
    columns = ((own, g), (np.full(len(own), -1), pos), (np.zeros(len(own), int), kinds[letter]))
    return [*(pa.array(np.concatenate(c).astype(np.int32)) for c in columns), pa.array(np.concatenate([size[own], got[g, pos, letter]]).astype(np.int64))]


def medoids(df: DataFrame, seq: str, k: int, rounds: int = 10, seed: int = 42) -> DataFrame:
    """df's distinct sequences with `medoid`: alternating nearest medoids and the member of least total distance in each cluster.

    Totals come from counts of residues at each position, so that no pairs are
    made. Ends when the medoids repeat; fewer sequences than k are their own medoids.
    """
    rows = written(df.select(F.col(seq).alias(seq)).distinct(), "sequences")
    return to_centres(rows, seq, medoid_sequences(rows, seq, k, rounds, seed))


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with each feature centred and scaled by its population deviation; constant features become 0."""
    stats = df.agg(*(f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))
    scaled = {c: F.when(F.col(f"__s_{c}") > 1e-12, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in features}
    return out.withColumns(scaled).select(*df.columns)


def principal_axes(df: DataFrame, features: Sequence[str], k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(axes, shares of variance) from the covariances of one pass; the largest loading of each axis is positive."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    got = df.agg(*(F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs)).first()
    c = np.zeros((len(features),) * 2)
    for (a, b), v in zip(pairs, got, strict=True):
        i, j = features.index(a), features.index(b)
        c[i, j] = c[j, i] = v or 0.0
    w, v = np.linalg.eigh(c)
    order = np.argsort(w)[::-1][:k]
    axes = v[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    return axes, w[order] / w.sum()


def projected(df: DataFrame, features: Sequence[str], axes: np.ndarray) -> DataFrame:
    cols = {f"pc{k + 1}": sum((F.col(c) * F.lit(float(x)) for c, x in zip(features, axis, strict=True)), F.lit(0.0)) for k, axis in enumerate(axes)}
    return df.withColumns(cols)


def ward_tree(points: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Merges (i, j) into i, i < j, in order: each joins the two clusters whose union adds least to the squares within."""
    x, n = points.astype(float).copy(), sizes.astype(float).copy()
    alive = np.ones(len(x), bool)
    d = ((x[:, None] - x[None]) ** 2).sum(-1) * (n[:, None] * n[None]) / (n[:, None] + n[None])
    d[np.tril_indices(len(x))] = np.inf
    out = []
    for _ in range(len(x) - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        out.append((int(i), int(j)))
        x[i] = (n[i] * x[i] + n[j] * x[j]) / (n[i] + n[j])
        n[i] += n[j]
        alive[j] = False
        d[j, :] = d[:, j] = np.inf
        others = np.flatnonzero(alive & (np.arange(len(x)) != i))
        new = ((x[others] - x[i]) ** 2).sum(1) * n[others] * n[i] / (n[others] + n[i])
        d[np.minimum(i, others), np.maximum(i, others)] = new
    return out


def cut(tree: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Labels 1..k by first appearance after all but the last k - 1 merges."""
    up = list(range(n))
    for i, j in tree[: n - k]:
        up = [i if u == j else u for u in up]
    names = {}
    return np.array([names.setdefault(u, len(names) + 1) for u in up])


def silhouette(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette of weighted points; a cluster of one row counts 0."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    total, weight = 0.0, sizes.sum()
    for i in range(len(points)):
        same = labels == labels[i]
        own = sizes[same].sum() - 1
        if own <= 0:
            continue
        a = (d[i, same] * sizes[same]).sum() / own
        b = min((d[i, labels == c] * sizes[labels == c]).sum() / sizes[labels == c].sum() for c in set(labels) - {labels[i]})
        total += sizes[i] * ((b - a) / max(a, b) if max(a, b) else 0.0)
    return total / weight


def ward_of_cells(df: DataFrame, key: str, features: Sequence[str], cells: int = 256, largest: int = 9, seed: int = 42) -> DataFrame:
    """df with `cluster`: Ward's method on the centres and sizes of `cells` k-means cells; a row has the cluster of its cell.

    The number of clusters is that of the best silhouette (squared distances) over
    all rows, which Spark sums up for each number, then the smaller one. It is an
    approximation of `agglomeration.ward` in one pass over the cells.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    x = standardised(df.select(key, *(F.col(c).cast("double").alias(c) for c in features)), features)
    vectors = VectorAssembler(inputCols=list(features), outputCol="__v").transform(x)
    model = KMeans(k=cells, seed=seed, featuresCol="__v", predictionCol="__cell", initMode="random", maxIter=8).fit(vectors)
    named = written(model.transform(vectors).select(key, "__v", "__cell", *features), "cells")
    small = named.groupBy("__cell").agg(F.count("*").alias("__n"), *(F.avg(c).alias(c) for c in features)).orderBy(*features).toPandas()  # at most `cells` rows
    if len(small) < 3:
        return df.withColumn("cluster", F.lit(1))
    tree = ward_tree(small[list(features)].to_numpy(float), small["__n"].to_numpy(float))
    judge = ClusteringEvaluator(featuresCol="__v", predictionCol="cluster")

    def placed(k: int) -> DataFrame:
        labels = df.sparkSession.createDataFrame(small.assign(cluster=cut(tree, len(small), k).astype("int32"))[["__cell", "cluster"]])
        return named.join(F.broadcast(labels), "__cell").withColumn("cluster", F.col("cluster").cast("int"))

    _, best = max((round(judge.evaluate(placed(k)), 12), -k) for k in range(2, min(largest, len(small) - 1) + 1))
    return df.join(placed(-best).select(key, "cluster"), key)


def oversampled(df: DataFrame, length: str, first: int = 155, last: int = 1199, step: int = 116, key: str = "id") -> DataFrame:
    """df with bucket, part (train, valid, test by 60/20/20) and copies: train rows repeat so that each length bucket weighs about as much as the largest whole one.

    first, first + step, ... last are upper bounds: bucket 0 holds lengths up to first.
    Rows over last are kept once in a bucket of their own, the next number, and
    count for no other; rows without a length are kept once with a null bucket.
    """
    over = -(-(last - first) // step) + 1
    place = F.least(F.greatest(F.ceil((F.col(length) - first) / step), F.lit(0)), F.lit(over))  # greatest skips nulls
    rows = df.withColumn("bucket", F.when(F.col(length) > last, over).when(F.col(length).isNotNull(), place).cast("int"))
    u = F.pmod(F.xxhash64(F.lit(42), key), F.lit(10_000)) / 10_000
    rows = rows.withColumn("part", F.when(u < 0.6, "train").when(u < 0.8, "valid").otherwise("test"))
    sizes = rows.filter(F.col("bucket") < over).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "train").alias("train"))
    sizes = sizes.filter("train > 0").crossJoin(F.broadcast(sizes.agg(F.max("n").alias("most")))).select("bucket", F.bround(F.col("most") / F.col("train")).cast("int").alias("copies"))
    rows = rows.join(F.broadcast(sizes), "bucket", "left")
    copies = F.when((F.col("part") == "train") & F.col("copies").isNotNull(), F.col("copies")).otherwise(1)
    return rows.withColumn("copies", copies).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
