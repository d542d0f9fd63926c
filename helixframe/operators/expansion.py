"""Expansion of rows: fragments, mutants, samples of designs and simulated libraries.

Random choices are hashes of the seed, the row's key and the draw's number, so
that they don't depend on partitions or retries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import count as count_from

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from helixframe.functions import dna, protein
from helixframe.functions.tables import CONSERVATIVE, HYDROPATHY, IUPAC, PKA_TAG, RESIDUES
from helixframe.operators import intervals


def uniform(*key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def pick(options: Column, *key: Column, seed: int = 42) -> Column:
    """An element of an array, by a key."""
    return F.get(options, F.floor(uniform(*key, seed=seed) * F.size(options)).cast("int"))


def fragments(df: DataFrame, seq: str, lengths: Iterable[int]) -> DataFrame:
    """df with start, len and fragment: every start of each length."""
    of_length = df.withColumn("len", F.explode(F.array(*map(F.lit, lengths)))).filter(F.length(seq) >= F.col("len"))
    starts = of_length.withColumn("start", F.explode(F.sequence(F.lit(1), F.length(seq) - F.col("len") + 1)))
    return starts.withColumn("fragment", F.substr(F.col(seq), F.col("start"), F.col("len")))


FRAGMENTS = 200_000  # that are scored at once
ALIKE = 512  # fragments of a sequence that are compared with all others of it


def _tag_values() -> np.ndarray:
    """Hydropathy, charge and cysteines of a residue, by its code; others count nothing."""
    values = np.zeros((256, 3))
    for r in RESIDUES:
        values[ord(r), 0] = HYDROPATHY[r]
    for r in "DECYHKR":
        values[ord(r), 1] = (1 if r in "HKR" else -1) / (1 + 10 ** (PH - PKA_TAG[r] if r in "HKR" else PKA_TAG[r] - PH))
    values[ord("C"), 2] = 1
    return values


PH = 7.4
TAG_VALUES = _tag_values()
TAG_ENDS = 1 / (1 + 10 ** (PH - PKA_TAG["N_TERM"])) - 1 / (1 + 10 ** (PKA_TAG["C_TERM"] - PH))
NEAR = 1e-6  # scores that rounding may bring together


def _tag_scores(codes: np.ndarray, lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """len and start of all fragments of sequences of one length (a row each), and (row, fragment) scores."""
    sums = np.cumsum(np.concatenate([np.zeros((len(codes), 1, 3)), TAG_VALUES[codes]], axis=1), axis=1)
    h, q, c = sums[:, :, 0], sums[:, :, 1], sums[:, :, 2]
    lens, starts, scores = [], [], []
    for n in lengths:
        many = codes.shape[1] - n + 1
        if many > 0:
            a, b = slice(0, many), slice(n, n + many)
            scores.append(-2 * (h[:, b] - h[:, a]) / n + 10 * np.abs(TAG_ENDS + q[:, b] - q[:, a]) / n - 2 * (c[:, b] - c[:, a]))
            lens.append(np.full(many, n, np.int32))
            starts.append(np.arange(1, many + 1, dtype=np.int32))
    if not lens:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros((len(codes), 0))
    return np.concatenate(lens), np.concatenate(starts), np.concatenate(scores, axis=1)


def _of_one_length(batch: pa.RecordBatch, seq: str, lengths: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, codes) of sequences of one length, so many that they have about FRAGMENTS fragments."""
    texts = [None if s is None else s.encode("ascii", "replace") for s in batch.column(seq).to_pylist()]
    size = np.array([-1 if s is None else len(s) for s in texts])
    for n in np.unique(size[size > 0]):
        same = np.flatnonzero(size == n)
        step = max(1, FRAGMENTS // int(max(n, sum(max(0, n - k + 1) for k in lengths))))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            yield some, np.frombuffer(b"".join(texts[k] for k in some), np.uint8).reshape(len(some), n)


def _with_fragments(df: DataFrame, seq: str, chosen: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], lengths: Iterable[int]) -> DataFrame:
    some = list(lengths)
    kept = [c for c in df.columns if c != seq]
    names = [*kept, "len", "start", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [batch.column(c) for c in kept]
            for rows, codes in _of_one_length(batch, seq, some):
                lens, starts, scores = _tag_scores(codes, some)
                r, c = np.nonzero(chosen(lens, starts, scores))
                if len(r):
                    at = pa.array(rows[r])
                    yield pa.RecordBatch.from_arrays([*(x.take(at) for x in left), pa.array(lens[c]), pa.array(starts[c]), pa.array(scores[r, c])], names)

    schema = StructType([*(f for f in df.schema.fields if f.name != seq), StructField("len", IntegerType()), StructField("start", IntegerType()), StructField("score", DoubleType())])
    return df.mapInArrow(run, schema)


def scored_fragments(df: DataFrame, seq: str, lengths: Iterable[int], best: int | None = None) -> DataFrame:
    """df, without the sequences, with len, start and the tag score of every fragment, from running sums of each sequence: a fragment costs two differences, not its length.

    best: of some hundred thousand fragments at a time, only those that can be among so
    many best ones of all, with all that tie with the last of them to NEAR.
    """

    def chosen(lens: np.ndarray, starts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        if best is None or scores.size <= best:
            return np.ones(scores.shape, bool)
        return scores >= np.partition(scores.ravel(), scores.size - best)[scores.size - best] - NEAR

    return _with_fragments(df, seq, chosen, lengths)


def separate_fragments(df: DataFrame, seq: str, lengths: Iterable[int], share: float = 0.5) -> DataFrame:
    """As scored_fragments, but of each row those that no better fragment of the row, itself kept, overlaps by `share` of the shorter one.

    What intervals.without_overlaps keeps where a key is one row, without moving any
    fragment. Scores are compared to nine decimals, then starts and ends. Sequences of one length
    go through their candidates together, one rank at a time; those of one pass of
    more than ALIKE candidates look only at the kept ones in reach.
    """

    def chosen(lens: np.ndarray, starts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        many = scores.shape[1]
        out = np.zeros(scores.shape, bool)
        ends = starts + lens - 1
        order = np.lexsort((np.broadcast_to(ends, scores.shape), np.broadcast_to(starts, scores.shape), -np.round(scores, 9)), axis=1)
        if many > ALIKE:
            for k, ranks in enumerate(order):
                out[k, intervals.greedy(starts[ranks].tolist(), ends[ranks].tolist(), share, ranks)] = True
            return out
        common = np.minimum(ends[:, None], ends) - np.maximum(starts[:, None], starts) + 1
        clash = common >= share * np.minimum(lens[:, None], lens)
        taken, each = np.zeros(scores.shape, bool), np.arange(len(scores))
        for at in order.T:
            free = ~taken[each, at]
            rows, which = each[free], at[free]
            out[rows, which] = True
            taken[rows] |= clash[which]
        return out

    return _with_fragments(df, seq, chosen, lengths)


def single_position_scan(df: DataFrame, seq: str, regions: str, groups: Mapping[str, str] = CONSERVATIVE) -> DataFrame:
    """One row for each position of the regions (once each) and each substitute of its residue."""
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    at = F.array_sort(F.array_distinct(protein.region_positions(F.col(regions))))
    rows = df.withColumn("pos", F.explode(at)).filter(F.col("pos") <= F.length(seq)).withColumn("was", F.substr(F.col(seq), F.col("pos"), F.lit(1)))
    rows = rows.withColumn("aa", F.explode(dna.characters(F.coalesce(F.try_element_at(table, F.col("was")), F.lit("")))))
    return rows.withColumn("mutant", F.overlay(seq, "aa", "pos", F.lit(1)))


def mutants(df: DataFrame, key: str, seq: str, regions: str, copies: str, mode: str = "random", seed: int = 42) -> DataFrame:
    """df with copy and mutant: each position of the regions changed in each copy; a position in two regions changes twice.

    mode `random` draws any other residue, `conservative` one of the residue's
    group; a blank region or blank copies leave a row as it is (mode `skipped`).
    """
    groups = {r: CONSERVATIVE.get(r, "") if mode == "conservative" else "".join(x for x in RESIDUES if x != r) for r in RESIDUES}
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    blank = (F.coalesce(F.trim(regions), F.lit("")) == "") | (F.coalesce(F.trim(F.col(copies).cast("string")), F.lit("")) == "")
    n = protein.copy_count(F.col(copies))
    todo = df.filter(~blank & (n > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1), n)))

    def change(s: Column, pos: Column) -> Column:
        was = F.substr(s, pos, F.lit(1))
        options = dna.characters(F.coalesce(F.try_element_at(table, was), F.lit("")))
        to = pick(options, F.col(key), F.col("copy"), pos, s, seed=seed)
        return F.when(to.isNotNull(), F.overlay(s, to, pos, F.lit(1))).otherwise(s)

    done = todo.withColumn("mutant", F.aggregate(protein.region_positions(F.col(regions)), F.col(seq), change)).withColumn("mode", F.lit(mode))
    left = df.filter(blank).withColumns({"copy": F.lit(0), "mutant": F.col(seq), "mode": F.lit("skipped")})
    return done.unionByName(left)


def sampled(spark: SparkSession, design: str, n: int, seed: int = 42, alphabet: Mapping[str, str] = IUPAC, tasks: int = 8) -> DataFrame:
    """id, seq: independent uniform draws of each position of a design."""
    bases = [pick(F.array(*map(F.lit, alphabet[c])), F.col("id"), F.lit(k), seed=seed) for k, c in enumerate(design)]
    return spark.range(0, n, 1, tasks).select("id", F.concat(*bases).alias("seq"))


def unique_proteins(draws: DataFrame, n: int) -> DataFrame:
    """The first n draws of different proteins that have no stop."""
    got = draws.withColumn("protein", dna.translate(F.col("seq"), stop="drop")).filter("protein is not null")
    first = got.groupBy("protein").agg(F.min(F.struct("id", "seq")).alias("x"))
    return first.select("x.id", "x.seq", "protein").orderBy("id").limit(n)


def unique_until_stalled(spark: SparkSession, design: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n different proteins of a design: batches of max(20000, 20 n) draws until there are n, or a batch brings none."""
    batch, had = max(20_000, 20 * n), -1
    for k in count_from(1):
        found = unique_proteins(sampled(spark, design, k * batch, seed), n)
        count = found.count()
        if count >= n or count == had:
            break
        had = count
    return found


def combinations(seq: Column, regions: Column, mode: str = "conservative", own: bool = False) -> Column:
    """How many different mutants the regions allow, as a decimal string exact up to 38 digits; a position in two regions counts once.

    own: also count leaving a residue as it is.
    """
    sizes = {r: (len(CONSERVATIVE.get(r, "")) if mode == "conservative" else 19) + own for r in RESIDUES}
    table = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    letters = dna.characters(seq)
    at = F.filter(F.array_distinct(protein.region_positions(regions)), lambda p: p <= F.length(seq))
    one = F.lit(1).cast("decimal(38,0)")
    size = lambda p: F.greatest(F.lit(1), F.coalesce(F.try_element_at(table, F.get(letters, p - 1)), F.lit(1)))
    return F.aggregate(at, one, lambda a, p: (a * size(p).cast("decimal(2,0)")).cast("decimal(38,0)")).cast("string")


# Residues of each kind with their weights in a draw.
KINDS = {"positive": {"K": 1, "R": 1}, "negative": {"E": 1, "D": 1}, "np1": {"G": 1, "P": 3}, "np2": {"G": 2, "A": 1, "V": 1, "I": 1, "L": 1}, "polar": {"S": 2, "T": 2, "Q": 2, "N": 1, "H": 2}}


def _of_kind(kind: str, *key: Column, seed: int) -> Column:
    return pick(F.array(*(F.lit(r) for r, w in KINDS[kind].items() for _ in range(w))), *key, seed=seed)


def patterned_motifs(df: DataFrame, pattern: str, key: Sequence[str], length: int, seed: int = 42) -> DataFrame:
    """df with `motif`: a number below length * 3**(length - 1) gives the place of the one non-polar residue and the kinds of the others; residues are drawn by weight."""
    per = 3 ** (length - 1)
    place, code = F.floor(F.col(pattern) / per).cast("int"), F.pmod(F.col(pattern), F.lit(per))
    out = []
    keys = [F.col(k) for k in key]
    for at in range(length):
        # The digit of this slot: slots behind the non-polar one are one digit further on.
        before = F.when(F.lit(at) > place, at - 1).otherwise(at)
        digit = F.pmod(F.floor(code / F.pow(F.lit(3.0), length - 2 - before)), F.lit(3))
        drawn = F.when(digit == 0, _of_kind("negative", *keys, F.lit(at), seed=seed)).when(digit == 1, _of_kind("positive", *keys, F.lit(at), seed=seed)).otherwise(_of_kind("polar", *keys, F.lit(at), seed=seed))
        out.append(F.when(place == at, _of_kind("np1", *keys, F.lit(at), seed=seed)).otherwise(drawn))
    return df.withColumn("motif", F.concat(*out, F.lit("+")))


def anchored_motifs(df: DataFrame, key: Sequence[str], seed: int = 42) -> DataFrame:
    """df with `motif`: positive, P, negative, non-polar, +."""
    keys = [F.col(k) for k in key]
    slot = lambda kind: _of_kind(kind, *keys, F.lit(kind), seed=seed)
    return df.withColumn("motif", F.concat(slot("positive"), F.lit("P"), slot("negative"), slot("np2"), F.lit("+")))


def library(spark: SparkSession, design: str, most: int = 500_000, sample: int = 150_000, seed: int = 42) -> DataFrame:
    """All sequences of a design, or, as a sampling operator, a sample of `sample` where there are more than `most`; `weight` scales counts to the whole design."""
    space = dna.design_space(design)
    if space <= most:
        return spark.range(space).select("id", dna.decode_index(F.col("id"), design).alias("seq"), F.lit(1.0).alias("weight"))
    return sampled(spark, design, sample, seed).withColumn("weight", F.lit(space / sample))


def compounded(rate: float, cycles: int) -> float:
    """Error rate of a base after cycles."""
    return 1 - (1 - rate) ** cycles


def error_prone(df: DataFrame, key: str, seq: str, rate: float, transition: float = 1 / 3, bias: Mapping[str, Mapping[str, float]] | None = None, weights: Sequence[float] | None = None, seed: int = 42) -> DataFrame:
    """df with mutant, mutations and n_mutations: each base changes with the rate (times its weight), independently.

    That makes the number of changes binomial and their places distinct. A change
    is a transition with a probability, or drawn from the weights of its base.
    """
    if rate > 0.5:
        raise ValueError("the error rate exceeds one half")
    swap, other = F.create_map(*[F.lit(x) for x in ("A", "G", "G", "A", "C", "T", "T", "C")]), {"A": "CT", "G": "CT", "C": "AG", "T": "AG"}
    mean = sum(weights) / len(weights) if weights else 1.0
    scale = F.array(*(F.lit(w / mean) for w in weights)) if weights else None

    def to(b: Column, i: Column) -> Column:
        u = uniform(F.col(key), i, F.lit("to"), seed=seed)
        if bias:
            out = F.lit(None).cast("string")
            for base, row in bias.items():
                total, edge, chosen = sum(row.values()), 0.0, F.lit(list(row)[-1])
                for alt, w in reversed(list(row.items())):
                    edge = sum(list(row.values())[: list(row).index(alt) + 1]) / total
                    chosen = F.when(u < edge, F.lit(alt)).otherwise(chosen)
                out = F.when(b == base, chosen).otherwise(out)
            return out
        table = F.create_map(*[F.lit(x) for kv in other.items() for x in kv])
        side = F.substr(F.try_element_at(table, b), F.when(uniform(F.col(key), i, F.lit("side"), seed=seed) < 0.5, 1).otherwise(2), F.lit(1))
        return F.when(u < transition, F.try_element_at(swap, b)).otherwise(side)

    def one(b: Column, i: Column) -> Column:
        p = F.lit(rate) * F.get(scale, i) if scale is not None else F.lit(rate)
        hit = (uniform(F.col(key), i, F.lit("hit"), seed=seed) < p) & b.isin("A", "C", "G", "T")
        return F.struct(b.alias("was"), F.when(hit, to(b, i)).otherwise(b).alias("now"), (i + 1).alias("pos"))

    rows = df.withColumn("__cells", F.transform(dna.characters(F.col(seq)), one))
    changed = F.filter("__cells", lambda x: x["was"] != x["now"])
    said = F.array_join(F.transform(changed, lambda x: F.concat(x["was"], x["pos"], x["now"])), ";")
    return rows.withColumns({"mutant": F.array_join(F.transform("__cells", lambda x: x["now"]), ""), "mutations": F.when(F.size(changed) > 0, said).otherwise("WT"), "n_mutations": F.size(changed)}).drop("__cells")


def unique_mutants(df: DataFrame, key: str) -> DataFrame:
    """Rows of different mutants, each the one of the least key."""
    return df.groupBy("mutant").agg(F.min_by(F.struct(*df.columns), F.col(key)).alias("__r")).select("__r.*")


def triplicated(df: DataFrame, key: str, raw: str, patches: Sequence[str], attempts: int = 3, remove: float = 0.75, seed: int = 42) -> DataFrame:
    """Seven versions of a motif string: `+` removed; replaced by a patch; or removed or replaced, each by chance."""
    kinds = F.array(F.struct(F.lit(1).alias("set"), F.lit(1).alias("attempt")), *(F.struct(F.lit(s).alias("set"), F.lit(a).alias("attempt")) for s in (2, 3) for a in range(1, attempts + 1)))
    rows = df.withColumn("__k", F.explode(kinds)).withColumns({"set": F.col("__k.set"), "attempt": F.col("__k.attempt")}).drop("__k")
    options = F.array(*map(F.lit, patches))
    own = lambda i, what: (F.col(key), F.col("set"), F.col("attempt"), i, F.lit(what))

    def resolved(c: Column, i: Column) -> Column:
        patch = pick(options, *own(i, "patch"), seed=seed)
        gone = (F.col("set") == 1) | ((F.col("set") == 3) & (uniform(*own(i, "gone"), seed=seed) < remove))
        return F.when(c != "+", c).when(gone, "").otherwise(patch)

    return rows.withColumn("sequence", F.array_join(F.transform(dna.characters(F.col(raw)), resolved), ""))


def repeats(motifs: DataFrame, motif: str, targets: Sequence[int], tolerance: int = 3) -> DataFrame:
    """motifs with target_length, n_repeats and raw: repeated so often that the length without `+` comes within the tolerance."""
    n = F.length(F.replace(F.col(motif), F.lit("+"), F.lit("")))
    rows = motifs.withColumn("target_length", F.explode(F.array(*map(F.lit, targets))))
    low, high = F.greatest(F.lit(1), F.ceil((F.col("target_length") - tolerance) / n)).cast("int"), F.floor((F.col("target_length") + tolerance) / n).cast("int")
    rows = rows.withColumn("n_repeats", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    return rows.withColumn("raw", F.repeat(F.col(motif), F.col("n_repeats")))


def slot_mixes(targets: Sequence[int], tolerance: int) -> dict[int, list[tuple[int, int]]]:
    """(a, b) of at least one each with 5 a + 10 b within the tolerance of each target."""
    return {t: [(a, b) for b in range(1, (t + tolerance) // 10 + 1) for a in range(1, (t + tolerance - 10 * b) // 5 + 1) if abs(5 * a + 10 * b - t) <= tolerance] for t in targets}


def recombined(pools: Mapping[int, DataFrame], targets: Sequence[int], tolerance: int, samples: int, seed: int = 42) -> DataFrame:
    """motif_type, target_length, n_repeats, draw, raw: strings of motifs drawn from pools by their length, within the tolerance of each target.

    Each pool is recombined with itself (`4aa`, `5aa`, ...), and those of five and ten
    residues with each other in every mix and a drawn order (`mixed_AxBaa_...`).
    pools have (ord, motif) with ord from 0; each slot joins its motif by a drawn
    ord, so that pools may be large.
    """
    sizes = {k: pool.count() for k, pool in pools.items()}
    plans = [(f"{k}aa", t, n, [k] * n) for k, size in sizes.items() if size for t in targets for n in range(1, (t + tolerance) // k + 1) if abs(n * k - t) <= tolerance]
    if sizes.get(5) and sizes.get(10):
        plans += [(f"mixed_{a}x5aa_{b}x10aa", t, a + b, [5] * a + [10] * b) for t, found in slot_mixes(targets, tolerance).items() for a, b in found]
    spark = next(iter(pools.values())).sparkSession
    draws = spark.createDataFrame(plans, "motif_type string, target_length int, n_repeats int, kinds array<int>").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    key = ["motif_type", "target_length", "n_repeats", "draw"]
    slots = draws.select(*key, F.posexplode("kinds").alias("slot", "kind"))
    own = [F.col(c) for c in (*key, "slot")]
    of = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, n)))
    slots = slots.withColumns({"place": uniform(*own, F.lit("place"), seed=seed), "ord": F.floor(uniform(*own, F.lit("ord"), seed=seed) * F.element_at(of, F.col("kind"))).cast("long")})
    all_ = reduce(DataFrame.unionByName, [pool.select(F.lit(k).alias("kind"), "ord", "motif") for k, pool in pools.items()])
    parts = F.array_sort(F.collect_list(F.struct("place", "slot", "motif")))  # as many as a target has room for
    return slots.join(all_, ["kind", "ord"]).groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["motif"]), "").alias("raw"))
