"""Chains of beads in a periodic box: unwrapping, radius of gyration, contacts within a cutoff, clusters of chains."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.graph import connected_components

AXES = ("x", "y", "z")


def nearest_image(d: Column, box: float) -> Column:
    return d - box * F.round(d / box)


def unwrapped(df: DataFrame, box: float) -> DataFrame:
    """Coordinates along each chain such that every bond is the nearest image: running sums of the bonds."""
    w = Window.partitionBy("frame", "chain").orderBy("bead")
    out = {}
    for c in AXES:
        step = nearest_image(F.col(c) - F.lag(c).over(w), box)
        out[f"__d{c}"] = F.coalesce(step, F.col(c))
    rows = df.withColumns(out)
    return rows.withColumns({c: F.sum(f"__d{c}").over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in AXES}).drop(*out)


def gyration(df: DataFrame, box: float) -> DataFrame:
    """frame, chain, rg: root mean squared distance to the chain's centroid after unwrapping."""
    spread = [F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c) for c in AXES]
    return unwrapped(df, box).groupBy("frame", "chain").agg(F.sqrt(F.greatest(spread[0] + spread[1] + spread[2], F.lit(0.0))).alias("rg"))


def contacts(df: DataFrame, box: float, cutoff: float) -> DataFrame:
    """frame, a, b, n: bead pairs of different chains within the cutoff, in a periodic cube.

    Beads are put into cells of at least the cutoff; each bead goes to its own cell
    as a target and as a probe, and as a probe to 13 of the 26 cells around, so that any two
    neighbouring cells meet once by an equal-key join (in a box of fewer than three cells an
    axis: as a probe to all). The join is sorted on both sides: what a table of beads
    will hold can't be told from its files, so that it must not be broadcast.
    """
    per_axis = max(1, int(box // cutoff))
    cell = [F.pmod(F.floor(F.col(c) / (box / per_axis)).cast("int"), F.lit(per_axis)) for c in AXES]
    rows = df.select("frame", "chain", "bead", *AXES, *(k.alias(f"c{i}") for i, k in enumerate(cell)))
    half = per_axis > 2
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    shifts = sorted({tuple((d + per_axis) % per_axis for d in s) for s in steps if s >= (0, 0, 0) or not half})
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"s{i}") for i, v in enumerate(s))) for s in shifts)))
    own = (F.col("s.s0") == 0) & (F.col("s.s1") == 0) & (F.col("s.s2") == 0)
    probes = rows.withColumn("s", around).select("frame", F.col("chain").alias("a"), own.alias("own"), *(F.col(c).alias(f"a{c}") for c in AXES), *(F.pmod(F.col(f"c{i}") + F.col(f"s.s{i}"), F.lit(per_axis)).alias(f"c{i}") for i in range(3)))
    targets = rows.select("frame", F.col("chain").alias("b"), *(F.col(c).alias(f"b{c}") for c in AXES), "c0", "c1", "c2")
    square = sum((nearest_image(F.col(f"a{c}") - F.col(f"b{c}"), box) ** 2 for c in AXES), F.lit(0.0))
    once = (F.col("a") < F.col("b")) | (~F.col("own") & (F.col("a") > F.col("b"))) if half else F.col("a") < F.col("b")
    near = probes.join(targets.hint("merge"), ["frame", "c0", "c1", "c2"]).filter(once & (square <= cutoff * cutoff))
    return near.groupBy("frame", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def chain_matrix(pairs: DataFrame) -> DataFrame:
    """a, b, n: contacts of each pair of chains over all frames."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("n").alias("n"))


def chain_clusters(pairs: DataFrame, chains: DataFrame, thresholds: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """threshold, frame, clusters, largest, bound_share, mean_size (by chain): components of chains that share enough contacts.

    chains has (frame, chain); all frames and thresholds are one graph, whose
    nodes are numbered by frame, threshold and chain; a chain number of a million or more raises.
    """
    number = lambda c: F.when(F.col(c).between(0, 999_999), F.col(c)).otherwise(F.raise_error(F.lit("chain numbers go up to 999,999")).cast("long"))
    node = lambda c: (F.col("frame") * len(thresholds) + F.col("t")) * 1_000_000 + number(c)
    t = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.lit(v).alias("threshold")) for k, v in enumerate(thresholds)))).alias("x")
    edges = pairs.select("*", t).select("frame", "a", "b", "n", "x.*").filter("n >= threshold")
    found = connected_components(edges.select(node("a").alias("a"), node("b").alias("b")))
    nodes = chains.select("frame", "chain", t).select("frame", "chain", "x.*").withColumn("node", node("chain"))
    sizes = nodes.join(found, "node", "left").groupBy("threshold", "frame", F.coalesce("component", "node").alias("c")).agg(F.count("*").alias("size"))
    return sizes.groupBy("threshold", "frame").agg(
        F.count("*").alias("clusters"), F.max("size").alias("largest"), (F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)) / F.sum("size")).alias("bound_share"), (F.sum(F.col("size") * F.col("size")) / F.sum("size")).alias("mean_size")
    )


SURE = 1e-9  # an autocorrelation nearer to 0 than this is computed again, lag by lag
FRAMES = 2_000_000  # that are transformed at once


def inefficiencies(x: np.ndarray, least: int = 3) -> np.ndarray:
    """1 + 2 times the sum of autocorrelations up to the first that isn't positive (beyond `least`), for each row; 1 for a flat one.

    The autocorrelations of all lags and rows come from one Fourier transform of the
    rows, padded with zeros.
    """
    n = x.shape[1]
    d = x - x.mean(1, keepdims=True)
    variance = (d * d).mean(1)
    flat = variance <= 0
    if n < 3 or flat.all():
        return np.ones(len(x))
    f = np.fft.rfft(d, 1 << (2 * n - 1).bit_length(), axis=1)
    t = np.arange(1, n - 1)
    c = np.fft.irfft(f * f.conj(), axis=1)[:, 1 : n - 1] / ((n - t) * np.where(flat, 1, variance)[:, None])
    low = (c <= SURE) & (t > least)
    stop = np.where(low.any(1), low.argmax(1), n - 2)
    for k in np.flatnonzero((stop < n - 2) & ~flat):
        while stop[k] < n - 2 and abs(c[k, stop[k]]) <= SURE:
            lag = int(t[stop[k]])
            if (d[k, : n - lag] * d[k, lag:]).sum() <= 0:
                break
            later = np.flatnonzero(low[k, stop[k] + 1 :])
            stop[k] = stop[k] + 1 + later[0] if len(later) else n - 2
    g = 1 + 2 * np.where(np.arange(n - 2) < stop[:, None], c * (1 - t / n), 0).sum(1)
    return np.where(flat, 1.0, np.maximum(1.0, g))


def inefficiency(x: np.ndarray, least: int = 3) -> float:
    return float(inefficiencies(x[None], least)[0])


def _settled(x: np.ndarray, steps: int) -> np.ndarray:
    """(start, g, n_effective) of series of one length."""
    n = x.shape[1]
    out = np.tile([0.0, 1.0, float(n)], (len(x), 1))
    live = x.std(1) > 0
    if n > 2 and live.any():
        best = np.full(int(live.sum()), -np.inf)
        found = out[live]
        for start in range(0, n - 2, max(1, n // steps)):
            g = inefficiencies(x[live, start:])
            more = (n - start) / g > best  # the earliest of equal ones
            best = np.where(more, (n - start) / g, best)
            found[more] = np.stack([np.full(len(g), start), g, best], 1)[more]
        out[live] = found
    return out


def equilibration(df: DataFrame, by: str, order: str, value: str, steps: int = 20) -> DataFrame:
    """by, start, g, n_effective: the start of each series from which most uncorrelated samples remain; 0 for a flat one.

    Starts are tried at `steps` even places. Series of one length are worked on at
    once; a series is held whole, which its frames bound.
    """
    rows = df.select(by, order, F.col(value).cast("double").alias("__v"))
    schema = f"{by} {dict(df.dtypes)[by]}, start long, g double, n_effective double"
    kind = rows.select(by).limit(0).toArrow().schema.field(0).type

    def solved(held: list[tuple[object, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.array([len(x) for _, x in held])
        out = np.zeros((len(held), 3))
        for n in np.unique(lengths):
            same = np.flatnonzero(lengths == n)
            for a in range(0, len(same), max(1, FRAMES // int(n))):
                some = same[a : a + max(1, FRAMES // int(n))]
                out[some] = _settled(np.stack([held[k][1] for k in some]), steps)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], kind), pa.array(out[:, 0].astype(np.int64)), pa.array(out[:, 1]), pa.array(out[:, 2])], [by, "start", "g", "n_effective"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, np.ndarray]] = []
        open_: list[np.ndarray] = []
        size, key, began = 0, None, False
        for batch in batches:
            keys, v = batch.column(0).to_pylist(), batch.column("__v").to_numpy(zero_copy_only=False)
            new = {k for k in range(len(keys)) if (keys[k] != keys[k - 1] if k else not began or keys[0] != key)}
            bounds = sorted(new | {0, len(keys)})
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a in new:
                    if began:
                        held.append((key, np.concatenate(open_)))
                        if size > FRAMES:
                            yield solved(held)
                            held, size = [], 0
                    key, began, open_ = keys[a], True, []
                open_.append(v[a:b])
                size += b - a
        if began:
            yield solved([*held, (key, np.concatenate(open_))])

    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)
