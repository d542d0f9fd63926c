"""Predictions of pluggable models, one load a worker, and charge patterning.

Models of a fixed width read the first MOST_TOKENS - 2 residues of a sequence,
as the models that the adapter is for were trained; it is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_TOKENS = 602
FEW_NEUTRAL = 18
AT_ONCE = 1024  # sequences, or orders of one


def tokens(seq: Column, most: int = MOST_TOKENS) -> Column:
    """Residues apart by spaces, rare ones (U, Z, O, B) as X; two places of the most are for the ends."""
    clean = F.substring(F.regexp_replace(F.upper(seq), "[UZOB]", "X"), 1, most - 2)
    return F.regexp_replace(clean, "(.)(?=.)", "$1 ")


def predicted(df: DataFrame, seq: str, name: str, load: Callable[[], Callable[[Sequence[str]], Sequence[float]]]) -> DataFrame:
    """df with a prediction of each sequence's tokens; `load` makes the model once a worker, and must be picklable."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield pd.Series(np.asarray(model(batch.fillna("").tolist()), float))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}  # as types, which the decorator needs
    return df.withColumn(name, F.pandas_udf(run, "double")(tokens(F.col(seq))))


def long_predictions(df: DataFrame, models: dict[str, Callable]) -> DataFrame:
    """model, result, sequence: one row for each model and sequence."""
    out = None
    for name, load in models.items():
        part = predicted(df.select("sequence"), "sequence", "result", load).select(F.lit(name).alias("model"), "result", "sequence")
        out = part if out is None else out.unionByName(part)
    return out


def _asymmetries(sign: np.ndarray, blob: int) -> np.ndarray:
    """Mean squared difference of each blob's charge asymmetry from the whole sequence's, for rows of one length."""

    def sums(some: np.ndarray) -> np.ndarray:
        total = np.cumsum(np.pad(some, ((0, 0), (1, 0))), axis=1)
        return total[:, blob:] - total[:, :-blob]

    def sigma(p: np.ndarray, m: np.ndarray, n: float) -> np.ndarray:
        both = (p + m) / n
        return np.where(both > 0, ((p - m) / n) ** 2 / np.where(both > 0, both, 1), 0.0)

    plus, minus = (sign > 0).astype(np.int64), (sign < 0).astype(np.int64)
    whole = sigma(plus.sum(1), minus.sum(1), sign.shape[1])
    return ((sigma(sums(plus), sums(minus), blob) - whole[:, None]) ** 2).mean(1)


def _deltas(sign: np.ndarray) -> np.ndarray:
    return (_asymmetries(sign, 5) + _asymmetries(sign, 6)) / 2


def _delta(sign: np.ndarray) -> float:
    return float(_deltas(sign[None])[0])


@lru_cache(maxsize=100_000)
def _most_segregated(p: int, m: int, rest: int) -> float:
    """The greatest asymmetry of p positive, m negative and the other residues: charges in two runs, the others in front, between and behind.

    All orders are searched where the others are fewer than FEW_NEUTRAL or one sign
    is missing; else, as the published implementation has it, up to six of them in
    front and behind.
    """
    bound = rest if rest < FEW_NEUTRAL or not p or not m else 6
    ends = [(a, b) for a in range(bound + 1) for b in (range(min(rest - a, bound) + 1) if p and m else [rest - a])]
    orders = np.zeros((len(ends), p + m + rest), np.int8)
    for order, (a, b) in zip(orders, ends, strict=True):
        order[a : a + p] = 1
        order[len(order) - b - m : len(order) - b] = -1
    return max(float(_deltas(orders[k : k + AT_ONCE]).max()) for k in range(0, len(orders), AT_ONCE))


_SIGN = np.zeros(256, np.int8)
_SIGN[[ord(c) for c in "KR"]], _SIGN[[ord(c) for c in "DE"]] = 1, -1


def kappas(seqs: Sequence[str | None]) -> list[float | None]:
    """Charge patterning (Das and Pappu 2013): the asymmetry over blobs of 5 and 6, as a share of the most segregated order of the same residues.

    None for fewer than six residues or no charge. Sequences of one length are worked on together.
    """
    codes = [np.frombuffer((s or "").encode("ascii", "replace"), np.uint8) for s in seqs]
    length = np.array([len(c) for c in codes])
    out: list[float | None] = [None] * len(codes)
    for n in np.unique(length[length >= 6]).tolist():
        same = np.flatnonzero(length == n)
        for k in range(0, len(same), AT_ONCE):
            some = same[k : k + AT_ONCE]
            sign = _SIGN[np.stack([codes[i] for i in some])]
            delta, p, m = _deltas(sign), (sign > 0).sum(1).tolist(), (sign < 0).sum(1).tolist()
            for i, d, a, b in zip(some.tolist(), delta.tolist(), p, m, strict=True):
                if (a or b) and (most := _most_segregated(a, b, n - a - b)):
                    out[i] = min(1.0, d / most)
    return out


def kappa_of(seq: str | None) -> float | None:
    return kappas([seq])[0]


def kappa(seq: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(kappas(s.where(s.notna(), None).tolist()), index=s.index, dtype="float64"), "double")(seq)
