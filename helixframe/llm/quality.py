"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of `PASSAGE` bytes. Each passage is encoded by
hashed counts of byte trigrams and a few shares (capitals, digits, marks,
repetition). A hidden layer maps it to h; gated attention, the softmax over the
document's passages of w . (tanh(V h) * sigmoid(U h)), weighs the passages; the
weighted sum of h gives the score. All weights are learned together from
document labels.

The model is fitted on the driver on a bounded sample of labelled rows (`most`,
those of the least hash of doc_id) that are not held out, on all their passages (of
a repeated doc_id those of its least text). Executors encode them and send counts of
one byte, so that the driver holds about as much as the sampled texts have bytes; a
step works on AT_ONCE passages at once. Scoring reads every whole text, in slices.

Defined results: a null or empty text is one passage without bytes and has a
score; a null doc_id is held out; repeated rows are scored each; where no
labels exist the score is 0.5; an empty table gives an empty result; other
columns pass through `keep` and are never inputs. A long text takes about its
own size in memory, beside slices of constant size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import SLICE, shielded, small, table, utf8, word_hashes

PASSAGE = 512
BUCKETS = 512
SHARES = 9
HIDDEN = 24
SAMPLE = 4000
EPOCHS = 20
THRESHOLD = 0.3
AT_ONCE = 1024  # passages

_KIND = np.full(256, 5, np.uint8)  # 0 lower, 1 capital, 2 digit, 3 space, 4 mark, 5 beyond ASCII or control
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_KIND[[32, 9, 10, 11, 12, 13]] = 3


def _counted(pieces: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of trigrams and of kinds of bytes for all passages of pieces (bytes, the two that follow them)."""
    size = np.array([len(p) for p, _ in pieces])
    first = np.cumsum(np.maximum(1, -(-size // PASSAGE)))
    n, first = first[-1], np.concatenate([[0], first[:-1]])
    raw = np.frombuffer(b"".join(x for p, then in pieces for x in (p, then)), np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    of = np.repeat(np.arange(len(pieces)), size)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    at = offset + begin[of]
    passage = first[of] + offset // PASSAGE
    wide = raw.astype(np.uint32)
    mixed = wide[at] * np.uint32(0x9E3779B1) + wide[at + 1] * np.uint32(0x85EBCA77) + wide[at + 2] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    bucket = (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(23)).astype(np.int64)  # the top nine bits
    counts = np.bincount(passage * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return counts, np.bincount(passage * 6 + _KIND[raw[at]], minlength=n * 6).reshape(n, 6)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One-byte features of all passages of all texts, and each text's first passage (one more entry closes it)."""
    size = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // PASSAGE)))])
    # Words that repeat the one before them, counted where they begin.
    words, from_, start = word_hashes(texts, lower=False)
    same = np.flatnonzero(words[1:] == words[:-1]) + 1
    text = np.searchsorted(from_, same, "right") - 1
    same, text = same[same > from_[text]], text[same > from_[text]]
    inside = start[same] - (np.cumsum(size + 1) - size - 1)[text]
    again = np.bincount(first[text] + inside // PASSAGE, minlength=first[-1])
    out = np.empty((first[-1], BUCKETS + SHARES), np.uint8)
    pieces, held, done = [], 0, 0
    cut = [(k, o) for k, n in enumerate(size) for o in range(0, max(1, n), SLICE)]
    for i, (k, o) in enumerate(cut):
        pieces.append((texts[k][o : o + SLICE], (texts[k][o + SLICE : o + SLICE + 2] + b"\0\0")[:2]))
        held += len(pieces[-1][0]) + PASSAGE
        if held >= SLICE or i + 1 == len(cut):
            counts, kinds = _counted(pieces)
            length = np.maximum(1, kinds.sum(axis=1))[:, None]
            to = done + len(counts)
            shares = np.concatenate([again[done:to, None] / np.maximum(1, length / 4), kinds / length, (counts > 0).sum(axis=1)[:, None] / length, length / PASSAGE], axis=1)
            out[done:to, :BUCKETS] = np.minimum(counts, 255)
            out[done:to, BUCKETS:] = np.round(255 * np.minimum(shares, 1))
            pieces, held, done = [], 0, to
    return out, first


def scaled(features: np.ndarray) -> np.ndarray:
    x = features.astype(np.float32)
    x[:, :BUCKETS] = np.log1p(x[:, :BUCKETS])
    x[:, BUCKETS:] /= 64
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """W, b: the hidden layer; V, U, w: gated attention; c, d: the score."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 7, hidden: int = HIDDEN) -> Model:
        r = np.random.default_rng(seed)
        n = BUCKETS + SHARES
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return Model({"W": draw(n, hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, 16), "U": draw(hidden, 16), "w": draw(16), "c": draw(hidden), "d": np.zeros(1, np.float32)})

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """h, the two halves of the gate, and the attention before the softmax, of each passage."""
        k = self.weights
        h = np.tanh(x @ k["W"] + k["b"])
        t, s = np.tanh(h @ k["V"]), _sigmoid(h @ k["U"])
        return h, t, s, (t * s) @ k["w"]

    def pooled(self, h: np.ndarray, a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores of the documents, attention and document of each passage, weighted sums."""
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(a - np.maximum.reduceat(a, first[:-1])[of])
        alpha = e / np.add.reduceat(e, first[:-1])[of]
        bag = np.add.reduceat(alpha[:, None] * h, first[:-1], axis=0)
        return _sigmoid(bag @ self.weights["c"] + self.weights["d"][0]), alpha, of, bag

    def forward(self, features: np.ndarray, first: np.ndarray, scale: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> tuple[np.ndarray, tuple]:
        parts = [self.encoded(scale(features[a : a + AT_ONCE])) for a in range(0, len(features), AT_ONCE)]
        h, t, s, a = (np.concatenate(x) for x in zip(*parts, strict=True))
        p, alpha, of, bag = self.pooled(h, a, first)
        return p, (h, t, s, alpha, of, bag)

    def gradients(self, features: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, scale: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> dict[str, np.ndarray]:
        """Of the weighted cross entropy; `scale` makes inputs of some features at a time."""
        k = self.weights
        p, (h, t, s, alpha, of, bag) = self.forward(features, first, scale)
        some = [slice(a, a + AT_ONCE) for a in range(0, len(features), AT_ONCE)]
        dz = (weight * (p - y) / len(y)).astype(np.float32)
        dbag = dz[:, None] * k["c"]
        da = alpha * np.einsum("ij,ij->i", dbag[of], h - bag[of])  # through the softmax
        dts = da[:, None] * k["w"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (alpha[:, None] * dbag[of] + dt @ k["V"].T + ds @ k["U"].T) * (1 - h * h)
        return {"W": sum(scale(features[c]).T @ dh[c] for c in some), "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ da, "c": bag.T @ dz, "d": dz.sum(keepdims=True)}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.clip(self.forward(*passages(texts), scaled)[0], 0, 1)


def train(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the cross entropy, the rarer label weighing as much as the other."""
    model, r = Model.fresh(seed), np.random.default_rng(seed)
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first, second = ({n: np.zeros_like(v) for n, v in model.weights.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        slow = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            x = np.concatenate([bags[i] for i in some])
            begin = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
            step += 1
            for n, g in model.gradients(x, begin, y[some], weight[some], scaled).items():
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                model.weights[n] -= slow * (move + decay * model.weights[n])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model | None:
    """A model from labelled rows that aren't held out; None without two labels."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, and so broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                bags = [passages([t or b""])[0] for t in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([b.tobytes() for b in bags], pa.binary())], ["doc_id", "quality", "bag"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text").mapInArrow(encoded, "doc_id long, quality int, bag binary").toPandas().sort_values("doc_id")
    y = found["quality"].to_numpy(np.float32)
    if len(np.unique(y)) < 2:
        return None
    return train([np.frombuffer(b, np.uint8).reshape(-1, BUCKETS + SHARES) for b in found["bag"]], y)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with a column `score`; all columns stay."""
    schema = docs.schema.simpleString()
    names = [*docs.columns, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                texts = [t or b"" for t in utf8(part.column("text"))]
                got = model.scores(texts) if model else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names)

    return docs.mapInArrow(run, f"{schema[:-1]},score:double>")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold; the columns stay."""
    own, back = shielded(docs, "text")
    return back(scored(own, fit(docs, labels)).filter(F.col("score") >= threshold))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
