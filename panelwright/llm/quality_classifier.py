"""A quality classifier learned from labelled documents.

Method: naive Bayes support vectors. N-gram indicators are scaled by class log-count ratios, and a
linear hinge-loss model is fitted on them by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import making_room
from .text_arrays import LOWER, Texts, U, gram_hashes, mixed, texts

#: Kinds of bytes that a word's shape tells apart: lower case, upper case, digits, above ASCII, and ASCII marks as they are.
KIND = np.arange(256, dtype=np.uint8)
KIND[ord("a") : ord("z") + 1] = ord("a")
KIND[ord("A") : ord("Z") + 1] = ord("A")
KIND[ord("0") : ord("9") + 1] = ord("0")
KIND[128:] = ord("a")


@dataclass(frozen=True)
class NbSvm:
    """``weights`` of the feature buckets with the ratios multiplied in, the ratios'
    ``squares`` for a text's length, a bias, and the two numbers of the logistic curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / max(1e-9, self.squares[features].sum() ** 0.5) + self.bias)

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def feature_sets(batch: Texts, buckets: int) -> list[np.ndarray]:
    """The buckets of the n-grams that each text holds, each bucket once.

    Three kinds of n-grams: words (1 and 2, lower case), word shapes (1 to 3: kind of the first byte,
    of a middle byte and of the last two, and whether the word repeats the one before it), and
    three bytes of the lower-case text. Texts are read whole.
    """
    begin, end, first = batch.words()
    n = np.diff(first)
    text = np.repeat(np.arange(len(batch)), n)
    lower = LOWER[batch.data]
    words = batch.span_hashes(batch.prefix_hashes(lower), begin, end)
    kinds = KIND[batch.data]
    size = end - begin
    repeats = np.zeros(len(words), U)
    if len(words) > 1:
        repeats[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    shapes = (
        kinds[begin].astype(U)
        + (kinds[begin + size // 2].astype(U) << U(8))
        + (kinds[end - 1].astype(U) << U(16))
        + (kinds[np.maximum(end - 2, begin)].astype(U) << U(24))
        + (repeats << U(32))
    )
    shapes = mixed(shapes + U(1))
    hashes, owners = [], []
    for salt, tokens, sizes in ((1, words, (1, 2)), (2, shapes, (1, 2, 3))):
        rolling = None
        for g in range(1, max(sizes) + 1):
            rolling = gram_hashes(tokens, g, rolling)
            if g in sizes and len(rolling):
                inside = text[: len(rolling)] == text[g - 1 :]
                hashes.append(mixed(rolling + U(salt * 16 + g))[inside])
                owners.append(text[: len(rolling)][inside])
    if len(lower) > 2:
        three = lower[:-2].astype(U) | (lower[1:-1].astype(U) << U(8)) | (lower[2:].astype(U) << U(16))
        owner = np.repeat(np.arange(len(batch)), np.diff(batch.offsets))
        inside = owner[:-2] == owner[2:]
        hashes.append(mixed(three + (U(3) << U(32)))[inside])
        owners.append(owner[:-2][inside])
    if not hashes:
        return [np.zeros(0, np.int64) for _ in range(len(batch))]
    features = np.concatenate(hashes) & U(buckets - 1)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    features = features[order].astype(np.int64)
    edges = np.searchsorted(owner[order], np.arange(len(batch) + 1))
    seen, out = np.zeros(buckets, bool), []
    for i in range(len(batch)):
        own = features[edges[i] : edges[i + 1]]
        seen[own] = True
        out.append(np.flatnonzero(seen) if len(own) > buckets >> 4 else np.unique(own))
        seen[own] = False
    return out


def fit(sets: list[np.ndarray], labels: np.ndarray, buckets: int, cost: float, rounds: int, seed: int) -> NbSvm:
    """Log-count ratios, dual coordinate descent on the hinge loss, and a fitted probability.

    Classes weigh the same in the ratios and by frequency in the loss. The probability is a
    logistic curve fitted to held-back margins: a fifth of the rows, left out of a first fit.
    """
    rng = np.random.default_rng(seed)
    y = np.where(labels > 0, 1.0, -1.0)
    counts = {1.0: np.ones(buckets), -1.0: np.ones(buckets)}
    for own, side in zip(sets, y, strict=True):
        counts[side][own] += 1
    ratio = np.log(counts[1.0] / ((y > 0).sum() + 2)) - np.log(counts[-1.0] / ((y < 0).sum() + 2))
    norms = [max(1e-9, float(np.sqrt((ratio[own] ** 2).sum()))) for own in sets]  # each text has length 1

    def descend(rows: np.ndarray) -> tuple[np.ndarray, float]:
        # w is kept over scaled features; a constant feature carries the bias
        w, bias, dual = np.zeros(buckets), 0.0, np.zeros(len(sets))
        for _ in range(rounds):
            for i in rng.permutation(rows):
                scaled = ratio[sets[i]] / norms[i]
                gradient = y[i] * (w[sets[i]] @ scaled + bias) - 1
                new = min(max(dual[i] - gradient / 2.0, 0.0), cost)
                step, dual[i] = (new - dual[i]) * y[i], new
                if step:
                    w[sets[i]] += step * scaled
                    bias += step
        return w, bias

    def margins(rows: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
        return np.array([w[sets[i]] @ (ratio[sets[i]] / norms[i]) + bias for i in rows])

    rows = rng.permutation(len(sets))
    back, rest = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    slope, shift = 2.0, 0.0
    if len(set(y[rest])) == 2 and len(set(y[back])) == 2:
        w, bias = descend(rest)
        m, goal = margins(back, w, bias), (y[back] > 0).astype(float)
        goal = np.where(goal > 0, (goal.sum() + 1) / (goal.sum() + 2), 1 / ((1 - goal).sum() + 2))
        for _ in range(50):  # Newton steps for the logistic curve, slope kept positive
            p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
            v = p * (1 - p) + 1e-9
            a, b, c = (v * m * m).sum() + 1e-3, (v * m).sum(), v.sum() + 1e-3
            g, h = ((p - goal) * m).sum() + 1e-3 * (slope - 2), (p - goal).sum()
            det = a * c - b * b
            slope, shift = slope - (c * g - b * h) / det, shift - (a * h - b * g) / det
            slope = float(np.clip(slope, 0.1, 20))
    w, bias = descend(rows)
    return NbSvm((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, slope, float(shift))


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    label: str = "label",
    key: str = "doc_id",
    most_rows: int = 3000,
    buckets: int = 1 << 17,
    cost: float = 1.0,
    rounds: int = 8,
    seed: int = 7,
) -> NbSvm:
    """Fit on at most ``most_rows`` rows of ``labels``, those of the smallest hash of ``key``.

    The bound is a parameter; it limits what the driver holds (a set of buckets a row) and
    the broadcast that fetches the texts. Labels that are NULL or without a document are left
    out. With one class only, or none, every text gets the smoothed share of label 1.
    """
    names = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("features", T.BinaryType())])
    sample = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .select(F.col(label).cast("int").alias("_label"), F.col(key).alias("_key"))
        .orderBy(F.xxhash64("_key"), "_key", "_label")
        .limit(most_rows)
    )
    known = docs.join(F.broadcast(sample), F.col(key) == F.col("_key")).select(
        F.col("_label").alias("label"), F.col(text).cast("binary").alias("text")
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches, "text"):
            found = [x.astype("<u4").tobytes() for x in feature_sets(own, buckets)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], names=names.names)

    rows = sorted((int(r["label"]), bytes(r["features"])) for r in known.mapInArrow(encoded, names).collect())
    y = np.array([r[0] for r in rows], dtype=np.int64)
    sets = [np.frombuffer(r[1], "<u4").astype(np.int64) for r in rows]
    if len(set((y > 0).tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        none = np.zeros(buckets, np.float32)
        return NbSvm(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))
    return fit(sets, y, buckets, cost, rounds, seed)


def score(docs: DataFrame, model: NbSvm, text: str = "text", name: str = "score") -> DataFrame:
    """Add the probability of label 1 to every row; all columns stay.

    Only the text counts. NULL and empty texts hold no n-grams and get what the bias says.
    The model, one number a bucket, is broadcast as plain arrays; its size is set by ``buckets``.
    An own column called ``name`` is returned as ``<name>_own``.
    """
    docs = making_room(docs, [name])
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.squares, model.bias, model.slope, model.shift))
    names = [f.name for f in docs.schema.fields]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = NbSvm(*sent.value)
        for batch, own in texts(batches, text, 1 << 18):
            margins = np.array([known.margin(s) for s in feature_sets(own, len(known.weights))])
            found = pa.array(known.probability(margins), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], names=[*names, name])

    return docs.mapInArrow(scored, schema)
