"""The language of texts, word by word.

Method: a linear-chain conditional random field. Affix, n-gram and lexicon features and learned
transitions label the words of code-switched text by forward-backward.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import making_room
from .text_arrays import Texts, U, mixed, texts

#: Bytes of words: ASCII letters in lower case and bytes above ASCII; all others part words.
WORD_BYTES = np.full(256, 0x20, np.uint8)
WORD_BYTES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
WORD_BYTES[128:] = np.arange(128, 256)
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
AFFIX, GRAM = 4, 3
UNKNOWN = "und"


@dataclass(frozen=True)
class Crf:
    """``languages`` in order; ``weights`` by feature bucket (then one row per lexicon, and one for words in none)
    and language; ``trans`` from language to language, ``begin`` of a text's first word, all as logarithms;
    ``lexicon``: sorted word hashes, and of which language each is one."""

    languages: list[str]
    weights: np.ndarray
    trans: np.ndarray
    begin: np.ndarray
    lexicon: np.ndarray
    owner: np.ndarray


def spelled(batch: Texts) -> Texts:
    return Texts(WORD_BYTES[batch.data], batch.offsets)


def distinct_words(batch: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that are ``spelled``: each text's first word (and one more), each word's place among the distinct ones,
    and the distinct words' hashes, begins and ends."""
    begin, end, first = batch.words()
    hashes = batch.span_hashes(batch.prefix_hashes(batch.data), begin, end)
    own, at, place = np.unique(hashes, return_index=True, return_inverse=True)
    return first, place, own, begin[at], end[at]


def word_features(batch: Texts, begin: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The feature buckets of some words, one word after another, and where each word's begin (and one more).

    The word itself, its first and last 1 to 4 bytes, and its n-grams of 2 and 3 bytes.
    """
    sums = batch.prefix_hashes(batch.data)
    size, word = end - begin, np.arange(len(begin))
    found, owner = [mixed(batch.span_hashes(sums, begin, end) + U(1))], [word]
    for n in range(1, AFFIX + 1):
        has = size > n
        found += [mixed(batch.span_hashes(sums, begin[has], begin[has] + n) + U(2)), mixed(batch.span_hashes(sums, end[has] - n, end[has]) + U(3))]
        owner += [word[has], word[has]]
    for n in range(2, GRAM + 1):
        count = np.maximum(size - n + 1, 0)
        own = np.repeat(word, count)
        at = begin[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        found.append(mixed(batch.span_hashes(sums, at, at + n) + U(4)))
        owner.append(own)
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(found)[order] & U(buckets - 1)).astype(np.int64), np.searchsorted(owners[order], np.arange(len(begin) + 1))


def listed_in(hashes: np.ndarray, lexicon: np.ndarray, owner: np.ndarray, none: int) -> np.ndarray:
    """The language whose lexicon has each word, or ``none``."""
    if not len(lexicon):
        return np.full(len(hashes), none)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, owner[at], none)


def emissions(features: np.ndarray, edges: np.ndarray, lists: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The score of each distinct word for each language."""
    buckets = len(weights) - weights.shape[1] - 1
    return np.add.reduceat(weights[features], edges[:-1], axis=0) + weights[buckets + lists]


def marginals(score: np.ndarray, starts: np.ndarray, trans: np.ndarray, begin: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over many sequences laid end to end; ``starts`` marks each one's first word.

    Returns every word's probabilities, and with ``pairs`` the expected number of transitions. The chain is cut
    into runs of equal length that advance side by side: first the runs' transfer matrices,
    then from run to run, then within the runs from their known ends. A sequence's first word
    forgets what came before, so one chain holds them all.
    """
    n, k = score.shape
    length = max(8, int(np.sqrt(n)) + 1)
    runs = -(-n // length)
    e = np.ones((runs * length, k))
    e[:n] = np.exp(score - score.max(axis=1, keepdims=True))
    e = e.reshape(runs, length, k)
    new = np.ones(runs * length, bool)
    new[:n] = starts
    new = new.reshape(runs, length)
    step, first = np.exp(trans - trans.max()), np.exp(begin - begin.max())

    def advance(a: np.ndarray, at: int) -> np.ndarray:
        """One word further, for row vectors (runs, k) or matrices (runs, k, k)."""
        moved = (a.reshape(-1, k) @ step).reshape(a.shape)
        if new[:, at].any():
            moved[new[:, at]] = a[new[:, at]].sum(-1, keepdims=True) * first
        return moved * (e[:, at] if a.ndim == 2 else e[:, None, at])

    through = np.broadcast_to(np.eye(k), (runs, k, k)).copy()
    for at in range(length):
        through = advance(through, at)
        through /= through.sum((1, 2), keepdims=True)
    into, out = np.full((runs, k), 1.0 / k), np.full((runs, k), 1.0 / k)
    for r in range(1, runs):
        into[r] = into[r - 1] @ through[r - 1]
        into[r] /= into[r].sum()
    for r in range(runs - 2, -1, -1):
        out[r] = through[r + 1] @ out[r + 1]
        out[r] /= out[r].sum()
    forward = np.empty((length + 1, runs, k))
    forward[0] = into
    for at in range(length):
        a = advance(forward[at], at)
        forward[at + 1] = a / a.sum(1, keepdims=True)
    probability, moves, back = np.empty((runs, length, k)), np.zeros((k, k)), out
    for at in range(length - 1, -1, -1):
        p = forward[at + 1] * back
        probability[:, at] = p / p.sum(1, keepdims=True)
        ahead = e[:, at] * back
        if pairs:
            own = ~new[:, at]
            joint = forward[at][own][:, :, None] * step * ahead[own][:, None, :]
            moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = ahead @ step.T
        back[new[:, at]] = 1.0
        back /= back.sum(1, keepdims=True)
    return probability.reshape(-1, k)[:n], moves if pairs else None


def fit(
    sequences: list[tuple[bytes, np.ndarray]],
    languages: list[str],
    lexicon: np.ndarray,
    owner: np.ndarray,
    buckets: int,
    rounds: int,
    rate: float,
    penalty: float,
) -> Crf:
    """Gradient ascent (Adam, all sequences a round) on the conditional likelihood of the words' labels."""
    k = len(languages)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s, _ in sequences])]).astype(np.int64)
    batch = spelled(Texts(np.frombuffer(b"".join(s for s, _ in sequences), np.uint8), offsets))
    first, place, hashes, begin, end = distinct_words(batch)
    labels = np.concatenate([y for _, y in sequences])
    starts = np.zeros(len(place), bool)
    starts[first[:-1][np.diff(first) > 0]] = True
    features, edges = word_features(batch, begin, end, buckets)
    lists = listed_in(hashes, lexicon, owner, k)
    used, features = np.unique(features, return_inverse=True)
    weights = np.zeros((len(used) + k + 1, k))
    parts = [weights, np.zeros((k, k)), np.zeros(k)]
    memory = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    inner = np.flatnonzero(~starts)
    counted = np.zeros((k, k))
    np.add.at(counted, (labels[inner - 1], labels[inner]), 1.0)
    repeat = np.diff(edges)
    for turn in range(1, rounds + 1):
        p, moves = marginals(emissions(features, edges, lists, parts[0])[place], starts, parts[1], parts[2], pairs=True)
        p[np.arange(len(p)), labels] -= 1.0
        by_word = np.stack([np.bincount(place, p[:, c], len(hashes)) for c in range(k)], 1)
        spread = np.repeat(by_word, repeat, axis=0)
        gradient = np.concatenate(
            [
                np.stack([np.bincount(features, spread[:, c], len(used)) for c in range(k)], 1),
                np.stack([np.bincount(lists, by_word[:, c], k + 1) for c in range(k)], 1),
            ]
        )
        for i, g in enumerate((gradient / len(p) + penalty * parts[0], (moves - counted) / len(p), p[starts].sum(0) / len(p))):
            m, s = memory[i]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            parts[i] = parts[i] - rate * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.99**turn)) + 1e-8)
    full = np.zeros((buckets + k + 1, k), np.float32)
    full[used] = parts[0][: len(used)]
    full[buckets:] = parts[0][len(used) :]
    return Crf(languages, full, parts[1], parts[2], lexicon, owner)


def lexicons(known: DataFrame, languages: list[str], most_words: int, least: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Words that mark a language, from counts over all rows of ``known`` (``text`` and ``label``).

    A word belongs to a language if ``least`` or more documents have it and ``share`` of them are in that
    language; of each language the ``most_words`` found in most documents are kept.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches, "text"):
            first, place, hashes, _, _ = distinct_words(spelled(own))
            text = np.repeat(np.arange(len(own)), np.diff(first))
            once = np.unique(text.astype(np.int64) * (len(hashes) + 1) + place) if len(hashes) else np.zeros(0, np.int64)
            label = batch.column("label").to_numpy()[once // (len(hashes) + 1)]
            pairs, n = np.unique(label.astype(np.int64) * (len(hashes) + 1) + once % (len(hashes) + 1), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[pairs % (len(hashes) + 1)].view(np.int64), pa.int64()),
                    pa.array((pairs // (len(hashes) + 1)).astype(np.int32), pa.int32()),
                    pa.array(n, pa.int64()),
                ],
                names=["word", "label", "n"],
            )

    counted = known.select("label", F.col("text").cast("binary").alias("text")).mapInArrow(count, "word long, label int, n long")
    sides = [F.sum(F.when(F.col("label") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(languages))]
    words = counted.groupBy("word").agg(F.sum("n").alias("n"), *sides).where(F.col("n") >= least)
    top = F.greatest(*[f"n{i}" for i in range(len(languages))]) if len(languages) > 1 else F.col("n0")
    best = words.select("word", "n", top.alias("top"), F.array_position(F.array(*[f"n{i}" for i in range(len(languages))]), top).alias("label"))
    marking = best.where(F.col("top") >= share * F.col("n"))
    ranked = marking.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("top"), "word")))
    rows = ranked.where(F.col("rank") <= most_words).select("word", "label").collect()  # most_words a language
    hashes = np.array([r["word"] for r in rows], dtype=np.int64).view(np.uint64)
    owner = np.array([r["label"] - 1 for r in rows], dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], owner[order]


def train(
    docs: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    most_rows: int = 600,
    windows: int = 3,
    width: int = 24,
    most_languages: int = 64,
    most_words: int = 1000,
    least: int = 5,
    share: float = 0.9,
    buckets: int = 1 << 17,
    rounds: int = 60,
    rate: float = 0.1,
    penalty: float = 1e-6,
    seed: int = 12,
) -> Crf:
    """Learn from the rows of ``docs`` with a label and a text.

    The lexicons count words over all of these rows. The field itself is fitted on a bounded sample (parameters): of each
    language ``most_rows`` rows, those of the smallest hash of ``key`` and text, and of each row up to
    ``windows`` runs of ``width`` words at hashed places. A word's label is its document's. Single-language
    runs alone would teach that languages never change, so half of the training sequences join runs of
    4 words or more from up to four languages; how often they change is a choice of the training, not of the corpus.

    Rows with a NULL label or text, or without words, teach nothing. Repeated rows are counted again in the
    lexicons and may be drawn again. The languages are the labels in order, ``most_languages`` at most
    (more raise); none at all give a model that knows no language.
    """
    found = (
        docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()
    )
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    found.sort(key=lambda r: r["l"])
    languages, k = [r["l"] for r in found], len(found)
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if k < 2:
        return Crf(languages, np.zeros((buckets + k + 1, k), np.float32), np.zeros((k, k)), np.zeros(k), *nothing)
    number = F.lit(None).cast("int")
    for i, name in enumerate(languages):
        number = F.when(F.col(label) == name, i).otherwise(number)
    hashed = F.xxhash64(F.col(key), F.col(text))
    known = docs.select(number.alias("label"), F.col(text).alias("text"), hashed.alias("h")).where("label IS NOT NULL AND text IS NOT NULL")
    lexicon, owner = lexicons(known, languages, most_words, least, share)
    # a threshold on the hash leaves about twice the rows wanted, so that no task ranks a whole language
    near = F.lit(False)
    for i, r in enumerate(found):
        keep = min(1.0, (2 * most_rows + 64) / r["n"])
        near = near | ((F.col("label") == i) & (F.pmod(F.col("h"), F.lit(1 << 40)) < int(keep * (1 << 40))))
    order = Window.partitionBy("label").orderBy(F.pmod(F.col("h"), F.lit(1 << 40)), "h")
    drawn = known.where(near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches, "text"):
            plain = spelled(own)
            begin, end, first = plain.words()
            label, h = batch.column("label").to_numpy(), batch.column("h").to_numpy()
            rows, labels = [], []
            for i in range(len(own)):
                n, rng = first[i + 1] - first[i], np.random.default_rng(int(h[i]) & 0xFFFFFFFF)
                for _ in range(min(windows, int(-(-n // width)))):
                    at = first[i] + int(rng.integers(0, max(1, n - width + 1)))
                    words = range(at, min(at + width, first[i + 1]))
                    rows.append(b" ".join(plain.data[begin[w] : end[w]].tobytes()[:64] for w in words))
                    labels.append(int(label[i]))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.binary())], names=["label", "words"])

    runs = sorted(
        (r["label"], bytes(r["words"])) for r in drawn.select("label", "h", F.col("text").cast("binary").alias("text")).mapInArrow(cut, "label int, words binary").collect()
    )  # windows x most_rows a language, of width words of 64 bytes at most
    if not runs:
        return Crf(languages, np.zeros((buckets + k + 1, k), np.float32), np.zeros((k, k)), np.zeros(k), *nothing)
    rng = np.random.default_rng(seed)
    runs = [runs[i] for i in rng.permutation(len(runs))]
    half, sequences = len(runs) // 2, []
    for label_of, words in runs[:half]:
        sequences.append((words, np.full(words.count(b" ") + 1, label_of)))
    at = half
    while at < len(runs):
        parts, labels = [], []
        for label_of, words in runs[at : at + int(rng.integers(2, 5))]:
            own = words.split(b" ")
            size = int(rng.integers(4, width + 1))
            parts += own[:size]
            labels += [label_of] * len(own[:size])
            at += 1
        sequences.append((b" ".join(parts), np.array(labels)))
    return fit(sequences, languages, lexicon, owner, buckets, rounds, rate, penalty)


def label_words(batch: Texts, model: Crf) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probabilities, and each text's first word (and one more); texts as they are."""
    plain = spelled(batch)
    first, place, hashes, begin, end = distinct_words(plain)
    k = len(model.languages)
    if not len(place) or not k:
        return np.zeros((len(place), k)), first
    features, edges = word_features(plain, begin, end, len(model.weights) - k - 1)
    score = emissions(features, edges, listed_in(hashes, model.lexicon, model.owner, k), model.weights)
    starts = np.zeros(len(place), bool)
    starts[first[:-1][np.diff(first) > 0]] = True
    return marginals(score[place].astype(np.float64), starts, model.trans, model.begin)[0], first


def has_letter(batch: Texts) -> np.ndarray:
    """Which texts hold a letter of any script."""
    found = np.zeros(len(batch), bool)
    inside = np.concatenate([[0], np.cumsum(ASCII_LETTER[batch.data])])
    found[:] = inside[batch.offsets[1:]] > inside[batch.offsets[:-1]]
    for i in np.flatnonzero(~found):
        own = batch.data[batch.offsets[i] : batch.offsets[i + 1]]
        found[i] = (own >= 128).any() and any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, model: Crf, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "lang_words")) -> DataFrame:
    """Add the predicted language, its score, and the expected words of each language to every row.

    Every word of the whole text is labelled by forward-backward; the language with the largest
    sum of probabilities is predicted (ties: the first in order), and the score is its share of the words. NULL texts
    and those without a letter are ``und`` with score 0 and no words, as is every text if no
    language was learned. All columns stay; one that bears an output's name is returned as ``score_own``
    and so on. Memory is in proportion to the longest text. The model is broadcast as plain arrays; its
    size is set by ``train``.
    """
    docs = making_room(docs, names)
    sent = docs.sparkSession.sparkContext.broadcast(
        (list(model.languages), model.weights, model.trans, model.begin, model.lexicon, model.owner)
    )
    own_names = [f.name for f in docs.schema.fields]
    counts = T.ArrayType(T.DoubleType())
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], counts)])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Crf(*sent.value)
        for batch, own in texts(batches, text, 1 << 18):
            p, first = label_words(own, known)
            sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
            total = sums[first[1:]] - sums[first[:-1]]
            usable = has_letter(own) & (np.diff(first) > 0) & (p.shape[1] > 0)
            best = total.argmax(1) if p.shape[1] else np.zeros(len(own), np.int64)
            share = np.zeros(len(own))
            share[usable] = total[usable, best[usable]] / np.diff(first)[usable]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in own_names],
                    pa.array([known.languages[b] if u else UNKNOWN for b, u in zip(best, usable, strict=True)], pa.string()),
                    pa.array(np.clip(share, 0, 1), pa.float64()),
                    pa.array([list(t) if u else [] for t, u in zip(total, usable, strict=True)], pa.list_(pa.float64())),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(label, schema)
