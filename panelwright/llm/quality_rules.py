"""Repetition rules for single documents.

Method: repetition coverage. Rolling hashes of several n-gram lengths in numpy measure how many
characters lie inside duplicated n-grams and duplicated lines.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import making_room
from .text_arrays import LEADING, SPACE, Texts, U, gram_hashes, mixed, texts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Largest share of a text's word characters inside n-grams seen before, by n. Wider than the
#: rules published for web text (0.15 to 0.10), so that a short text with the same line at its
#: beginning and end stays.
GRAM_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: The same for characters in lines that repeat an earlier line.
LINE_LIMIT = 0.20


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``first``."""
    totals = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=totals[1:])
    return totals[first[1:]] - totals[first[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which have occurred before."""
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        later[order[1:][same]] = True
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
    return again, later


def _covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words that begins at one of ``at``."""
    marks = np.zeros(n + 1, np.int64)
    marks[at] += 1
    marks[at + size] -= 1  # positions are distinct, so each is counted once
    return np.cumsum(marks)[:-1] > 0


def measures(batch: Texts, lengths: tuple[int, ...], window: int) -> dict[str, np.ndarray]:
    """Counts per text: words, characters, symbols, duplicate lines, the characters inside
    n-grams that the text has had before, and the words inside ``window``-grams that it has twice or more."""
    begin, end, first = batch.words()
    n = np.diff(first)
    text = np.repeat(np.arange(len(batch)), n)
    points = np.zeros(len(batch.data) + 1, np.int64)
    np.cumsum(LEADING[batch.data], out=points[1:])
    chars = points[end] - points[begin]
    symbols = np.zeros(len(batch.data) + 1, np.int64)
    np.cumsum(SYMBOLS[batch.data], out=symbols[1:])
    sums = batch.prefix_hashes(batch.data)
    out = {
        "n_words": n,
        "word_chars": _sums(chars, first),
        "n_symbols": symbols[batch.offsets[1:]] - symbols[batch.offsets[:-1]],
    }

    own = mixed(np.arange(1, len(batch) + 1).astype(U))  # n-grams meet within a text only
    words = batch.span_hashes(sums, begin, end)
    rolling = None
    for size in range(1, max(lengths) + 1):
        rolling = gram_hashes(words, size, rolling)
        if size not in lengths:
            continue
        at = np.flatnonzero(text[: len(rolling)] == text[size - 1 :]) if len(rolling) else np.zeros(0, np.int64)
        again, later = _repeated(mixed(rolling[at] ^ own[text[at]]))
        out[f"chars_{size}"] = _sums(np.where(_covered(at[later], size, len(words)), chars, 0), first)
        if size == window:
            out["n_repeat_words"] = _sums(_covered(at[again], size, len(words)), first)

    begin, end, text = batch.lines()
    filled = np.zeros(len(batch.data) + 1, np.int64)
    np.cumsum(LEADING[batch.data] & ~SPACE[batch.data], out=filled[1:])
    chars = filled[end] - filled[begin]
    has = chars > 0
    _, later = _repeated(mixed(batch.span_hashes(sums, begin[has], end[has]) ^ own[text[has]]))
    out["n_dup_lines"] = np.bincount(text[has][later], minlength=len(batch))
    out["dup_line_chars"] = np.bincount(text[has][later], chars[has][later], minlength=len(batch)).astype(np.int64)
    return out


def repetition(
    docs: DataFrame,
    text: str = "text",
    gram_limits: Mapping[int, float] = GRAM_LIMITS,
    line_limit: float = LINE_LIMIT,
    least_words: int = 20,
    window: int = 8,
    most_repeated: int = 30,
) -> DataFrame:
    """Add counts, coverage shares and verdicts to every row, texts dropped.

    Words are runs of characters other than ASCII white space; windows, n-grams and lines are
    compared exactly as written, within one text (by 64-bit hashes). ``base_failed``: fewer than
    ``least_words`` words, or more than ``most_repeated`` percent of them in ``window``-word
    windows found twice or more, first included. The method's verdict also needs each share of
    characters inside n-grams seen before in the text to be at most its limit, and that of
    characters in lines equal to an earlier one at most ``line_limit``. NULL and empty texts have no words and fail.
    Each row is judged alone, so ties and repeated rows get equal answers; there is no shuffle. An own
    column that bears an output's name is returned as ``n_words_own`` and so on.
    """
    lengths = tuple(sorted({*gram_limits, window}))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]
    counts += [f"chars_{n}" for n in lengths]
    docs = making_room(docs, [*counts, "base_failed", "kept"])
    others = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*others, *[T.StructField(c, T.LongType()) for c in counts]])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in texts(batches, text):
            found = measures(own, lengths, window)
            columns = [batch.column(f.name) for f in others] + [pa.array(found[c], pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(*[f"`{f.name}`" for f in others], F.col(text).cast("binary").alias(text))
    out = rows.mapInArrow(measured, schema).withColumn(
        "base_failed",
        (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words")),
    )
    fine = F.col("dup_line_chars") <= line_limit * F.col("word_chars")
    for n, limit in gram_limits.items():
        fine = fine & (F.col(f"chars_{n}") <= limit * F.col("word_chars"))
    return out.withColumn("kept", ~F.col("base_failed") & fine)
