"""Many texts as one byte array: words, lines and n-gram hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Multipliers: odd, otherwise arbitrary.
BYTE_STEP = 0x9E3779B97F4A7C15
WORD_STEP = U(0xD1B54A32D192ED03)
MIX_A, MIX_B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes that begin a code point.
LEADING = (np.arange(256) & 0xC0) != 0x80


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near inputs give unrelated outputs."""
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the byte multiplier and of its inverse modulo 2^64, as long as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            for name, step in (("up", BYTE_STEP), ("down", pow(BYTE_STEP, -1, 1 << 64))):
                factors = np.full(size, U(step))
                factors[0] = U(1)
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Texts:
    """``data`` holds the texts one after another, text i in data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefix_hashes(self, data: np.ndarray) -> np.ndarray:
        up, _ = _POWERS.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:-1], out=sums[1:])
        return sums

    def span_hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, wherever it stands."""
        _, down = _POWERS.upto(len(sums))
        return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of every word, and of each text the number of its first word (and one more)."""
        inside = ~SPACE[self.data]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        edges = np.unique(self.offsets)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        first = edges[edges < len(inside)]
        begins[first] = inside[first]
        last = edges[edges > 0] - 1
        ends[last] = inside[last]
        begin = np.flatnonzero(begins)
        return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Begin, end and text of every line; texts are split at \n."""
        breaks = np.flatnonzero(self.data == 0x0A)
        text = np.concatenate([np.searchsorted(self.offsets, breaks, "right") - 1, np.arange(len(self))])
        end = np.concatenate([breaks, self.offsets[1:]])
        order = np.lexsort((end, text))
        text, end = text[order], end[order]
        begin = np.empty_like(end)
        begin[1:] = end[:-1] + 1
        new = np.ones(len(text), bool)
        new[1:] = text[1:] != text[:-1]
        begin[new] = self.offsets[text[new]]
        return begin, end, text


def texts(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the batches whose texts have about ``most`` bytes, or one longer text.

    Memory is in proportion to the larger of ``most`` and the longest text. NULL is empty.
    """
    for batch in batches:
        column_ = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        if not len(column_):
            continue
        _, raw, values = column_.buffers()
        offsets = np.frombuffer(raw, np.int64)[column_.offset : column_.offset + len(column_) + 1]
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(column_):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            to = min(to, at + 4096, len(column_))
            own = offsets[at : to + 1]
            yield batch.slice(at, to - at), Texts(data[own[0] : own[-1]], own - own[0])
            at = to


def gram_hashes(words: np.ndarray, n: int, shorter: np.ndarray | None = None) -> np.ndarray:
    """Rolling hash of every window of n words, from that of n - 1 words if given."""
    count = max(0, len(words) - n + 1)
    factor = U(pow(int(WORD_STEP), n - 1, 1 << 64))
    if shorter is not None and n > 1:
        return shorter[:count] + words[n - 1 :] * factor
    out = np.zeros(count, U)
    for k in range(n):
        out += words[k : k + count] * U(pow(int(WORD_STEP), k, 1 << 64))
    return out
