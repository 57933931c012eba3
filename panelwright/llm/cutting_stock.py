"""Cutting stock by column generation: which mixes of piece lengths fill a sequence."""

from __future__ import annotations

import numpy as np


def price(duals: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the pattern of largest total dual that fits."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.flatnonzero(lengths <= room)
        if len(fits):
            totals = best[room - lengths[fits]] + duals[fits]
            i = int(totals.argmax())
            if totals[i] > best[room] + 1e-12:
                best[room], choice[room] = totals[i], fits[i]
    pattern, room = np.zeros(len(lengths)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(lengths[choice[room]])
    return float(best[capacity]), pattern


def relaxed(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The linear program: fewest sequences that hold ``demand`` pieces of each length.

    Revised simplex over patterns that ``price`` generates, starting from patterns of one
    length each. Returns the basis (a pattern per column) and how often each is used. Stopped
    early it is still feasible, only with more sequences than needed.
    """
    m = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    used = inverse @ demand
    for _ in range(40 * m):
        value, pattern = price(inverse.sum(axis=0), lengths, capacity)
        if value <= 1 + 1e-7:
            break
        column = inverse @ pattern
        rows = np.flatnonzero(column > 1e-9)
        ratios = used[rows] / column[rows]
        out = int(rows[ratios.argmin()])
        amount = float(ratios.min())
        used = np.maximum(used - amount * column, 0)
        used[out] = amount
        basis[:, out] = pattern
        pivot = inverse[out] / column[out]
        inverse -= np.outer(column, pivot)
        inverse[out] = pivot
    return basis, used


def first_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Pieces left after rounding, longest first, each into the first sequence with room."""
    rooms, patterns = [], []
    for i in np.argsort(-lengths):
        for _ in range(int(counts[i])):
            at = next((k for k, room in enumerate(rooms) if room >= lengths[i]), None)
            if at is None:
                at = len(rooms)
                rooms.append(capacity)
                patterns.append(np.zeros(len(lengths), np.int64))
            rooms[at] -= lengths[i]
            patterns[at][i] += 1
    return patterns


def patterns_for(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: pieces} and how many sequences follow each; they hold every piece once.

    The solution of the linear program is rounded down; what that leaves, fewer pieces than
    a pattern has for each pattern, is packed by ``first_fit``. The work depends on the number of lengths,
    not on the number of pieces.
    """
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(n)] for n in lengths], dtype=np.int64)
    basis, used = relaxed(lengths, left.astype(float), capacity)
    out = []
    for k in np.argsort(-used):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        has = np.flatnonzero(pattern)
        times = min(int(np.floor(used[k] + 1e-9)), int((left[has] // pattern[has]).min()))
        if times > 0:
            left -= times * pattern
            out.append(({int(lengths[i]): int(pattern[i]) for i in has}, times))
    for pattern in first_fit(lengths, left, capacity):
        out.append(({int(lengths[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, 1))
    return out
