"""Gaussian mixtures with diagonal covariance, for grouping people by their trajectories.

Every class count and every start takes part in the same pass: a pass adds up each
candidate's responsibilities and moments, and the driver updates a few dozen numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..bounded import collect_bounded
from ..functions.recode import all_present
from ..matrices import PARTS, emitted, tree_sum
from .glm import _matrix

VARIANCE_FLOOR = 1e-6
MOST_SEEDS = 100_000


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    loglik: float = float("-inf")
    rounds: int = 0
    converged: bool = False
    n: int = 0

    @property
    def classes(self) -> int:
        return len(self.weights)

    @property
    def parameters(self) -> int:
        return self.classes - 1 + 2 * self.means.size

    @property
    def bic(self) -> float:
        return -2 * self.loglik + self.parameters * np.log(self.n)

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.parameters


def log_densities(x: np.ndarray, m: Mixture) -> np.ndarray:
    scaled = (x[:, None, :] - m.means[None]) ** 2 / m.variances[None]
    constant = np.log(m.weights) - 0.5 * np.log(2 * np.pi * m.variances).sum(axis=1)
    return constant[None] - 0.5 * scaled.sum(axis=2)


def _expectation(x: np.ndarray, m: Mixture) -> np.ndarray:
    logs = log_densities(x, m)
    top = logs.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    share = np.exp(logs - total[:, None])
    return np.concatenate(
        [share.sum(axis=0), (share.T @ x).ravel(), (share.T @ (x * x)).ravel(), [total.sum(), len(x)]]
    )


def _maximisation(sums: np.ndarray, k: int, d: int, before: Mixture) -> Mixture:
    size = np.maximum(sums[:k], 1e-12)
    means = sums[k : k + k * d].reshape(k, d) / size[:, None]
    squares = sums[k + k * d : k + 2 * k * d].reshape(k, d) / size[:, None]
    variances = np.maximum(squares - means**2, 0) + VARIANCE_FLOOR
    return Mixture(size / size.sum(), means, variances, float(sums[-2]), before.rounds + 1, False, int(sums[-1]))


def _uniform(hashes: np.ndarray, *stream: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row's hash and the stream alone."""
    h = hashes.view(np.uint64).copy()
    with np.errstate(over="ignore"):
        for s in (*stream, 0):
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(s + 1)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(float) / 2**53


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


def _each(table: DataFrame, d: int, measure) -> dict[int, np.ndarray]:
    """Sums over all rows of the numbered arrays that ``measure`` gives for a block of rows."""

    def add_up(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for i, part in measure(_matrix(batch.column("x"), d)):
                    total[i] = total[i] + part if i in total else part
        yield emitted(total)

    return tree_sum(table.select("x").mapInArrow(add_up, PARTS))


def spread_seeds(
    rows: DataFrame, d: int, first: Sequence[np.ndarray], drawn: float, rounds: int, seed: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each start, seeds far from one another and how many rows are nearest to each (k-means||).

    Beginning with one row a start, every round draws each row with a probability in proportion to
    its squared distance from the start's seeds so far, about ``drawn`` rows a round. Draws are hashes of the row
    (column ``h``), so re-run tasks draw the same. All starts share the passes: two a round and one to weigh.
    """
    seeds = [np.asarray(f, dtype=float).reshape(1, d) for f in first]
    for turn in range(rounds):
        now = list(seeds)
        costs = _each(rows, d, lambda x, now=now: ((s, np.array([_squared(x, c).min(axis=1).sum()])) for s, c in enumerate(now)))

        def draw(batches: Iterator[pa.RecordBatch], now=now, costs=costs, turn=turn):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, h = _matrix(batch.column("x"), d), batch.column("h").to_numpy()
                for s, c in enumerate(now):
                    if costs[s][0] > 0:
                        own = np.flatnonzero(_uniform(h, seed, s, turn) * costs[s][0] < drawn * _squared(x, c).min(axis=1))
                        if len(own):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(own), s, np.int32)), batch.column("x").take(pa.array(own))], names=["start", "x"]
                            )

        found = collect_bounded(rows.select("x", "h").mapInArrow(draw, "start int, x array<double>"), MOST_SEEDS, "mixture seeds")
        for s in range(len(seeds)):
            new = sorted(tuple(r["x"]) for r in found if r["start"] == s)
            seeds[s] = np.unique(np.concatenate([seeds[s], np.array(new).reshape(-1, d)]), axis=0)
    nearest = _each(
        rows, d, lambda x: ((s, np.bincount(_squared(x, c).argmin(axis=1), minlength=len(c)).astype(float)) for s, c in enumerate(seeds))
    )
    return [(c, nearest.get(s, np.ones(len(c)))) for s, c in enumerate(seeds)]


def _centres(seeds: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres of weighted seeds: chosen far apart, then moved to their seeds' means."""
    chosen = [seeds[rng.choice(len(seeds), p=weights / weights.sum())]]
    while len(chosen) < k:
        far = weights * _squared(seeds, np.array(chosen)).min(axis=1)
        chosen.append(seeds[rng.choice(len(seeds), p=far / far.sum())] if far.sum() > 0 else seeds[rng.integers(len(seeds))])
    centres = np.array(chosen)
    for _ in range(25):
        own = _squared(seeds, centres).argmin(axis=1)
        for j in range(k):
            if weights[own == j].sum() > 0:
                centres[j] = np.average(seeds[own == j], axis=0, weights=weights[own == j])
    return centres


def _moments(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows, sums and sums of squares of the rows nearest to each centre, laid out as an expectation step's."""
    k = len(centres)
    share = np.eye(k)[_squared(x, centres).argmin(axis=1)]
    return np.concatenate([share.sum(axis=0), (share.T @ x).ravel(), (share.T @ (x * x)).ravel(), [0.0, len(x)]])


def seeded_starts(rows: DataFrame, d: int, class_counts: Sequence[int], first, variance: np.ndarray, seed: int, passes: int = 3) -> list[Mixture]:
    """A mixture per start and class count from k-means: its clusters' shares, means and variances."""
    largest = max(class_counts)
    weighed = spread_seeds(rows, d, first, 2.0 * largest, 2, seed)
    centres = {}
    for s, (seeds, weights) in enumerate(weighed):
        for k in class_counts:
            centres[len(centres)] = _centres(seeds, weights, k, np.random.default_rng([seed, s, k]))
    for at in range(passes):
        now = dict(centres)
        sums = _each(rows, d, lambda x, now=now: ((i, _moments(x, c)) for i, c in now.items()))
        for i, c in now.items():
            k = len(c)
            size, total = sums[i][:k], sums[i][k : k + k * d].reshape(k, d)
            if at + 1 < passes:
                centres[i] = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
    out = []
    for i, c in now.items():
        m = _maximisation(sums[i], len(c), d, Mixture(np.full(len(c), 1 / len(c)), c, np.tile(variance, (len(c), 1))))
        empty = sums[i][: len(c)] == 0
        m.means[empty], m.variances[empty] = c[empty], variance
        out.append(Mixture(np.maximum(m.weights, 1e-6) / np.maximum(m.weights, 1e-6).sum(), m.means, m.variances))
    return out


def step(df: DataFrame, columns: Sequence[str], before: Mixture) -> Mixture:
    """One round of expectation and maximisation; ``loglik`` is that of ``before``."""
    d = len(columns)
    rows = df.filter(all_present(list(columns))).select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    return _maximisation(_sums(rows, {0: before}, d)[0], before.classes, d, before)


def fit_mixtures(
    df: DataFrame,
    key: str,
    columns: Sequence[str],
    class_counts: Sequence[int] = (2, 3, 4),
    starts: int = 5,
    max_rounds: int = 500,
    tolerance: float = 1e-3,
    seed: int = 0,
    seeded: bool = True,
) -> dict[int, Mixture]:
    """Best mixture of each class count over its starts.

    ``starts`` of them begin at rows picked by key hash, and with ``seeded`` as many more at k-means
    clusters of seeds spread over the rows. All advance in the same passes.
    """
    columns = list(columns)
    d = len(columns)
    rows = df.filter(all_present(columns)).select(
        key,
        F.xxhash64(F.lit(seed), F.col(key)).alias("h"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
    )
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        largest = max(class_counts)
        picks = rows.orderBy("h", key).limit(largest * starts).collect()
        if not picks:
            return {}
        spread = rows.agg(*[F.var_pop(F.col("x")[j]).alias(f"v{j}") for j in range(d)]).first()
        variance = np.array([max(spread[j] or 0.0, VARIANCE_FLOOR) for j in range(d)])
        candidates: dict[int, Mixture] = {}
        for k in class_counts:
            for s in range(starts):
                centres = np.array([picks[(s * largest + c) % len(picks)]["x"] for c in range(k)])
                candidates[len(candidates)] = Mixture(np.full(k, 1 / k), centres, np.tile(variance, (k, 1)))
        if seeded:
            first = [np.array(picks[s % len(picks)]["x"]) for s in range(starts)]
            for m in seeded_starts(rows, d, class_counts, first, variance, seed):
                candidates[len(candidates)] = m
        active = set(candidates)
        table = rows.select("x")
        while active:
            for i, sums in _sums(table, {i: candidates[i] for i in active}, d).items():
                before = candidates[i]
                after = _maximisation(sums, before.classes, d, before)
                change = abs(after.loglik - before.loglik) / after.n
                after.converged = change < tolerance
                candidates[i] = after
                if after.converged or after.rounds >= max_rounds:
                    active.discard(i)
        # the sums of a round belong to the parameters that went in: one more pass for the last ones
        for i, sums in _sums(table, candidates, d).items():
            candidates[i].loglik = float(sums[-2])
    finally:
        rows.unpersist()
    best: dict[int, Mixture] = {}
    for m in candidates.values():
        if m.classes not in best or m.loglik > best[m.classes].loglik:
            best[m.classes] = m
    return best


def _sums(table: DataFrame, mixtures: dict[int, Mixture], d: int) -> dict[int, np.ndarray]:
    return _each(table, d, lambda x: ((i, _expectation(x, m)) for i, m in mixtures.items()))


def class_column(columns: Sequence[str], m: Mixture) -> Column:
    """Most likely class (0-based) as an expression over the columns."""
    logs = []
    for c in range(m.classes):
        value = F.lit(float(np.log(m.weights[c]) - 0.5 * np.log(2 * np.pi * m.variances[c]).sum()))
        for j, name in enumerate(columns):
            value = value - (F.col(name) - float(m.means[c, j])) ** 2 / (2 * float(m.variances[c, j]))
        logs.append(value)
    at = F.array_position(F.array(*logs), F.array_max(F.array(*logs))) - 1
    return F.when(all_present(columns), at.cast("int"))


@dataclass
class Selection:
    chosen: Mixture
    choices: list[dict]
    names: list[str]


def select_mixture(
    df: DataFrame, columns: Sequence[str], fitted: dict[int, Mixture], smallest_share: float = 0.05
) -> Selection:
    """Lowest BIC among solutions whose smallest class is large enough, or among all if none is."""
    per = [
        F.struct(F.lit(k).alias("k"), class_column(columns, m).alias("c")) for k, m in fitted.items()
    ]
    counted = (
        df.filter(all_present(list(columns)))
        .select(F.explode(F.array(*per)).alias("e"))
        .groupBy("e.k", "e.c")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    sizes = {k: [0] * m.classes for k, m in fitted.items()}
    for r in counted:
        sizes[r["k"]][r["c"]] = r["n"]
    choices = [
        {
            "classes": k,
            "bic": float(m.bic),
            "aic": float(m.aic),
            "smallest_n": min(sizes[k]),
            "smallest_share": min(sizes[k]) / max(sum(sizes[k]), 1),
            "converged": m.converged,
        }
        for k, m in sorted(fitted.items())
    ]
    viable = [c for c in choices if c["smallest_share"] >= smallest_share]
    chosen = fitted[min(viable or choices, key=lambda c: c["bic"])["classes"]]
    rank = np.argsort(np.argsort(chosen.means.mean(axis=1)))
    names = [f"Class {i + 1}" for i in range(chosen.classes)]
    return Selection(chosen, choices, [names[r] for r in rank])


def with_trajectory(df: DataFrame, columns: Sequence[str], selection: Selection, name: str = "trajectory") -> DataFrame:
    names = F.array(*[F.lit(n) for n in selection.names])
    return df.withColumn(name, F.get(names, class_column(columns, selection.chosen)))


def profiles(df: DataFrame, columns: Sequence[str], trajectory: str = "trajectory") -> DataFrame:
    """Size and mean curve of each class."""
    named = df.filter(F.col(trajectory).isNotNull())
    total = named.count()
    mean_level = sum([F.avg(c) for c in columns], F.lit(0.0)) / len(columns)
    return named.groupBy(trajectory).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.count(F.lit(1)), F.lit(total)).alias("share"),
        *[F.avg(c).alias(c) for c in columns],
        mean_level.alias("mean_level"),
        (F.avg(columns[-1]) - F.avg(columns[0])).alias("change"),
    )
