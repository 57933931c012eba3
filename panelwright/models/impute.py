"""Multiple imputation by chained equations, and pooling of the repeated analyses.

Every draw is a function of the row's key, the imputation, the round and the column, and of
the regression used at that step. Incomplete rows are written with their current values once
a round, and a task rebuilds the values within a round from the steps of that round: the work
grows in proportion to the rounds, lineage does not grow, and a lost executor costs a
re-scan. All imputations advance in the same pass, and rows without gaps are added up once,
since only incomplete rows change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.recode import all_present
from ..matrices import PARTS, emitted, tree_sum
from ..sources.tables import stored
from .effects import HAND, number, p_value
from .glm import Fit, _matrix


def keyed_normals(keys: np.ndarray, *stream: int) -> np.ndarray:
    """Standard normals that depend only on the key and the stream numbers."""

    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    with np.errstate(over="ignore"):
        h = keys.astype(np.int64).view(np.uint64).copy()
        for s in stream:
            h = mix(h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(s + 1))
        second = mix(h + np.uint64(0x9E3779B97F4A7C15))
    u1 = ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53
    u2 = ((second >> np.uint64(11)).astype(float) + 0.5) / 2**53
    return np.sqrt(-2 * np.log(u1)) * np.cos(2 * np.pi * u2)


@dataclass(frozen=True)
class Regression:
    """A column on all others (centred), with its noise variance and coefficient covariance."""

    centre: np.ndarray
    level: float
    coef: np.ndarray
    cov: np.ndarray
    noise: float

    def draw(self, others: np.ndarray, normals: np.ndarray) -> np.ndarray:
        x = others - self.centre
        spread = np.sqrt(self.noise + np.einsum("ij,jk,ik->i", x, self.cov, x))
        return self.level + x @ self.coef + spread * normals


def evidence_ridge(gram: np.ndarray, target: int) -> Regression:
    """Ridge regression whose two precisions maximise the evidence, from a joint Gram matrix.

    The matrix is over (1, columns); gamma hyper-priors are 1e-6 on both precisions.
    """
    p = gram.shape[0] - 1
    n = gram[0, 0]
    means = gram[0, 1:] / n
    moments = gram[1:, 1:] - n * np.outer(means, means)
    rest = [j for j in range(p) if j != target]
    sxx, sxy = moments[np.ix_(rest, rest)], moments[rest, target]
    syy = max(moments[target, target], 1e-12)
    values, vectors = np.linalg.eigh((sxx + sxx.T) / 2)
    values = np.maximum(values, 0)
    along = vectors.T @ sxy
    prior, precision, old = 1.0, n / syy, None
    small = 1e-6
    for _ in range(300):
        coef = vectors @ (along / (values + prior / precision))
        residual = max(syy - 2 * coef @ sxy + coef @ sxx @ coef, 0.0)
        effective = float(np.sum(precision * values / (prior + precision * values)))
        prior = (effective + 2 * small) / (coef @ coef + 2 * small)
        precision = (n - effective + 2 * small) / (residual + 2 * small)
        if old is not None and np.abs(coef - old).sum() < 1e-3:
            break
        old = coef
    coef = vectors @ (along / (values + prior / precision))
    cov = (vectors / (prior + precision * values)) @ vectors.T
    return Regression(means[rest], float(means[target]), coef, cov, 1 / precision)


@dataclass
class Chains:
    key: str
    columns: list[str]
    start: list[float]
    draws: int
    steps: list[tuple[int, int, list[Regression]]] = field(default_factory=list)


def started(chains: Chains, values: np.ndarray) -> np.ndarray:
    """Values of every imputation before the first step, shape (draws, rows, columns)."""
    filled = np.where(np.isnan(values), np.asarray(chains.start)[None, :], values)
    return np.repeat(filled[None], chains.draws, axis=0)


def replay(chains: Chains, values: np.ndarray, keys: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The values that the chain's steps make of ``state``, which is changed."""
    gaps = np.isnan(values)
    for round_no, j, regressions in chains.steps:
        rows = np.flatnonzero(gaps[:, j])
        if not len(rows):
            continue
        rest = [c for c in range(values.shape[1]) if c != j]
        for k in range(chains.draws):
            normals = keyed_normals(keys[rows], k, round_no, j)
            state[k, rows, j] = regressions[k].draw(state[k][np.ix_(rows, rest)], normals)
    return state


def fit_chains(
    df: DataFrame, key: str, columns: Sequence[str], draws: int = 20, rounds: int = 20, seed: int = 0
) -> Chains:
    """Fit the chain of regressions; columns with fewer gaps go first within a round."""
    columns = list(columns)
    described = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)],
    ).first()
    start = [float(described[f"m{i}"]) for i in range(len(columns))]
    gaps = {i: described["n"] - described[f"c{i}"] for i in range(len(columns))}
    order = sorted((i for i in gaps if gaps[i]), key=lambda i: (gaps[i], i))
    chains = Chains(key, columns, start, draws)
    table = _inputs(df, key, columns, seed)
    complete = all_present(columns)
    width = len(columns)

    def joint(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                v = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column("v"), width)])
                part = (v.T @ v).ravel()
                total[0] = total[0] + part if total else part
        yield emitted(total)

    base = tree_sum(table.filter(complete).mapInArrow(joint, PARTS)).get(0, np.zeros((width + 1) ** 2))
    unset = F.lit(None).cast("array<double>").alias("state")
    partial = stored(table.filter(~complete).select("key_hash", "v", unset), "incomplete")
    for round_no in range(rounds if order else 0):
        now = replace(chains, steps=[])  # the steps of this round
        for j in order:
            grams = _current_grams(partial, now, order, j, width)
            regressions = [
                evidence_ridge((base + grams.get(k, 0.0)).reshape(width + 1, width + 1), j)
                for k in range(draws)
            ]
            now.steps.append((round_no, j, regressions))
        chains.steps += now.steps
        if round_no + 1 < rounds:
            partial = stored(_advanced(partial, now, order, width), "incomplete")
    return chains


def _held(batch: pa.RecordBatch, chains: Chains, order: list[int], v: np.ndarray) -> np.ndarray:
    """The values at the beginning of the round: those written after the last one, if any."""
    state = started(chains, v)
    held = batch.column("state")
    if not held.null_count:
        own = _matrix(held, chains.draws * len(order)).reshape(len(v), chains.draws, len(order))
        state[:, :, order] = own.transpose(1, 0, 2)
    return state


def _advanced(partial: DataFrame, chains: Chains, order: list[int], width: int) -> DataFrame:
    """The incomplete rows with the values of their incomplete columns after a round."""
    size = chains.draws * len(order)

    def advance(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), width)
            state = replay(chains, v, batch.column("key_hash").to_numpy(), _held(batch, chains, order, v))
            flat = np.ascontiguousarray(state[:, :, order].transpose(1, 0, 2)).ravel()
            offsets = np.arange(0, (len(v) + 1) * size, size, dtype=np.int32)
            after = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key_hash"), batch.column("v"), after], names=["key_hash", "v", "state"]
            )

    return partial.mapInArrow(advance, "key_hash long, v array<double>, state array<double>")


def _inputs(df: DataFrame, key: str, columns: Sequence[str], seed: int) -> DataFrame:
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select("*", F.xxhash64(F.lit(seed), F.col(key)).alias("key_hash"), values.alias("v"))


def _current_grams(partial: DataFrame, chains: Chains, order: list[int], target: int, width: int):
    def add_up(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), width)
            keys = batch.column("key_hash").to_numpy()
            seen = ~np.isnan(v[:, target])
            state = replay(chains, v[seen], keys[seen], _held(batch, chains, order, v)[:, seen])
            for k in range(chains.draws):
                z = np.column_stack([np.ones(state.shape[1]), state[k]])
                part = (z.T @ z).ravel()
                total[k] = total[k] + part if k in total else part
        yield emitted(total)

    return tree_sum(partial.mapInArrow(add_up, PARTS))


def completed(df: DataFrame, chains: Chains, take: Sequence[str], seed: int = 0) -> DataFrame:
    """The table with an array of the imputed values (one per draw) for each column taken."""
    kept = df.columns
    wanted = [chains.columns.index(c) for c in take]
    width = len(chains.columns)
    table = _inputs(df, chains.key, chains.columns, seed)
    drawn = [StructField(f"{c}_draws", ArrayType(DoubleType())) for c in take]
    schema = StructType([*df.schema.fields, *drawn])

    def fill(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            state = replay(chains, v, batch.column("key_hash").to_numpy(), started(chains, v))
            arrays = [batch.column(c) for c in kept]
            offsets = np.arange(0, (len(v) + 1) * chains.draws, chains.draws, dtype=np.int32)
            for j in wanted:
                flat = np.ascontiguousarray(state[:, :, j].T).ravel()
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[f"{c}_draws" for c in take]])

    return table.mapInArrow(fill, schema)


def pooled(fits: Sequence[Fit], contrasts: Mapping[str, Mapping[str, float]]) -> list[dict]:
    """Rubin's rules on contrasts of coefficients, as ratios with normal intervals."""
    m = len(fits)
    names = fits[0].names
    estimates = np.vstack([f.beta for f in fits])
    within = np.mean([f.cov for f in fits], axis=0)
    between = np.atleast_2d(np.cov(estimates, rowvar=False, ddof=1)) if m > 1 else 0 * within
    total = within + (1 + 1 / m) * between
    centre = estimates.mean(axis=0)
    rows = []
    for label, weights in contrasts.items():
        c = np.array([weights.get(n, 0.0) for n in names])
        value, se = float(c @ centre), math.sqrt(max(c @ total @ c, 0.0))
        rows.append(
            {
                "comparison": label,
                "estimate": number(math.exp(value)),
                "ci_low": number(math.exp(value - HAND * se)),
                "ci_high": number(math.exp(value + HAND * se)),
                "p_value": p_value(value / se) if se > 0 else None,
                "imputations": m,
            }
        )
    return rows


def pool_table(df: DataFrame, groups: Sequence[str], estimate: str, variance: str) -> DataFrame:
    """Rubin's rules on a table with one estimate and variance per imputation."""
    m = F.count(F.lit(1))
    within, between = F.avg(variance), F.coalesce(F.var_samp(estimate), F.lit(0.0))
    out = df.groupBy(*groups).agg(
        m.alias("imputations"),
        F.avg(estimate).alias("estimate"),
        within.alias("within"),
        between.alias("between"),
        F.sqrt(within + (1 + 1 / m) * between).alias("se"),
    )
    return out.withColumn("ci_low", F.col("estimate") - HAND * F.col("se")).withColumn(
        "ci_high", F.col("estimate") + HAND * F.col("se")
    )
