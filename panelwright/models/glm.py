"""Weighted regressions as distributed sums, many models in each pass over the data.

A row is kept once with the union of all design columns, one outcome per model (missing
outside that model's risk set) and the distinct weights. Each round of iteratively
reweighted least squares is one pass that adds up the small matrices of every model still
iterating; only those sums reach the driver, which solves systems of the size of a design.

Where every term is discrete the rows are first added up to covariate cells, whose number
does not grow with the data. Cells within the bound are iterated on directly, so the data
is scanned once. Anything larger takes the distributed passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.recode import all_present
from ..matrices import PARTS, emitted, tree_sum
from .design import Term, design_columns, find_levels, is_discrete, used_columns, declared_levels

MAX_CELLS = 50_000
MAX_ROUNDS = 40
MAX_CROSSING = 100_000
DECREMENT = 1e-16  # squared size of a step in standard errors
STALL = 1e-8  # relative change of the log-likelihood, two rounds running


@dataclass(frozen=True)
class Model:
    """One regression: outcome, terms, risk set and weights.

    ``errors`` is ``cluster`` (by the cluster column of the call), ``HC0``, ``HC1``, ``HC3``, or
    ``none`` for the inverse information alone. A ``multinomial`` outcome holds class numbers
    0..classes-1; its coefficients are those of classes 1 and up against class 0, in turn.
    ``penalty`` takes half of it times the squared coefficients other than the intercept off the
    log-likelihood. Those of a multinomial are measured from their mean over all classes, so
    it does not matter which class comes first.
    """

    name: str
    outcome: Column
    terms: tuple[Term, ...]
    where: Column | None = None
    weight: str | None = None
    family: str = "poisson"
    errors: str = "cluster"
    intercept: bool = True
    classes: int = 2
    penalty: float = 0.0


@dataclass
class Fit:
    name: str
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    bread: np.ndarray
    n: int
    events: float
    clusters: int
    loglik: float
    rank: int
    converged: bool
    rounds: int
    absent: list[str] = field(default_factory=list)
    error: str | None = None
    levels: dict = field(default_factory=dict)

    def at(self, name: str) -> int:
        return self.names.index(name)

    def has(self, name: str) -> bool:
        return name in self.names and name not in self.absent


def step_sums(x, y, w, n, beta, family, classes=2) -> np.ndarray:
    """One round's sums: XᵀWX, XᵀWz, log-likelihood, rows, events, sum of weights."""
    if family == "multinomial":
        return _multinomial_sums(x, y, w, n, beta, classes)
    if family == "gaussian":
        mu = np.zeros_like(y) if beta is None else x @ beta
        working, z = w, y
        loglik = -0.5 * np.sum(w * (y - mu) ** 2)
    else:
        if beta is None:
            mu = (y + 0.5) / 2
            eta = np.log(mu) if family == "poisson" else np.log(mu / (1 - mu))
        else:
            eta = np.clip(x @ beta, -30, 30)
            mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        spread = mu if family == "poisson" else mu * (1 - mu)
        working, z = w * spread, eta + (y - mu) / spread
        cumulant = mu if family == "poisson" else np.logaddexp(0, eta)
        loglik = np.sum(w * (y * eta - cumulant))
    xw = x * working[:, None]
    tail = [loglik, n.sum(), (n * y).sum(), w.sum()]
    return np.concatenate([(xw.T @ x).ravel(), xw.T @ z, tail])


def _multinomial_sums(x, y, w, n, beta, classes) -> np.ndarray:
    k, others = x.shape[1], classes - 1
    beta = np.zeros(k * others) if beta is None else beta
    eta = np.clip(x @ beta.reshape(others, k).T, -30, 30)
    odds = np.exp(eta)
    p = odds / (1 + odds.sum(axis=1, keepdims=True))
    hit = y[:, None] == np.arange(1, classes)[None]
    score = np.concatenate([x.T @ (w * (hit[:, j] - p[:, j])) for j in range(others)])
    gram = np.empty((k * others, k * others))
    for a in range(others):
        for b in range(others):
            spread = w * p[:, a] * ((a == b) - p[:, b])
            gram[a * k : a * k + k, b * k : b * k + k] = (x * spread[:, None]).T @ x
    loglik = np.sum(w * ((eta * hit).sum(axis=1) - np.log1p(odds.sum(axis=1))))
    tail = [loglik, n.sum(), (n * (y > 0)).sum(), w.sum()]
    return np.concatenate([gram.ravel(), gram @ beta + score, tail])


def solve(gram: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Solution, pseudo-inverse and rank of a symmetric system; constant columns do no harm."""
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    scale = np.where(size > 0, 1 / np.where(size > 0, size, 1), 0.0)
    scaled = gram * scale[:, None] * scale[None, :]
    values, vectors = np.linalg.eigh((scaled + scaled.T) / 2)
    keep = values > max(values.max(), 0) * 1e-13
    inverse = (vectors[:, keep] / values[keep]) @ vectors[:, keep].T
    inverse = inverse * scale[:, None] * scale[None, :]
    return inverse @ right, inverse, int(keep.sum())


def mean_response(x, beta, family):
    eta = x @ beta
    if family == "gaussian":
        return eta
    eta = np.clip(eta, -30, 30)
    return np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))


def penalty_matrix(model: Model, columns: Sequence[str]) -> np.ndarray | None:
    """Second derivatives of a model's penalty by its coefficients; None without a penalty."""
    if not model.penalty:
        return None
    held = np.diag([0.0 if c == "intercept" else model.penalty for c in columns])
    if model.family != "multinomial":
        return held
    return np.kron(np.eye(model.classes - 1) - 1 / model.classes, held)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(-1, width)


@dataclass(frozen=True)
class _Plan:
    """What a task needs to know about one model: positions in the shared row layout."""

    columns: tuple[int, ...]
    weight: int | None
    family: str
    errors: str
    classes: int


class _Layout:
    """The shared rows of several models and how each reads them."""

    def __init__(self, df: DataFrame, models: Sequence[Model], cluster: str | None):
        self.models = list(models)
        self.cluster = cluster
        every = [t for m in models for t in m.terms]
        self.levels = find_levels(df, every)
        built: dict = {}

        def design(m: Model) -> list[tuple[str, Column]]:
            out = design_columns((), self.levels, m.intercept)
            for t in m.terms:
                if t not in built:
                    built[t] = design_columns([t], self.levels, intercept=False)
                out = out + built[t]
            return out

        self.designs = [design(m) for m in models]
        union: dict[str, Column] = {}
        for columns in self.designs:
            union.update(columns)
        self.union = union
        position = {name: i for i, name in enumerate(union)}
        self.weights = sorted({m.weight for m in models if m.weight})
        self.plans = [
            _Plan(
                tuple(position[name] for name, _ in columns),
                self.weights.index(m.weight) if m.weight else None,
                m.family,
                m.errors,
                m.classes,
            )
            for m, columns in zip(models, self.designs)
        ]
        self.variables = sorted({c for m in models for c in used_columns(m.terms)})
        self.outcomes: dict[tuple, Column] = {}
        self.present: dict[tuple, Column] = {}
        self.places = [self._place(m) for m in models]
        self.rows = df.select(
            *self.variables,
            *[y.alias(f"__o{i}") for i, y in enumerate(self.outcomes.values())],
            *[F.col(w).cast("double").alias(f"__w{j}") for j, w in enumerate(self.weights)],
            *([F.col(cluster).alias("__cluster")] if cluster else []),
        ).filter(reduce(or_, [self._outcome(*place).isNotNull() for place in dict.fromkeys(self.places)]))
        self.discrete = all(is_discrete(t) for t in every) and all(
            m.family != "gaussian" and not (m.errors == "HC3" and m.weight) for m in models
        )

    def _place(self, m: Model) -> tuple[int, int]:
        """Where a model's outcome within its risk set, and the columns it needs present, are kept.

        Models that share the columns ``outcome`` and ``where`` share one column of the rows, so a model
        fitted on every imputation adds none.
        """
        known = declared_levels(m.terms)
        key = (id(m.outcome), id(m.where), repr(sorted(known.items())))
        if key not in self.outcomes:
            usable = F.lit(True) if m.where is None else m.where
            for column, values in known.items():
                usable = usable & F.col(column).isin(values)  # any other value would pass for the reference
            self.outcomes[key] = F.when(usable, m.outcome.cast("double"))
        needed = [
            *used_columns(m.terms),
            *([f"__w{self.weights.index(m.weight)}"] if m.weight else []),
            *(["__cluster"] if self.cluster else []),
        ]
        if tuple(needed) not in self.present:
            self.present[tuple(needed)] = all_present(needed) if needed else F.lit(True)
        return list(self.outcomes).index(key), list(self.present).index(tuple(needed))

    def _outcome(self, outcome: int, present: int) -> Column:
        return F.when(list(self.present.values())[present], F.col(f"__o{outcome}"))

    def names(self, i: int) -> list[str]:
        names = [n for n, _ in self.designs[i]]
        if self.models[i].family != "multinomial":
            return names
        return [f"{n}|{c}" for c in range(1, self.models[i].classes) for n in names]

    def arrays(self, rows: DataFrame, *more: str) -> DataFrame:
        """The rows as ``_read`` takes them: design, distinct outcomes, and which needed columns are present."""
        return rows.select(
            F.array(*self.union.values()).alias("x"),
            F.array(*[F.col(f"__o{i}") for i in range(len(self.outcomes))]).alias("o"),
            F.array(*self.present.values()).alias("p"),
            *more,
        )

    @property
    def shape(self) -> tuple[int, int, int, list[int], list[int]]:
        """What ``_read`` needs: the widths of the three arrays, and each model's outcome and needed columns."""
        return len(self.union), len(self.outcomes), len(self.present), [o for o, _ in self.places], [p for _, p in self.places]

    def cells(self, max_cells: int):
        """Covariate cells as numpy blocks, or None when there are more than the bound."""
        keys = [*self.variables, *[f"__y{i}" for i in range(len(self.models))]]
        sums = [F.count(F.lit(1)).cast("double").alias("n")]
        for j in range(len(self.weights)):
            sums.append(F.sum(f"__w{j}").alias(f"s{j}"))
            sums.append(F.sum(F.col(f"__w{j}") * F.col(f"__w{j}")).alias(f"q{j}"))
        rows = self.rows.select("*", *[self._outcome(*place).alias(f"__y{i}") for i, place in enumerate(self.places)])
        grouped = rows.groupBy(*keys).agg(*sums)
        totals = ["n", *[f"s{j}" for j in range(len(self.weights))], *[f"q{j}" for j in range(len(self.weights))]]
        cells = grouped.select(
            F.array(*self.union.values()).alias("x"),
            F.array(*[F.col(f"__y{i}") for i in range(len(self.models))]).alias("y"),
            *totals,
        )
        cells = cells.limit(max_cells + 1).toArrow()
        if cells.num_rows > max_cells:
            return None
        cells = cells.combine_chunks()
        x = _matrix(cells.column("x").combine_chunks(), len(self.union))
        y = _matrix(cells.column("y").combine_chunks(), len(self.models))
        return x, y, {t: cells.column(t).to_numpy() for t in totals}


def fit_models(
    df: DataFrame,
    models: Sequence[Model],
    cluster: str | None = None,
    max_cells: int = MAX_CELLS,
    max_rounds: int = MAX_ROUNDS,
) -> dict[str, Fit]:
    """Fit every model; a model that cannot be fitted carries its error instead of raising."""
    layout = _Layout(df, models, cluster)
    again = not layout.discrete or any(m.errors == "cluster" for m in models)
    if again:  # cells without clustered errors need a single pass
        layout.rows = layout.rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        blocks = layout.cells(max_cells) if layout.discrete else None
        if blocks is not None:
            engine = _CellEngine(layout, blocks)
        else:
            if not again:
                layout.rows = layout.rows.persist(StorageLevel.MEMORY_AND_DISK)
            engine = _RowEngine(layout)
        return _fit(layout, engine, max_rounds)
    finally:
        layout.rows.unpersist()


def _fit(layout: _Layout, engine, max_rounds: int) -> dict[str, Fit]:
    fits: dict[str, Fit] = {}
    betas: dict[int, np.ndarray | None] = {i: None for i in range(len(layout.models))}
    before: dict[int, np.ndarray | None] = dict(betas)
    penalties = [penalty_matrix(m, [c for c, _ in d]) for m, d in zip(layout.models, layout.designs)]
    reached: dict[int, float] = {}  # the log-likelihood less the penalty
    active = set(betas)
    stalled = dict.fromkeys(betas, 0)
    for round_no in range(1, max_rounds + 1):
        sums = engine.sums({i: betas[i] for i in active})
        for i in sorted(active):
            model, names = layout.models[i], layout.names(i)
            k = len(names)
            if i not in sums or sums[i][k * k + k + 1] == 0:
                fits[model.name] = _failed(model.name, names, "no rows in the risk set")
                active.discard(i)
                continue
            gram, right = sums[i][: k * k].reshape(k, k), sums[i][k * k : k * k + k]
            loglik, n, events, _ = sums[i][k * k + k :]
            if not np.isfinite(gram).all():
                fits[model.name] = _failed(model.name, names, "sums are not finite")
                active.discard(i)
                continue
            last, unseen, value = betas[i], np.diag(gram) == 0, loglik
            if penalties[i] is not None:
                gram = gram + penalties[i]
                value = loglik if last is None else loglik - 0.5 * last @ penalties[i] @ last
            known = reached[i] if before[i] is not None else -np.inf
            if value < known - 1e-9 * abs(known) and model.family != "gaussian":
                betas[i] = (last + before[i]) / 2  # the step went too far
                continue
            beta, inverse, rank = solve(gram, right)
            done = model.family == "gaussian" and last is not None
            if last is not None and not done:
                move = beta - last
                change = abs(value - reached[i])
                stalled[i] = stalled[i] + 1 if change < STALL * (abs(value) + 0.1) else 0
                done = float(move @ gram @ move) < DECREMENT or stalled[i] >= 2
            fits[model.name] = Fit(
                model.name, names, beta, inverse, inverse, int(n), float(events), 0,
                float(loglik), rank, bool(done), round_no,
                [c for c, d in zip(names, unseen) if d],
                None if done else "not converged", layout.levels,
            )
            before[i], betas[i], reached[i] = last, beta, value
            if done:
                active.discard(i)
        if not active:
            break
    fitted = {
        i: fits[m.name]
        for i, m in enumerate(layout.models)
        if fits[m.name].n and m.errors != "none"
    }
    for i, (meat, clusters) in engine.meats(fitted).items():
        fit, errors = fitted[i], layout.plans[i].errors
        k = len(fit.names)
        cov = fit.bread @ meat @ fit.bread
        fit.clusters = int(clusters)
        if errors == "cluster" and clusters > 1 and fit.n > k:
            cov = cov * (clusters / (clusters - 1)) * ((fit.n - 1) / (fit.n - k))
        if errors == "HC1" and layout.models[i].family == "gaussian" and fit.n > k:
            cov = cov * (fit.n / (fit.n - k))
        fit.cov = cov
    return fits


def _failed(name: str, names: list[str], error: str) -> Fit:
    k = len(names)
    gap = np.full(k, np.nan)
    return Fit(name, names, gap, np.full((k, k), np.nan), np.full((k, k), np.nan), 0, 0.0, 0, float("nan"), 0, False, 0, [], error)


def residuals(x, y, w, beta, bread, family, errors) -> np.ndarray:
    """Weighted residuals; for HC3 divided by one minus the leverage of the working weights."""
    mu = mean_response(x, beta, family)
    r = w * (y - mu)
    if errors == "HC3":
        working = w * {"gaussian": 1.0, "poisson": mu}.get(family, mu * (1 - mu))
        rest = 1 - working * np.einsum("ij,jk,ik->i", x, bread, x)
        r = np.where(rest > 1e-12, r / np.maximum(rest, 1e-12), 0.0)
    return r


class _CellEngine:
    """Iterates on covariate cells; only cluster sums go back to the rows."""

    def __init__(self, layout: _Layout, blocks):
        self.layout = layout
        x, y, totals = blocks
        self.parts = []
        for i, plan in enumerate(layout.plans):
            inside = ~np.isnan(y[:, i])
            n = totals["n"][inside]
            w = n if plan.weight is None else totals[f"s{plan.weight}"][inside]
            squares = n if plan.weight is None else totals[f"q{plan.weight}"][inside]
            self.parts.append((x[inside][:, plan.columns], y[inside, i], w, n, squares))

    def sums(self, betas):
        out = {}
        for i, beta in betas.items():
            x, y, w, n, _ = self.parts[i]
            if len(y):
                plan = self.layout.plans[i]
                out[i] = step_sums(x, y, w, n, beta, plan.family, plan.classes)
        return out

    def meats(self, fits):
        out = {}
        clustered = {}
        for i, fit in fits.items():
            if self.layout.plans[i].errors == "cluster":
                clustered[i] = fit
                continue
            x, y, _, _, squares = self.parts[i]
            plan = self.layout.plans[i]
            r = residuals(x, y, np.ones(len(y)), fit.beta, fit.bread, plan.family, plan.errors)
            out[i] = ((x * (squares * r * r)[:, None]).T @ x, 0)
        return {**out, **_cluster_meats(self.layout, clustered)}


class _RowEngine:
    """Every round is a pass over the rows."""

    def __init__(self, layout: _Layout):
        self.layout = layout
        more = [f"__w{j}" for j in range(len(layout.weights))]
        self.table = layout.arrays(layout.rows, *more)

    def sums(self, betas):
        plans, shape = self.layout.plans, self.layout.shape
        sizes = {i: len(self.layout.names(i)) for i in betas}

        def add_up(batches: Iterator[pa.RecordBatch]):
            total: dict[int, np.ndarray] = {}
            for x, y, weights, _ in _read(batches, shape, plans):
                for i, beta in betas.items():
                    inside = ~np.isnan(y[:, i])
                    if not inside.any():
                        continue
                    n = np.ones(int(inside.sum()))
                    w = n if plans[i].weight is None else weights[plans[i].weight][inside]
                    xm = x[inside][:, plans[i].columns]
                    part = step_sums(xm, y[inside, i], w, n, beta, plans[i].family, plans[i].classes)
                    total[i] = total[i] + part if i in total else part
            yield emitted({i: _packed(t, sizes[i]) for i, t in total.items()})

        return {i: _unpacked(t, sizes[i]) for i, t in tree_sum(self.table.mapInArrow(add_up, PARTS)).items()}

    def meats(self, fits):
        clustered = {i: f for i, f in fits.items() if self.layout.plans[i].errors == "cluster"}
        others = {i: (f.beta, f.bread) for i, f in fits.items() if i not in clustered}
        plans, shape = self.layout.plans, self.layout.shape
        sizes = {i: len(f.names) for i, f in fits.items()}

        def add_up(batches: Iterator[pa.RecordBatch]):
            total: dict[int, np.ndarray] = {}
            for x, y, weights, _ in _read(batches, shape, plans):
                for i, (beta, bread) in others.items():
                    inside = ~np.isnan(y[:, i])
                    xm = x[inside][:, plans[i].columns]
                    n = np.ones(len(xm))
                    w = n if plans[i].weight is None else weights[plans[i].weight][inside]
                    r = residuals(xm, y[inside, i], w, beta, bread, plans[i].family, plans[i].errors)
                    part = ((xm * (r * r)[:, None]).T @ xm).ravel()
                    total[i] = total[i] + part if i in total else part
            yield emitted({i: _packed(t, sizes[i]) for i, t in total.items()})

        out = {}
        if others:
            for i, flat in tree_sum(self.table.mapInArrow(add_up, PARTS)).items():
                k = sizes[i]
                out[i] = (_unpacked(flat, k).reshape(k, k), 0)
        return {**out, **_cluster_meats(self.layout, clustered)}


def _packed(flat: np.ndarray, k: int) -> np.ndarray:
    """A symmetric k x k matrix and what follows it, without the lower triangle."""
    return np.concatenate([flat[: k * k].reshape(k, k)[np.triu_indices(k)], flat[k * k :]])


def _unpacked(flat: np.ndarray, k: int) -> np.ndarray:
    half = k * (k + 1) // 2
    full = np.zeros((k, k))
    full[np.triu_indices(k)] = flat[:half]
    return np.concatenate([(full + np.triu(full, 1).T).ravel(), flat[half:]])


def _read(batches, shape, plans, cluster=False):
    width, outcomes, sets, which, needed = shape
    n_weights = 1 + max([p.weight for p in plans if p.weight is not None], default=-1)
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("x"), width)
        y = _matrix(batch.column("o"), outcomes)[:, which]
        y[~_matrix(batch.column("p"), sets).astype(bool)[:, needed]] = np.nan
        weights = [
            batch.column(f"__w{j}").to_numpy(zero_copy_only=False) for j in range(n_weights)
        ]
        yield x, y, weights, batch.column("__cluster") if cluster else None


def crossing_clusters(rows: DataFrame, cluster: str) -> DataFrame:
    """The clusters with rows in more than one partition of a persisted or bucketed table.

    Where the rows are already dealt by cluster (a window or join by person, a bucketed hub) this
    needs no exchange and finds none.
    """
    at = rows.select(cluster, F.spark_partition_id().alias("__at"))
    ends = at.groupBy(cluster).agg(F.min("__at").alias("lo"), F.max("__at").alias("hi"))
    return ends.filter("lo < hi").select(cluster)


def _cluster_meats(layout: _Layout, fits: dict[int, Fit]):
    """Outer products of each cluster's summed scores.

    A cluster whose rows lie in one partition is summed up there, in cluster order, and only
    k x k sums leave the task. Scores move for the clusters that cross partitions alone; with
    more than ``MAX_CROSSING`` of those, for all.
    """
    if not fits:
        return {}
    rows = layout.rows
    crossing = crossing_clusters(rows, "__cluster").limit(MAX_CROSSING + 1).collect()
    parts = []
    if len(crossing) <= MAX_CROSSING:
        inside = rows
        if crossing:
            few = F.broadcast(rows.sparkSession.createDataFrame(crossing, rows.select("__cluster").schema))
            inside = rows.join(few, "__cluster", "left_anti")
            parts.append(_meats_across(layout, fits, rows.join(few, "__cluster", "left_semi")))
        parts.append(_meats_inside(layout, fits, inside))
    else:
        parts.append(_meats_across(layout, fits, rows))
    out = {}
    for i, fit in fits.items():
        k = len(fit.names)
        found = [p[i] for p in parts if i in p]
        if found:
            flat = sum(found[1:], found[0])
            out[i] = (_unpacked(flat[:-1], k).reshape(k, k), flat[-1])
    return out


def _scores(layout: _Layout, fits: dict[int, Fit]):
    """A function from a batch of ``_read`` to each model's used rows and their scores."""
    betas = {i: f.beta for i, f in fits.items()}
    plans = layout.plans

    def of(x, y, weights):
        for i, beta in betas.items():
            inside = ~np.isnan(y[:, i])
            if not inside.any():
                continue
            xm = x[inside][:, plans[i].columns]
            r = y[inside, i] - mean_response(xm, beta, plans[i].family)
            if plans[i].weight is not None:
                r = r * weights[plans[i].weight][inside]
            yield i, inside, xm * r[:, None]

    return of


def _outer(s: np.ndarray) -> np.ndarray:
    """The packed sum of outer products of rows, and their number."""
    k = s.shape[1]
    return np.concatenate([_packed((s.T @ s).ravel(), k), [len(s)]])


def _meats_inside(layout: _Layout, fits: dict[int, Fit], rows: DataFrame) -> dict[int, np.ndarray]:
    plans, shape = layout.plans, layout.shape
    more = [f"__w{j}" for j in range(len(layout.weights))]
    table = layout.arrays(rows.sortWithinPartitions("__cluster"), "__cluster", *more)
    scores = _scores(layout, fits)

    def add_up(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        held: dict[int, tuple] = {}  # of each model the last cluster met and its scores so far

        def settle(i: int, sums: np.ndarray) -> None:
            part = _outer(sums)
            total[i] = total[i] + part if i in total else part

        for x, y, weights, owner in _read(batches, shape, plans, cluster=True):
            coded = owner.dictionary_encode()
            codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            for i, used, score in scores(x, y, weights):
                own = codes[used]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                summed = np.add.reduceat(score, starts, axis=0)
                if i in held:
                    if held[i][0] == names[int(own[0])].as_py():
                        summed[0] += held[i][1]
                    else:
                        settle(i, held[i][1][None])
                settle(i, summed[:-1])
                held[i] = (names[int(own[-1])].as_py(), summed[-1])
        for i, (_, last) in held.items():
            settle(i, last[None])
        yield emitted(total)

    return tree_sum(table.mapInArrow(add_up, PARTS))


def _meats_across(layout: _Layout, fits: dict[int, Fit], rows: DataFrame) -> dict[int, np.ndarray]:
    """Scores are added up per batch, then per (model, cluster) with map-side combining."""
    plans, shape = layout.plans, layout.shape
    sizes = {i: len(f.names) for i, f in fits.items()}
    longest = max(sizes.values())
    scores_schema = StructType(
        [
            StructField("model", IntegerType()),
            StructField("__cluster", layout.rows.schema["__cluster"].dataType),
            StructField("s", ArrayType(DoubleType())),
        ]
    )
    more = [f"__w{j}" for j in range(len(layout.weights))]
    table = layout.arrays(rows, "__cluster", *more)
    scores = _scores(layout, fits)

    def add_scores(batches: Iterator[pa.RecordBatch]):
        for x, y, weights, owner in _read(batches, shape, plans, cluster=True):
            coded = owner.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for i, used, score in scores(x, y, weights):
                order = np.argsort(codes[used], kind="stable")
                own = codes[used][order]
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                summed = np.zeros((len(starts), longest))
                summed[:, : score.shape[1]] = np.add.reduceat(score[order], starts, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(starts), i, dtype=np.int32)),
                        coded.dictionary.take(pa.array(own[starts])),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, (len(starts) + 1) * longest, longest, dtype=np.int32)),
                            pa.array(summed.ravel()),
                        ),
                    ],
                    names=["model", "__cluster", "s"],
                )

    per_cluster = (
        table.mapInArrow(add_scores, scores_schema)
        .groupBy("model", "__cluster")
        .agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(longest)])
        .select("model", F.array(*[f"s{j}" for j in range(longest)]).alias("s"))
    )

    def outer(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column("model").to_numpy()
            s = _matrix(batch.column("s"), longest)
            for i in np.unique(which):
                part = _outer(s[which == i][:, : sizes[int(i)]])
                total[int(i)] = total[int(i)] + part if int(i) in total else part
        yield emitted(total)

    return tree_sum(per_cluster.mapInArrow(outer, PARTS))


def predicted(
    df: DataFrame, fit: Fit, model: Model, name: str, bounds: tuple[float, float] | None = None
) -> DataFrame:
    """The fitted mean (held within bounds) as a column; NULL where a variable is missing.

    The expression refers to the linear predictor once, so its size stays that of the design.
    """
    eta = F.lit(0.0)
    for (_, column), b in zip(design_columns(model.terms, fit.levels, model.intercept), fit.beta):
        if b != 0:
            eta = eta + F.lit(float(b)) * column
    if model.family == "poisson":
        mean = F.exp(eta)
    elif model.family == "binomial":
        mean = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
    else:
        mean = eta
    if bounds:
        mean = F.least(F.greatest(mean, F.lit(bounds[0])), F.lit(bounds[1]))
    return df.withColumn(name, F.when(all_present(used_columns(model.terms)), mean))


def class_shares(df: DataFrame, fit: Fit, model: Model, name: str) -> DataFrame:
    """Probabilities of all classes of a multinomial model, as an array (NULL where a variable is missing)."""
    design = design_columns(model.terms, fit.levels, model.intercept)
    odds = [F.lit(1.0)]
    for block in fit.beta.reshape(model.classes - 1, len(design)):
        eta = F.lit(0.0)
        for (_, column), b in zip(design, block):
            if b != 0:
                eta = eta + F.lit(float(b)) * column
        odds.append(F.exp(F.least(F.greatest(eta, F.lit(-30.0)), F.lit(30.0))))
    scored = df.withColumn("__odds", F.array(*odds))
    total = F.aggregate("__odds", F.lit(0.0), lambda a, v: a + v)
    shares = F.transform("__odds", lambda v: v / total)
    return scored.withColumn(name, F.when(all_present(used_columns(model.terms)), shares)).drop("__odds")


def own_class_probability(df: DataFrame, fit: Fit, model: Model, name: str, bounds: tuple[float, float]) -> DataFrame:
    """Probability of the class each row has, for a multinomial model (NULL where a variable is missing)."""
    scored = class_shares(df, fit, model, "__shares")
    share = F.get("__shares", model.outcome.cast("int"))
    held = F.least(F.greatest(share, F.lit(bounds[0])), F.lit(bounds[1]))
    return scored.withColumn(name, F.when(share.isNotNull(), held)).drop("__shares")


AUDIT = (
    "model string, n bigint, events double, people bigint, rank int, converged boolean, "
    "rounds int, error string"
)


def model_audit(spark, fits: dict[str, Fit]) -> DataFrame:
    """What became of each model."""
    rows = [
        (f.name, f.n, f.events, f.clusters, f.rank, f.converged, f.rounds, f.error)
        for f in fits.values()
    ]
    return spark.createDataFrame(rows, AUDIT)
