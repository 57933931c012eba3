"""Contrasts, additive interaction, standardised risks and other readings of fitted models."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recode import holds
from ..operators.reshape import set_to_each_level
from .design import Cat, design_columns
from .glm import Fit, Model, class_shares, predicted

HAND = 1.96
EXACT = 1.959963984540054


def p_value(z: float) -> float | None:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2)) if math.isfinite(z) else None


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-square for whole degrees of freedom, by its finite series."""
    x = max(x, 0.0)
    if df <= 0:
        return 1.0 if x == 0 else 0.0
    half = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df + 1) // 2):
        total += math.exp(-half) * term
        term *= half / (i + 0.5)
    return total


def number(v) -> float | None:
    return None if v is None or not math.isfinite(v) else float(v)


def estimable(fit: Fit, c: np.ndarray) -> bool:
    """Whether c lies in the row space of the design, so that every solution gives the same sum."""
    if fit.rank >= len(fit.names) or not np.isfinite(fit.bread).all():
        return True
    inside = fit.bread @ (np.linalg.pinv(fit.bread, rcond=1e-9) @ c)
    return bool(np.abs(inside - c).max() < 1e-6)


def exponential(v: float) -> float:
    """exp, infinite where a double cannot hold it."""
    return math.exp(v) if not v > 709 else math.inf


def linear(fit: Fit, weights: Mapping[str, float]) -> tuple[float, float]:
    """Estimate and standard error of a weighted sum of coefficients.

    NaN if a coefficient is absent, or if the data do not determine the sum (a rank too small).
    """
    if not all(fit.has(name) for name in weights):
        return math.nan, math.nan
    c = np.zeros(len(fit.names))
    for name, value in weights.items():
        c[fit.at(name)] = value
    if not estimable(fit, c):
        return math.nan, math.nan
    return float(c @ fit.beta), float(math.sqrt(max(c @ fit.cov @ c, 0.0)))


def ratio(fit: Fit, weights: Mapping[str, float], critical: float = HAND, sign: float = 1.0) -> dict:
    """A contrast of coefficients as a ratio with its interval."""
    estimate, se = linear(fit, weights)
    estimate *= sign
    z = estimate / se if se > 0 else float("nan")
    return {
        "estimate": number(exponential(estimate)),
        "se_log": number(se),
        "ci_low": number(exponential(estimate - critical * se)),
        "ci_high": number(exponential(estimate + critical * se)),
        "p_value": p_value(z),
    }


def difference(fit: Fit, weights: Mapping[str, float], critical: float = HAND) -> dict:
    estimate, se = linear(fit, weights)
    z = estimate / se if se > 0 else float("nan")
    return {
        "estimate": number(estimate),
        "se": number(se),
        "ci_low": number(estimate - critical * se),
        "ci_high": number(estimate + critical * se),
        "p_value": p_value(z),
    }


RATIO_FIELDS = (
    "model string, comparison string, estimate double, se_log double, ci_low double, ci_high double, "
    "p_value double, n_intervals bigint, events bigint, people bigint"
)


def _support(fit: Fit) -> dict:
    return {"n_intervals": fit.n, "events": int(round(fit.events)), "people": fit.clusters}


def ratio_rows(
    fit: Fit,
    exposure: str,
    levels: Sequence,
    labels: Mapping,
    against: Sequence[tuple] = (),
) -> list[dict]:
    """Ratios of each level to the reference, and of pairs of levels; absent levels are skipped."""
    rows = []
    for level in levels:
        name = f"{exposure}[{level}]"
        if fit.has(name):
            rows.append({"model": fit.name, "comparison": labels[level], **ratio(fit, {name: 1.0}, EXACT), **_support(fit)})
    for high, low in against:
        a, b = f"{exposure}[{high}]", f"{exposure}[{low}]"
        if fit.has(a) and fit.has(b):
            rows.append(
                {
                    "model": fit.name,
                    "comparison": f"{labels[high]} vs {labels[low]}",
                    **ratio(fit, {a: 1.0, b: -1.0}),
                    **_support(fit),
                }
            )
    return rows


def absent_rows(fit: Fit, exposure: str, levels: Sequence) -> list[str]:
    return [f"{exposure}[{v}]" for v in levels if not fit.has(f"{exposure}[{v}]")]


def additive_interaction(fit: Fit, first: str, second: str, both: str) -> dict:
    """Relative excess risk due to interaction with its delta-method interval."""
    r10, r01, r11 = (math.exp(fit.beta[fit.at(t)]) for t in (first, second, both))
    gradient = np.zeros(len(fit.names))
    gradient[fit.at(first)], gradient[fit.at(second)], gradient[fit.at(both)] = -r10, -r01, r11
    value = r11 - r10 - r01 + 1
    se = math.sqrt(max(gradient @ fit.cov @ gradient, 0.0))
    return {
        "model": fit.name,
        "rr_first": r10,
        "rr_second": r01,
        "rr_both": r11,
        "reri": value,
        "se": se,
        "ci_low": value - HAND * se,
        "ci_high": value + HAND * se,
        "p_value": p_value(value / se) if se > 0 else None,
    }


RERI_FIELDS = (
    "model string, rr_first double, rr_second double, rr_both double, reri double, se double, "
    "ci_low double, ci_high double, p_value double"
)


def scenario_sums(
    df: DataFrame, models: Sequence[Model], fits: Mapping[str, Fit], exposure: str, levels: Sequence
) -> dict[tuple[str, object], tuple[float, np.ndarray]]:
    """Weighted mean risk and its gradient with everyone set to each level.

    One aggregation for all models: each row counts once per level and the sums of every
    model are taken over its own risk set. Means are computed once per row and level before
    the sums refer to them.
    """
    parts, sums, union = [], [], {}
    for i, m in enumerate(models):
        fit = fits[m.name]
        design = design_columns(m.terms, fit.levels, m.intercept)
        eta = F.lit(0.0)
        for (name, column), b in zip(design, fit.beta):
            union.setdefault(name, column)
            if b != 0:
                eta = eta + F.lit(float(b)) * column
        mean = F.exp(eta) if m.family == "poisson" else F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        inside = F.lit(True) if m.where is None else holds(m.where)
        for c in {c for t in m.terms for c in t.columns if c != exposure}:
            inside = inside & F.col(c).isNotNull()
        w = F.col(m.weight).cast("double") if m.weight else F.lit(1.0)
        parts += [F.when(inside, w).alias(f"w_{i}"), F.when(inside, mean).alias(f"m_{i}")]
        weighted = F.col(f"w_{i}") * F.col(f"m_{i}")
        slope = weighted if m.family == "poisson" else weighted * (1 - F.col(f"m_{i}"))
        sums += [F.sum(f"w_{i}").alias(f"w_{i}"), F.sum(weighted).alias(f"m_{i}")]
        places = list(union)
        sums += [
            F.sum(slope * F.col(f"x_{places.index(name)}")).alias(f"g_{i}_{j}")
            for j, (name, _) in enumerate(design)
        ]
    known = set_to_each_level(df.filter(F.col(exposure).isNotNull()), exposure, levels)
    rows = known.select(exposure, *parts, *[c.alias(f"x_{j}") for j, c in enumerate(union.values())])
    grouped = rows.groupBy(exposure).agg(*sums)
    out = {}
    for row in grouped.collect():
        for i, m in enumerate(models):
            total = row[f"w_{i}"]
            if total:
                k = len(fits[m.name].names)
                gradient = np.array([row[f"g_{i}_{j}"] for j in range(k)]) / total
                out[m.name, row[exposure]] = (row[f"m_{i}"] / total, gradient)
    return out


RISK_FIELDS = (
    "model string, scenario string, risk double, ci_low double, ci_high double, "
    "difference double, difference_low double, difference_high double, p_value double"
)


def standardised_risks(
    df: DataFrame,
    models: Sequence[Model],
    fits: Mapping[str, Fit],
    exposure: str,
    levels: Sequence,
    labels: Mapping,
    against: Sequence[tuple] = (),
) -> list[dict]:
    """Risk with everyone at each level, its difference to the first, and pairwise differences."""
    sums = scenario_sums(df, models, fits, exposure, levels)
    rows = []
    for m in models:
        cov = fits[m.name].cov
        base = sums[m.name, levels[0]][0]
        for level in levels:
            risk, g = sums[m.name, level]
            se = math.sqrt(max(g @ cov @ g, 0.0))
            rows.append(
                {
                    "model": m.name,
                    "scenario": labels[level],
                    "risk": risk,
                    "ci_low": max(0.0, risk - HAND * se),
                    "ci_high": min(1.0, risk + HAND * se),
                    "difference": risk - base,
                }
            )
        for high, low in against:
            (r1, g1), (r0, g0) = sums[m.name, high], sums[m.name, low]
            g = g1 - g0
            se = math.sqrt(max(g @ cov @ g, 0.0))
            rows.append(
                {
                    "model": m.name,
                    "scenario": f"{labels[high]} vs {labels[low]}",
                    "difference": r1 - r0,
                    "difference_low": r1 - r0 - HAND * se,
                    "difference_high": r1 - r0 + HAND * se,
                    "p_value": p_value((r1 - r0) / se) if se > 0 else None,
                }
            )
    return rows


def attenuation(before: float, after: float) -> float | None:
    """Percent by which a log ratio shrinks; undefined where there is nothing to shrink."""
    if abs(before) <= 1e-12:
        return None
    return 100 * (abs(before) - abs(after)) / abs(before)


def stratum_rows(
    fit: Fit, exposure: Cat, modifier: str, labels: Mapping, strata: Mapping, levels: Sequence, against: Sequence[tuple]
) -> list[dict]:
    """Ratios within each level (0 and 1) of a modifier crossed with the exposure."""
    rows = []

    def weights(level, sign, at):
        main = f"{exposure.column}[{level}]"
        out = {main: sign}
        if at == 1:
            out[f"{main}:{modifier}"] = sign
        return out

    for at, stratum in strata.items():
        for level in levels:
            if fit.has(f"{exposure.column}[{level}]"):
                rows.append(
                    {"model": fit.name, "stratum": stratum, "comparison": labels[level], **ratio(fit, weights(level, 1.0, at))}
                )
        for high, low in against:
            both = {**weights(high, 1.0, at), **weights(low, -1.0, at)}
            test = {
                f"{exposure.column}[{high}]:{modifier}": 1.0,
                f"{exposure.column}[{low}]:{modifier}": -1.0,
            }
            rows.append(
                {
                    "model": fit.name,
                    "stratum": stratum,
                    "comparison": f"{labels[high]} vs {labels[low]}",
                    **ratio(fit, both),
                    "p_interaction": difference(fit, test)["p_value"],
                }
            )
    return rows


STRATUM_FIELDS = (
    "model string, stratum string, comparison string, estimate double, se_log double, ci_low double, "
    "ci_high double, p_value double, p_interaction double"
)


def likelihood_ratio(full: Fit, reduced: Fit) -> dict:
    df = full.rank - reduced.rank
    stat = 2 * (full.loglik - reduced.loglik)
    return {"model": full.name, "chi2": stat, "df": df, "p_value": chi2_tail(stat, df)}


def product_of_coefficients(a: tuple[float, float], b: tuple[float, float]) -> dict:
    """Mediated effect a*b with Sobel's standard error; each pair is (estimate, se)."""
    se = math.sqrt((b[0] * a[1]) ** 2 + (a[0] * b[1]) ** 2)
    value = a[0] * b[0]
    return {
        "a": a[0],
        "b": b[0],
        "indirect": value,
        "se": se,
        "ci_low": value - HAND * se,
        "ci_high": value + HAND * se,
    }


def coefficient_rows(fit: Fit) -> list[dict]:
    rows = []
    for i, name in enumerate(fit.names):
        if name in fit.absent:
            continue
        se = math.sqrt(max(fit.cov[i, i], 0.0))
        b = float(fit.beta[i])
        rows.append(
            {
                "model": fit.name,
                "term": name,
                "estimate": b,
                "se": se,
                "ratio": math.exp(min(b, 700)),
                "ci_low": math.exp(min(b - EXACT * se, 700)),
                "ci_high": math.exp(min(b + EXACT * se, 700)),
                "p_value": p_value(b / se) if se > 0 else None,
                "n": fit.n,
            }
        )
    return rows


COEFFICIENT_FIELDS = (
    "model string, term string, estimate double, se double, ratio double, ci_low double, "
    "ci_high double, p_value double, n bigint"
)


def as_table(spark: SparkSession, rows: Sequence[Mapping], fields: str) -> DataFrame:
    """Result rows under a fixed schema; what a row lacks is NULL."""
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], fields)


BALANCE_FIELDS = "model string, term string, observed double, fitted double"


def balance(df: DataFrame, fits: Mapping[str, Fit], models: Sequence[Model]) -> DataFrame:
    """Weighted sums of every design column times the outcome, and times the fitted mean.

    A likelihood fit with its canonical link makes the two equal for each column, and only one
    coefficient vector does (where the columns are independent), so the table checks an adjusted
    fit against plain sums of the data: events by level of each category, and by number. A multinomial
    model has a row per column and class (``column|class``), the first class included, and a penalty's
    pull counts as part of the fitted sum. One pass over the rows for all models. A model
    without a fit has no rows.
    """
    named = [m for m in models if m.name in fits and fits[m.name].n]
    scored, sums, places = df, [], []
    for i, m in enumerate(named):
        fit, mean = fits[m.name], F.col(f"__mu{i}")
        many = m.family == "multinomial"
        scored = class_shares(scored, fit, m, f"__mu{i}") if many else predicted(scored, fit, m, f"__mu{i}")
        use = mean.isNotNull() & m.outcome.isNotNull()
        use = use if m.where is None else use & m.where
        weight = F.col(m.weight).cast("double") if m.weight else F.lit(1.0)
        use = use & weight.isNotNull()
        design = design_columns(m.terms, fit.levels, m.intercept)
        blocks = fit.beta.reshape(m.classes - 1 if many else 1, len(design))
        if many:  # measured from the mean over all classes, as the penalty does
            blocks = np.vstack([np.zeros(len(design)), blocks])
            blocks = blocks - blocks.mean(axis=0)
        for c, block in enumerate(blocks):
            own = (m.outcome == c).cast("double") if many else m.outcome.cast("double")
            share = F.get(mean, F.lit(c)) if many else mean
            for (name, column), b in zip(design, block):
                pull = 0.0 if name == "intercept" else m.penalty * float(b)
                places.append((m.name, f"{name}|{c}" if many else name, pull))
                k = len(places) - 1
                sums.append(F.sum(F.when(use, weight * column * own)).alias(f"o{k}"))
                sums.append(F.sum(F.when(use, weight * column * share)).alias(f"f{k}"))
    if not places:
        return df.sparkSession.createDataFrame([], BALANCE_FIELDS)
    found = scored.agg(*sums).first()
    rows = [(model, term, found[f"o{k}"], found[f"f{k}"] + pull) for k, (model, term, pull) in enumerate(places)]
    return df.sparkSession.createDataFrame(rows, BALANCE_FIELDS)
