"""Inverse-probability weights: for seeing an outcome, and for a sequence of exposures."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import all_present, clip
from ..operators.quantiles import exact_quantiles
from ..operators.sequences import running_product, winsorised
from .design import Cat, Term, find_levels, used_columns
from .glm import Fit, Model, fit_models, own_class_probability, predicted


@dataclass(frozen=True)
class WeightReport:
    denominator: Fit
    numerator: Fit
    low: float
    median: float
    high: float


def observation_models(observed: str, denominator: Sequence[Term], numerator: Sequence[Term]) -> list[Model]:
    return [
        Model(name, F.col(observed), tuple(terms), family="binomial", errors="HC0")
        for name, terms in (("denominator", denominator), ("numerator", numerator))
    ]


def observation_weights(
    df: DataFrame,
    observed: str,
    denominator: Sequence[Term],
    numerator: Sequence[Term],
    bounds: tuple[float, float] = (0.02, 0.995),
    quantiles: tuple[float, float] = (0.01, 0.99),
    name: str = "iow",
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, WeightReport]:
    """Stabilised weights for an outcome that is not always seen.

    Both probabilities are fitted on all rows and bounded; their ratio is held within its
    own quantiles over the observed rows, which are the ones returned. The scored rows are
    read several times from here on: ``keep`` may write them to a table first.
    """
    models = observation_models(observed, denominator, numerator)
    fits = fit_models(df, models)
    scored = df
    for m, column in zip(models, ("p_denominator", "p_numerator")):
        scored = predicted(scored, fits[m.name], m, column, bounds)
    seen = scored.filter(F.col(observed) == 1).withColumn(
        f"{name}_raw", F.col("p_numerator") / F.col("p_denominator")
    )
    if keep:
        seen = keep(seen)
    low, middle, high = exact_quantiles(seen, f"{name}_raw", [quantiles[0], 0.5, quantiles[1]])[()]
    weighted = seen.withColumn(name, clip(f"{name}_raw", low, high))
    return weighted, WeightReport(fits["denominator"], fits["numerator"], low, middle, high)


def class_probabilities(
    df: DataFrame,
    target: str,
    designs: Mapping[str, Sequence[Term]],
    bounds: tuple[float, float] = (0.0, 1.0),
    penalty: float = 0.0,
) -> DataFrame:
    """Multinomial-logit probability of the class each row has, one column per design.

    The models are fitted together in shared passes; rows with a missing class or variable
    are left out.
    """
    rows, models, fits = class_models(df, target, designs, penalty)
    for m in models:
        rows = own_class_probability(rows, fits[m.name], m, m.name, bounds)
    return rows


def class_models(
    df: DataFrame, target: str, designs: Mapping[str, Sequence[Term]], penalty: float = 0.0
) -> tuple[DataFrame, list[Model], dict[str, Fit]]:
    """The rows that every design can use, and a multinomial-logit model and fit of each design."""
    classes = find_levels(df, [Cat(target)])[target]
    code = F.array_position(F.array(*[F.lit(v) for v in classes]), F.col(target)) - 1
    models = [
        Model(name, code, tuple(terms), family="multinomial", errors="none", classes=len(classes), penalty=penalty)
        for name, terms in designs.items()
    ]
    needed = {target} | {c for m in models for c in used_columns(m.terms)}
    rows = df.filter(all_present(sorted(needed)))
    return rows, models, fit_models(rows, models)


def marginal_structural_weights(
    df: DataFrame,
    key: str,
    wave: str,
    target: str,
    denominator: Sequence[Term],
    numerator: Sequence[Term],
    bounds: tuple[float, float] = (0.01, 0.99),
    quantiles: tuple[float, float] = (0.01, 0.99),
    keep: Callable[[DataFrame], DataFrame] | None = None,
    penalty: float = 0.0,
) -> tuple[DataFrame, tuple[float, float]]:
    """Stabilised weights for the exposures up to each row, held within their quantiles."""
    designs = {"p_numerator": numerator, "p_denominator": denominator}
    scored = class_probabilities(df, target, designs, bounds, penalty)
    scored = scored.withColumn("sw_part", F.col("p_numerator") / F.col("p_denominator"))
    running = running_product(scored, key, wave, "sw_part", "sw_raw")
    if keep:
        running = keep(running)
    return winsorised(running, "sw_raw", "sw", *quantiles)
