"""Adjacent-wave intervals of a panel: origin and destination, death and censoring."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recode import flag, holds
from .sequences import add_next_wave


def destination_state(dead: Column, known_alive: Column, living: Column, death_code: int) -> Column:
    """Death is absorbing; a living state counts only when the person is known to be alive."""
    return F.when(holds(dead), death_code).when(holds(known_alive) & living.isNotNull(), living)


def vital_outcome(code: Column, dead_codes=(5,), alive_codes=(1, 4)) -> Column:
    """1 dead, 0 alive, NULL unknown."""
    return F.when(code.isin(*dead_codes), 1).when(code.isin(*alive_codes), 0)


def origin_destination(
    panel: DataFrame,
    key: str,
    wave: str,
    state: str,
    dead: Column,
    known_alive: Column | None = None,
    eligible: Column | None = None,
    death_code: int = 3,
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per eligible origin with its destination, which is NULL when censored.

    ``dead`` and ``known_alive`` say what is known at the next wave; they may use
    ``__has_next``, ``__is_last`` and the columns of ``carry``.
    """
    paired = add_next_wave(panel, key, wave, {"__living": F.col(state), **(carry or {})})
    alive = F.col("__has_next") if known_alive is None else known_alive
    out = paired.withColumn(
        "destination_state", destination_state(dead, alive, F.col("__living"), death_code)
    ).withColumn("known_dead", flag(dead))
    out = out.withColumn("outcome_observed", F.col("destination_state").isNotNull().cast("int"))
    if eligible is not None:
        out = out.filter(holds(eligible))
    return out.drop("__living", "__has_next", "__is_last", *(carry or {}))


def mortality_intervals(
    panel: DataFrame, key: str, wave: str, next_dead: Column, eligible: Column
) -> DataFrame:
    """Eligible intervals with a known vital outcome (``next_dead`` is 1, 0 or NULL)."""
    return panel.withColumn("death", next_dead.cast("int")).filter(
        holds(eligible) & F.col("death").isNotNull()
    )


def state_pairs(panel: DataFrame, key: str, wave: str, state: str, alive: str) -> DataFrame:
    """State now and at the next wave, among those seen alive with both states known."""
    paired = add_next_wave(panel, key, wave, {"to_state": F.col(state), "__alive": F.col(alive)})
    return paired.filter(
        F.col(state).isNotNull() & F.col("to_state").isNotNull() & holds(F.col("__alive") == 1)
    ).select(key, wave, F.col(state).alias("from_state"), "to_state")
