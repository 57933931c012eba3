"""Wide to long, long to wide, and stacking copies of a row. Each is one pass over its input."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import assert_unique


def wide_to_long(
    wide: DataFrame,
    keep: Sequence[str],
    waves: Mapping[int, Mapping[str, Column]],
    wave: str = "wave",
) -> DataFrame:
    """One row per wave from one scan: ``waves`` gives each wave's columns by output name."""
    structs = [
        F.struct(F.lit(w).alias(wave), *[c.alias(n) for n, c in columns.items()])
        for w, columns in waves.items()
    ]
    exploded = wide.select(*keep, F.explode(F.array(*structs)).alias("__wave"))
    return exploded.select(*keep, "__wave.*")


def long_to_wide(
    long: DataFrame, key: str, by: str, values: Sequence, column: str, name: Callable[[object], str]
) -> DataFrame:
    """One column per value of ``by``; a repeated (key, by) pair fails the job."""
    pivoted = (
        assert_unique(long.select(key, by, column), [key, by], "long table")
        .groupBy(key)
        .agg(*[F.max(F.when(F.col(by) == v, F.col(column))).alias(name(v)) for v in values])
    )
    return pivoted


def stack_copies(df: DataFrame, copies: Sequence[Mapping[str, Column]]) -> DataFrame:
    """One copy of every row per entry, with that entry's columns set."""
    structs = [F.struct(*[c.alias(n) for n, c in copy.items()]) for copy in copies]
    names = list(copies[0])
    kept = [c for c in df.columns if c not in names]
    return df.select(*df.columns, F.explode(F.array(*structs)).alias("__copy")).select(
        *kept, "__copy.*"
    )


def set_to_each_level(df: DataFrame, column: str, levels: Sequence, scenario: str | None = None) -> DataFrame:
    """Each row once per level, with the column set to it (the fixed level list bounds the growth)."""
    literals = F.array(*[F.lit(v) for v in levels])
    if scenario:
        return df.withColumn(scenario, F.explode(literals))
    return df.withColumn(column, F.explode(literals))


def stack_rows(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot_row(one_row: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    """A one-row table of results as (name, value) rows."""
    entries = F.array(
        *[F.struct(F.lit(n).alias(label), F.col(n).alias(value)) for n in names]
    )
    return one_row.select(F.explode(entries).alias("__e")).select("__e.*")
