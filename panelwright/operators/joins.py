"""Joins with declared cardinality and the lookups a panel needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CARDINALITIES = ("many_to_one", "one_to_one", "one_to_many")
MAX_HOT_KEYS = 10_000


def assert_unique(df: DataFrame, keys: Sequence[str], side: str = "table") -> DataFrame:
    """The table itself, failing the job when a key value occurs twice.

    The check is an aggregation on the key, so a join on the same key reuses its
    partitioning, and a hot duplicate is counted before the shuffle. Rows with a NULL in the
    key match nothing and may repeat; they all stay.
    """
    keyless = F.expr(" or ".join(f"`{k}` IS NULL" for k in keys))
    return _checked_unique(df.filter(~keyless), keys, side).unionByName(df.filter(keyless))


def _checked_unique(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.first(c).alias(c) for c in others]
    )
    return grouped.filter(
        F.when(F.col("__rows") == 1, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"{side}: key {list(keys)} is not unique")).cast("boolean")
        )
    ).select(*df.columns)


def checked_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    validate: str = "many_to_one",
    hot_rows: int | None = None,
) -> DataFrame:
    """A join that fails when a side declared unique has a repeated key.

    Left keys with more than ``hot_rows`` rows are joined apart, without being shuffled; give
    it where the left side is raw data whose keys may be very uneven.
    """
    if validate not in CARDINALITIES:
        raise ValueError(f"validate must be one of {CARDINALITIES}")
    if validate in ("many_to_one", "one_to_one"):
        if how in ("left", "inner"):  # rows without a key cannot match, so none is needed
            right = _checked_unique(right.dropna(subset=list(on)), on, "right side")
        else:
            right = assert_unique(right, on, "right side")
    if validate in ("one_to_many", "one_to_one"):
        left = assert_unique(left, on, "left side")
    if hot_rows is not None and validate == "many_to_one" and how in ("left", "inner"):
        return _join_hot_apart(left, right, list(on), how, hot_rows)
    return left.join(right, list(on), how)


def _join_hot_apart(
    left: DataFrame, right: DataFrame, on: list[str], how: str, hot_rows: int
) -> DataFrame:
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
    # the most frequent keys, at most MAX_HOT_KEYS: their rows of the unique side fit a broadcast
    hottest = counted.orderBy(F.desc("__n")).limit(MAX_HOT_KEYS).select(*on).collect()
    if not hottest:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(hottest, left.select(*on).schema))
    matched = F.broadcast(right.join(hot, on, "left_semi"))
    apart = left.join(hot, on, "left_semi").join(matched, on, how)
    return apart.unionByName(left.join(hot, on, "left_anti").join(right, on, how))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, name: str | None = None) -> DataFrame:
    """One column of another table by key."""
    return df.join(table.select(key, F.col(value).alias(name or value)), key, "left")


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def crosswalk_join(
    df: DataFrame, crosswalk: DataFrame, old_key: str, new_key: str, name: str
) -> DataFrame:
    """Translate an old identifier; entries without one are dropped and the first of repeats kept.

    "First" is the smallest new identifier, so that the answer does not depend on row order.
    """
    table = (
        crosswalk.filter(F.col(old_key).isNotNull())
        .groupBy(old_key)
        .agg(F.min(new_key).alias(name))
    )
    return df.join(table, old_key, "left")


def status_join(outcome: DataFrame, status: DataFrame, key: str) -> DataFrame:
    return outcome.join(status, key, "outer")


def coalescing_join(df: DataFrame, table: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    """Fill one column from another table; a value already there wins."""
    other = assert_unique(table.select(*on, F.col(column).alias("__other")), on)
    joined = df.join(other, list(on), "left")
    own = F.col(column) if column in df.columns else F.lit(None)
    return joined.withColumn(column, F.coalesce(own, F.col("__other"))).drop("__other")


def replace_columns(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Swap the columns both tables have for those of the second one."""
    stale = [c for c in table.columns if c != key and c in df.columns]
    return df.drop(*stale).join(table, key, "left")


def previous_wave_join(
    df: DataFrame, panel: DataFrame, key: str, wave: str, columns: dict[str, str]
) -> DataFrame:
    """Values of the wave just before; a skipped wave gives NULL, never an older value."""
    shifted = panel.select(
        key, (F.col(wave) + 1).alias(wave), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    return df.join(shifted, [key, wave], "left")


def landmark_join(
    people: DataFrame, intervals: DataFrame, key: str, wave: str, landmark: str
) -> DataFrame:
    """Each person's interval that starts exactly at the landmark wave, if there is one."""
    return people.join(
        intervals.withColumnRenamed(wave, landmark), [key, landmark], "left"
    )


def from_landmark_on(
    people: DataFrame, intervals: DataFrame, key: str, wave: str, landmark: str
) -> DataFrame:
    """Every interval that starts at the landmark wave or later."""
    return intervals.join(people, key, "inner").filter(F.col(wave) >= F.col(landmark))


def weighted_by_multiplicity(
    df: DataFrame, counts: DataFrame, key: str, weight: str, multiplicity: str
) -> DataFrame:
    return df.join(counts, key, "inner").withColumn(
        weight, F.col(weight) * F.col(multiplicity)
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def common_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


