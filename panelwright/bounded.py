"""Bringing small tables to the driver only after their size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


class TooManyRows(ValueError):
    pass


def collect_bounded(df: DataFrame, max_rows: int, what: str = "result") -> list[Row]:
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise TooManyRows(f"{what} has more than {max_rows} rows")
    return rows


def join_parameters(df: DataFrame, params: DataFrame, on: list[str], max_rows: int = 50_000) -> DataFrame:
    """Left join of per-group parameters.

    The table is broadcast once it is known to be small; beyond the bound it stays a
    shuffle join, which adaptive execution splits where a group is hot.
    """
    rows = params.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df.join(params, on, "left")
    small = df.sparkSession.createDataFrame(rows, params.schema)
    return df.join(F.broadcast(small), on, "left")
