"""What the operators of this folder share: tables, word rules, stored tables, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.sources.tables import stored

__all__ = ["WORD", "crc_fold", "free_name", "making_room", "running_totals", "stored", "table", "text_of", "word_count"]

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text, with NULL read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; NULL keys get NULL."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called that (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def making_room(df: DataFrame, outputs: Sequence[str]) -> DataFrame:
    """The table with columns that bear an output's name renamed: an own ``score`` becomes ``score_own``.

    Nothing of the caller is overwritten or lost, and outputs have the same names everywhere.
    """
    wanted = {o.lower() for o in outputs}
    for c in df.columns:
        if c.lower() in wanted:
            df = df.withColumnRenamed(c, free_name(df, f"{c}_own"))
    return df


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    rows: int,
    per_bucket: int = 4096,
) -> DataFrame:
    """Add ``name``: the total of ``value`` over the rows before this one in its group.

    No window spans a group. Rows are dealt to hash buckets of ``order``, of about ``per_bucket`` rows each
    (``rows`` is the table's row count); a row's total is that of the earlier buckets plus
    that of the earlier rows of its own bucket. Only the table of buckets, one row per group
    and bucket, is ordered by group. Rows equal in ``order`` are interchangeable. NULLs in
    ``group`` form a group. ``df`` is read twice and must give the same rows each time.
    """
    buckets = max(1, -(-rows // per_bucket))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn(
        "_value", value.cast("long")
    )
    keys = [*group, "_bucket"]
    sums = dealt.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    left, right = dealt.alias("l"), bases.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        left.join(right, same)
        .select("l.*", "r._base")
        .withColumn(name, F.col("_base") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .drop("_bucket", "_value", "_base")
    )
