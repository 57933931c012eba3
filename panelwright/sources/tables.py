"""Reading and writing tables, and the audit documents that go with them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_delimited(
    spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Delimited text with a header. The schema is required, so that identifiers stay text."""
    table = spark.read.schema(schema).option("header", True).csv(path)
    return table.select(*columns) if columns else table


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()
) -> str:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> str:
    """Rewrite the partitions that ``df`` has rows of; all others stay as they are."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    A session on one machine may do without the setting and gets a local folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    base = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="panelwright-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write a hub table once and continue from the file.

    Later passes scan only the columns they use, lineage ends here, and a lost executor
    re-reads its files instead of rebuilding the table.
    """
    spark = df.sparkSession
    return read_table(spark, write_table(df, path or scratch_path(spark, name)))


def bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, deal: bool = True) -> DataFrame:
    """Write a hub table in buckets of ``keys``, and continue from it.

    Joins, windows and groupings by ``keys`` (or more columns) start from the buckets without
    an exchange, also between two tables of as many buckets. ``deal=False`` leaves out the
    one exchange of writing, for rows whose tasks each hold one bucket already. The table
    is listed in the session's catalogue and lies beside ``stored`` ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys) if deal else df
    dealt.write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def bucket_count(rows: int, per_bucket: int, spark: SparkSession) -> int:
    """Buckets of about ``per_bucket`` rows, and no fewer than the session's cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // per_bucket))


def audit_document(checks: DataFrame) -> DataFrame:
    """One JSON text from a one-row table of checks."""
    return checks.select(F.to_json(F.struct(*checks.columns)).alias("document"))


def grouped_map(counted: DataFrame, outer: Sequence[str], key: str, value: Column, name: str) -> DataFrame:
    """One level of a nested document: per group of ``outer`` a map from ``key`` to ``value``, keys in order.

    Meant for tables that are small already (one row per group); NULL keys are left out.
    """
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v"))), by_key)
    named = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"].cast("string").alias("k"), e["v"].alias("v"))))
    return counted.filter(F.col(key).isNotNull()).groupBy(*outer).agg(named.alias(name))


def write_audit(checks: DataFrame, path: str) -> str:
    audit_document(checks).write.mode("overwrite").text(path)
    return path


def wave_columns(
    stems: Iterable[str],
    waves: Iterable[int],
    pattern: str = "r{wave}{stem}",
    absent: Iterable[str] = (),
) -> list[str]:
    """Names of the stem-by-wave columns of a wide table, without the ones it lacks."""
    absent = set(absent)
    stems = list(stems)
    names = [pattern.format(wave=w, stem=s) for w in waves for s in stems]
    return [n for n in names if n not in absent]
