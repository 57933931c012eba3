"""A person-by-wave panel made from the order tables, on which every query runs.

A customer is the person, an order year the wave. Two exposures (any urgent order, spend
at or above the median order) give a four-level state, order statuses a three-level one;
a customer without any later order counts as having reached the absorbing state, and one
missing only the next year is censored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recode import (
    as_category,
    flag,
    interval_label,
    label_of,
    ordered_level,
    two_flag_state,
)
from ..operators.intervals import origin_destination
from ..operators.quantiles import quantile
from ..sources.tables import bucket_count, bucketed, read_table

FIRST_YEAR = 1994
LAST_ORIGIN = 5
STATE_LABELS = {0: "Neither", 1: "Urgent only", 2: "High spend only", 3: "Both"}
FUNCTION_LABELS = {0: "Settled", 1: "Pending", 2: "Flagged", 3: "Gone"}
#: Moves to the worst level from the others, and the ways back from each level above the best.
KEY_TRANSITIONS = [(o, [2], f"{FUNCTION_LABELS[o]} to flagged") for o in (0, 1)] + [
    (1, [0], "Pending to settled"),
    (2, [0, 1], "Flagged to better"),
]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def status_panel(spark: SparkSession, sf_dir: str, threshold: int = 1) -> DataFrame:
    """The panel with the order-status level alone, which needs no price quantile."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    waves = orders.groupBy(
        F.col("o_custkey").alias("id"), (F.year("o_orderdate") - FIRST_YEAR).alias("wave")
    ).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(flag(F.col("o_orderstatus") == "F")).alias("n_f"),
        F.sum(flag(F.col("o_orderstatus") == "P")).alias("n_p"),
    )
    level = ordered_level("n_f", "n_p", F.lit(True), threshold)
    return waves.withColumn("functional_state", level)


def panel(spark: SparkSession, sf_dir: str, threshold: int = 1) -> DataFrame:
    orders = table(
        spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority"
    )
    cut = quantile(orders, "o_totalprice", 0.5)
    waves = orders.groupBy(
        F.col("o_custkey").alias("id"), (F.year("o_orderdate") - FIRST_YEAR).alias("wave")
    ).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.max(flag(F.col("o_orderpriority") == "1-URGENT")).alias("a"),
        F.avg("o_totalprice").alias("spend"),
        F.sum(flag(F.col("o_orderstatus") == "F")).alias("n_f"),
        F.sum(flag(F.col("o_orderstatus") == "P")).alias("n_p"),
    )
    return waves.withColumn("b", (F.col("spend") >= F.lit(cut)).cast("int")).select(
        "id",
        "wave",
        "n_orders",
        "a",
        "b",
        two_flag_state("a", "b").alias("state"),
        "n_f",
        "n_p",
        ordered_level("n_f", "n_p", F.lit(True), threshold).alias("functional_state"),
        "spend",
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed covariates. A negative balance counts as missing."""
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_regionkey").alias("region"),
        (F.col("c_nationkey") % 2).alias("half"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
    )


def intervals(
    spark: SparkSession,
    sf_dir: str,
    threshold: int = 1,
    extend: Callable[[DataFrame], DataFrame] | None = None,
    build: Callable[..., DataFrame] = panel,
) -> DataFrame:
    """Origins up to the last modelled wave; ``extend`` may add panel columns in the same windows."""
    waves = build(spark, sf_dir, threshold)
    paired = origin_destination(
        extend(waves) if extend else waves,
        "id",
        "wave",
        "functional_state",
        dead=F.col("__is_last"),
        eligible=F.col("wave") <= LAST_ORIGIN,
    )
    return paired.select(
        "*",
        interval_label(F.col("wave") + FIRST_YEAR, F.col("wave") + FIRST_YEAR + 1).alias("interval"),
        F.when(F.col("wave") % 2 == 0, 2).otherwise(1).alias("interval_years"),
    )


def person_hub(spark: SparkSession, sf_dir: str, people_per_bucket: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Panel and fixed covariates as tables in the same buckets of people.

    What follows by person (windows, checked joins, cluster scores) starts from the buckets; each table
    pays one exchange, once.
    """
    n = table(spark, sf_dir, "customer", "c_custkey").count()
    buckets = bucket_count(n, people_per_bucket, spark)
    return (
        bucketed(panel(spark, sf_dir), "person_waves", ["id"], buckets),
        bucketed(people(spark, sf_dir), "people", ["id"], buckets),
    )


def with_people(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.join(people(spark, sf_dir), "id", "left")


def observed(
    spark: SparkSession, sf_dir: str, extend: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    return intervals(spark, sf_dir, extend=extend).filter("outcome_observed = 1")


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("origin_label", label_of("functional_state", FUNCTION_LABELS)).withColumn(
        "destination_label", label_of("destination_state", FUNCTION_LABELS)
    )


def modelled(df: DataFrame) -> DataFrame:
    """Covariates in the form the models use."""
    return df.withColumn("segment_cat", as_category("segment")).withColumn(
        "balance_k", F.col("balance") / 1000
    )


# The same tables for the SQL side.
SQL_PANEL = """
panel_raw AS (
  SELECT o_custkey AS id, CAST(year(o_orderdate) - 1994 AS INTEGER) AS wave,
         count(*) AS n_orders,
         CAST(max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS INTEGER) AS a,
         CAST(CASE WHEN avg(o_totalprice) >= (SELECT median(o_totalprice) FROM orders) THEN 1 ELSE 0 END AS INTEGER) AS b,
         CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_f,
         CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS n_p,
         avg(o_totalprice) AS spend
  FROM orders GROUP BY 1, 2),
panel AS (
  SELECT id, wave, n_orders, a, b, a + 2 * b AS state, n_f, n_p,
         CASE WHEN n_f >= 1 THEN 2 WHEN n_p >= 1 THEN 1 ELSE 0 END AS functional_state, spend
  FROM panel_raw)"""

SQL_STRICT = SQL_PANEL + """,
strict AS (
  SELECT id, wave, n_orders, a, b, state, n_f, n_p,
         CASE WHEN n_f >= 2 THEN 2 WHEN n_p >= 2 THEN 1 ELSE 0 END AS functional_state, spend
  FROM panel)"""

SQL_PEOPLE = """
people AS (
  SELECT c_custkey AS id, c_mktsegment AS segment, n_regionkey AS region, c_nationkey % 2 AS half,
         CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def sql_intervals(source: str = "panel", name: str = "iv") -> str:
    return f"""
{name}_last AS (SELECT id, max(wave) AS last_wave FROM {source} GROUP BY id),
{name} AS (
  SELECT p.*, CASE WHEN p.wave = l.last_wave THEN 3 ELSE q.functional_state END AS destination_state,
         CASE WHEN p.wave = l.last_wave THEN 1 ELSE 0 END AS known_dead,
         CASE WHEN p.wave = l.last_wave OR q.id IS NOT NULL THEN 1 ELSE 0 END AS outcome_observed,
         (p.wave + 1994) || '-' || (p.wave + 1995) AS "interval",
         CASE WHEN p.wave % 2 = 0 THEN 2 ELSE 1 END AS interval_years
  FROM {source} p JOIN {name}_last l ON l.id = p.id
  LEFT JOIN {source} q ON q.id = p.id AND q.wave = p.wave + 1
  WHERE p.wave <= 5)"""


SQL_INTERVALS = SQL_PANEL + "," + sql_intervals() + """,
obs AS (SELECT * FROM iv WHERE outcome_observed = 1)"""
