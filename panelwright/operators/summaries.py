"""Counts, rates, reports and checks. Each is one aggregation plus work on its small result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recode import flag
from .quantiles import exact_quantiles
from .reshape import stack_copies, unpivot_row
from .sequences import first_per_person


def counts_with_share(
    df: DataFrame, groups: Sequence[str], within: Sequence[str], share: str, scale: float = 1.0
) -> DataFrame:
    """Group counts and their share of the parent group; a NULL key is left out."""
    counted = df.dropna(subset=list(groups)).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*within))
    return counted.withColumn(share, F.col("n") * scale / total)


def counts_all_levels(
    df: DataFrame, column: str, levels: Sequence[str], measures: Mapping[str, Column]
) -> DataFrame:
    """Aggregates by declared level, in their order, with 0 for an empty one."""
    spark = df.sparkSession
    declared = spark.createDataFrame(
        [(i, v) for i, v in enumerate(levels)], f"level_order int, {column} string"
    )
    found = df.groupBy(column).agg(*[c.alias(n) for n, c in measures.items()])
    joined = F.broadcast(declared).join(found, column, "left")
    return joined.select(
        "level_order", column, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures]
    )


def modal_values(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent value of each column, the smallest on a tie, in one pass."""
    values = stack_copies(
        df.select(*columns),
        [{"__name": F.lit(c), "__value": F.col(c).cast("double")} for c in columns],
    ).select("__name", "__value")
    counted = (
        values.filter(F.col("__value").isNotNull())
        .groupBy("__name", "__value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = counted.groupBy("__name").agg(
        F.max(F.struct("n", (-F.col("__value")).alias("negated"))).alias("top")
    )
    return {r["__name"]: -r["top"]["negated"] + 0.0 for r in best.collect()}


def modal_label(df: DataFrame, column: str) -> object:
    """Most frequent label, the smallest on a tie; a distributed top-1."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    row = counted.orderBy(F.desc("n"), column).limit(1).collect()
    return row[0][column] if row else None


def fill_missing(
    df: DataFrame,
    mode: Sequence[str] = (),
    median: Mapping[str, str] | None = None,
    constant: Mapping[str, object] | None = None,
    scope: DataFrame | None = None,
) -> DataFrame:
    """Fill with the mode (in place), median (under a new name) or a constant.

    Fill values come from ``scope``, which is the rows given unless stated: whether that is
    people or intervals changes the answer. Each median-filled column keeps a
    ``<name>_missing`` flag.
    """
    scope = df if scope is None else scope
    out = df
    modes = modal_values(scope, list(mode)) if mode else {}
    for c in mode:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(modes.get(c))))
    for c, name in (median or {}).items():
        value = exact_quantiles(scope, c, [0.5])[()][0]
        out = out.withColumn(f"{c}_missing", F.col(c).isNull().cast("int"))
        out = out.withColumn(name, F.coalesce(F.col(c), F.lit(value)))
    for c, value in (constant or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)))
    return out


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count and percentage of each column, from one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns]
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing_n")) for c in columns]
    )
    return counted.select("__n", F.explode(rows).alias("e")).select(
        "e.variable", "e.missing_n", F.try_divide(100.0 * F.col("e.missing_n"), F.col("__n")).alias("missing_percent")
    )


def cohort_flow(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows left after each cumulative step and the part kept from the step before."""
    masks, running = [], F.lit(True)
    for _, condition in steps:
        running = running & F.coalesce(condition, F.lit(False))
        masks.append(running)
    counted = df.agg(*[F.sum(m.cast("long")).alias(f"n{i}") for i, m in enumerate(masks)])
    rows = []
    for i, (label, _) in enumerate(steps):
        kept = F.try_divide(F.col(f"n{i}"), F.col(f"n{i-1}")) if i else F.lit(None)
        rows.append(
            F.struct(
                F.lit(i + 1).alias("step_no"),
                F.lit(label).alias("step"),
                F.col(f"n{i}").alias("n"),
                kept.cast("double").alias("retained"),
            )
        )
    return counted.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def baseline_table(
    df: DataFrame,
    key: str,
    wave: str,
    group: str,
    continuous: Sequence[str],
    binary: Sequence[str],
    categorical: Mapping[str, Sequence],
) -> DataFrame:
    """Mean (SD), n and % by group at each person's first row, as long rows of numbers."""
    first = first_per_person(df, key, wave)
    measures: list[Column] = [F.count(F.lit(1)).alias("rows")]
    entries = [("Participants", F.col("rows"), F.lit(None), F.lit(None))]
    for c in continuous:
        measures += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_sd"), F.count(c).alias(f"{c}_n")]
        entries.append((c, F.col(f"{c}_n"), F.col(f"{c}_mean"), F.col(f"{c}_sd")))
    for c in binary:
        measures += [F.sum(flag(F.col(c) == 1).cast("long")).alias(f"{c}_n"), F.avg(F.when(F.col(c).isNotNull(), flag(F.col(c) == 1))).alias(f"{c}_p")]
        entries.append((c, F.col(f"{c}_n"), 100 * F.col(f"{c}_p"), F.lit(None)))
    for c, levels in categorical.items():
        for v in levels:
            n = f"{c}_{v}"
            measures.append(F.sum(flag(F.col(c) == v).cast("long")).alias(n))
            entries.append((f"{c}: {v}", F.col(n), F.try_divide(100.0 * F.col(n), F.col("rows")), F.lit(None)))
    grouped = first.groupBy(group).agg(*measures)
    rows = [
        F.struct(
            F.lit(label).alias("characteristic"),
            n.cast("long").alias("n"),
            value.cast("double").alias("mean_or_percent"),
            sd.cast("double").alias("sd"),
        )
        for label, n, value, sd in entries
    ]
    return grouped.select(group, F.explode(F.array(*rows)).alias("e")).select(group, "e.*")


def formatted(table: DataFrame) -> DataFrame:
    """The baseline table with the text a reader expects in place of its numbers."""
    text = (
        F.when(F.col("mean_or_percent").isNull(), F.col("n").cast("string"))
        .when(F.col("sd").isNull(), F.format_string("%d (%.1f%%)", "n", "mean_or_percent"))
        .otherwise(F.format_string("%.2f (%.2f)", "mean_or_percent", "sd"))
    )
    return table.withColumn("value", text)


def quality_checks(df: DataFrame, key: Sequence[str], person: str, checks: Mapping[str, Column]) -> DataFrame:
    """Counts that should be 0 (or describe the table), as (check, value) rows."""
    repeated = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.sum(flag(c).cast("long")).alias(n) for n, c in checks.items()],
    )
    totals = repeated.agg(
        F.sum("__n").alias("rows"),
        F.countDistinct(person).alias("people"),
        F.sum(F.col("__n") - 1).alias("duplicate_keys"),
        *[F.sum(n).alias(n) for n in checks],
    )
    return unpivot_row(totals, totals.columns, "check", "value")


def group_rates(
    df: DataFrame, groups: Sequence[str], event: Column, person: str, rate: str = "rate"
) -> DataFrame:
    """Intervals, people, events and the crude event rate by group."""
    counted = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("intervals"),
        F.countDistinct(person).alias("people"),
        F.sum(flag(event).cast("long")).alias("events"),
    )
    return counted.withColumn(rate, F.try_divide(F.col("events"), F.col("intervals")))


def weight_summary(df: DataFrame, weight: str, below: tuple[str, float] | None = None) -> DataFrame:
    """Mean, SD, range and quantiles of a weight; share of a column below a bound."""
    p01, p50, p99 = exact_quantiles(df, weight, [0.01, 0.5, 0.99])[()]
    parts = [
        F.count(weight).alias("n"),
        F.avg(weight).alias("mean"),
        F.stddev_samp(weight).alias("sd"),
        F.min(weight).alias("min"),
        F.max(weight).alias("max"),
    ]
    if below:
        parts.append(F.avg(flag(F.col(below[0]) < below[1])).alias("share_below"))
    described = df.agg(*parts)
    for name, value in (("p01", p01), ("median", p50), ("p99", p99)):
        described = described.withColumn(name, F.lit(value))
    return described


def weight_truncation(df: DataFrame, weight: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The bounds that a weight is held within, how many rows lie beyond each, and how many there are."""
    lo, hi = exact_quantiles(df, weight, [low, high])[()]
    return df.agg(
        F.lit(lo).alias("low"),
        F.lit(hi).alias("high"),
        F.count(weight).alias("n"),
        F.count_if(F.col(weight) < F.lit(lo)).alias("n_below"),
        F.count_if(F.col(weight) > F.lit(hi)).alias("n_above"),
        F.count_if((F.col(weight) < F.lit(lo)) | (F.col(weight) > F.lit(hi))).alias("truncated_n"),
    )


def transition_totals(
    df: DataFrame, origin: str, destination: str, length: str, weight: str, groups: Sequence[str] = ()
) -> DataFrame:
    return df.groupBy(*groups, origin, destination, length).agg(F.sum(weight).alias("weight"))


def person_time_rates(
    df: DataFrame,
    origin: str,
    destination: str,
    length: str,
    weight: str,
    states: int,
    floor: float = 0.002,
    groups: Sequence[str] = (),
) -> DataFrame:
    """Weighted events over weighted time at risk for every move out of a living state.

    States 0..states-1 are living and ``states`` is absorbing. Time below 1 counts as 1.
    """
    totals = transition_totals(df, origin, destination, length, weight, groups)
    moved = [F.sum(F.when(F.col(destination) == j, F.col("weight")).otherwise(0.0)).alias(f"to{j}") for j in range(states + 1)]
    by_origin = totals.groupBy(*groups, origin).agg(
        F.sum(F.col("weight") * F.col(length)).alias("person_time"), *moved
    )
    rows = F.array(*[F.struct(F.lit(j).alias(destination), F.col(f"to{j}").alias("events")) for j in range(states + 1)])
    long = by_origin.select(*groups, origin, "person_time", F.explode(rows).alias("e"))
    long = long.select(*groups, origin, "e.*", "person_time").filter(F.col(origin) != F.col(destination))
    rate = F.greatest(F.col("events") / F.greatest(F.col("person_time"), F.lit(1.0)), F.lit(floor))
    return long.withColumn("initial_rate", rate)


def gate(checks: DataFrame, rules: Mapping[str, Column], passed: str = "CONTINUE", failed: str = "STOP") -> DataFrame:
    """Named rules over a one-row table, and the decision they give together."""
    verdict = F.lit(True)
    for rule in rules.values():
        verdict = verdict & F.coalesce(rule, F.lit(False))
    named = [F.coalesce(rule, F.lit(False)).alias(n) for n, rule in rules.items()]
    return checks.select("*", *named, F.when(verdict, passed).otherwise(failed).alias("decision"))
