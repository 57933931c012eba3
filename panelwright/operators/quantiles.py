"""Exact interpolated quantiles that never sort the data in one task.

Spark's ``percentile`` keeps a count for every distinct value in one buffer per group.
That is used while the groups are known to be small. Beyond that a mergeable sketch (KLL)
of every large group brackets the wanted order statistics in one pass: two values a
probability that the ranks lie between, but for an error that is checked. A second pass counts
the rows below each bracket and the distinct values inside, and the ranks are read off
those counts, so the result is exact. Groups may be as many as they like and stay a table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bounded import collect_bounded
from ..sources.tables import stored

SMALL_GROUP = 200_000
MAX_GROUPS = 10_000
#: Sketch size, and the share of a group's rows that a bracket reaches beyond the wanted ranks on either
#: side: about three times the sketch's error at 99 %.
SKETCH, REACH = 2048, 0.007
#: Ranks at which a sketch is read: its brackets are that much coarser.
GRID = 512
#: A bracket expected to hold more rows than this is sketched again before it is counted.
MOST_INSIDE = 4_000_000
MOST_BROADCAST = 50_000


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    small_group: int = SMALL_GROUP,
    max_groups: int = MAX_GROUPS,
) -> dict[tuple, list[float | None]]:
    """Linear-interpolation quantiles per group (one entry with key ``()`` without groups).

    What comes back is bounded: more than ``max_groups`` groups raise; ``quantile_table`` takes any number.
    """
    by = list(by)
    found = collect_bounded(quantile_table(df, column, probs, by, small_group), max_groups, "quantile groups")
    out = {tuple(r[c] for c in by): [r[f"q{i}"] for i in range(len(probs))] for r in found}
    return out if by or out else {(): [None] * len(probs)}


def quantile_table(
    df: DataFrame, column: str, probs: Sequence[float], by: Sequence[str], small_group: int = SMALL_GROUP
) -> DataFrame:
    """The same quantiles as columns q0, q1, ... of a table, for any number of groups.

    Groups of up to ``small_group`` rows are a grouped ``percentile``, larger ones are sketched.
    NULLs are left out, NaN comes last, and groups without values have no row.
    """
    by, names = list(by), [f"q{i}" for i in range(len(probs))]
    values = df.select(*(by or [F.lit(0).alias("__all")]), F.col(column).cast("double").alias("__v")).filter("__v IS NOT NULL")
    keys = by or ["__all"]
    big = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > small_group).select(*keys)
    n_big = big.count()
    rest = values
    if n_big:
        big = stored(big, "large_groups")
        rest = _matched(values, big, keys, n_big, "left_anti")
    small = rest.groupBy(*keys).agg(*[F.percentile("__v", F.lit(float(p))).alias(q) for q, p in zip(names, probs)])
    if n_big:
        large = _bracketed(_matched(values, big, keys, n_big, "left_semi"), keys, probs, n_big, REACH)
        small = small.unionByName(large.select(*keys, *names))
    return small.select(*by, *names)


def _matched(values: DataFrame, groups: DataFrame, keys: Sequence[str], n: int, how: str) -> DataFrame:
    """``values`` joined with one row per group; NULL is a key like any other."""
    side = F.broadcast(groups.alias("g")) if n <= MOST_BROADCAST else groups.alias("g")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"v.`{c}`").eqNullSafe(F.col(f"g.`{c}`"))
    joined = values.alias("v").join(side, same, how)
    if how != "inner":
        return joined
    return joined.select("v.*", *[F.col(f"g.`{c}`") for c in groups.columns if c not in keys])


def _grid(sketch: Column) -> Column:
    """A sketch's values at the ranks 0, 1/GRID, ..., 1."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))


def _bounds(i: int, grid: Column, total: Column, before: Column, low: Column, high: Column, reach: float) -> list[Column]:
    """The bracket of target i among ``total`` sketched values, of which ``before`` smaller ones are no part."""
    first, last = F.col(f"__a{i}") - before - reach * total, F.col(f"__b{i}") - before + 1 + reach * total
    below = F.floor(F.greatest(first, F.lit(0.0)) / total * GRID).cast("int")
    above = F.ceil(F.least(last, total) / total * GRID).cast("int")
    return [
        F.when(first <= 0, low).otherwise(F.get(grid, below)).alias(f"__lo{i}"),
        F.when(last >= total, high).otherwise(F.get(grid, above)).alias(f"__hi{i}"),
    ]


def _bracketed(values: DataFrame, keys: Sequence[str], probs: Sequence[float], groups: int, reach: float) -> DataFrame:
    targets = range(len(probs))
    number = F.when(~F.isnan("__v"), F.col("__v"))
    # -0.0 and 0.0 are one value to the counts and must be one to the brackets
    clean = values.withColumn("__v", F.col("__v") + F.lit(0.0))
    sketched = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count(number).alias("__m"),
        F.min(number).alias("__min"),
        F.max(number).alias("__max"),
        F.kll_sketch_agg_double(number, F.lit(SKETCH)).alias("__s"),
    )
    last = F.greatest(F.col("__m") - 1, F.lit(0))
    ranks = [
        c
        for i, p in enumerate(probs)
        for c in (
            F.least(F.floor(F.lit(float(p)) * (F.col("__n") - 1)), last).alias(f"__a{i}"),
            F.least(F.ceil(F.lit(float(p)) * (F.col("__n") - 1)), last).alias(f"__b{i}"),
        )
    ]
    ranked = sketched.select("*", F.when(F.col("__m") > 0, _grid(F.col("__s"))).alias("__q"), *ranks)
    brackets = [
        c for i in targets for c in _bounds(i, F.col("__q"), F.col("__m").cast("double"), F.lit(0), F.col("__min"), F.col("__max"), reach)
    ]
    state = stored(ranked.select("*", *brackets).drop("__s", "__q"), "quantile_brackets")
    share = 2 * (reach + 1 / GRID)
    inside = (state.agg(F.max("__m")).first()[0] or 0) * share
    while inside > MOST_INSIDE:
        state = stored(_narrowed(clean, state, keys, targets, groups, reach), "quantile_brackets")
        inside *= share
    found = stored(_counted(clean, state, keys, probs, groups), "quantiles")
    missed = found.filter("__missed").select(*keys)
    n_missed = missed.count()
    if not n_missed:
        return found
    if reach >= 1:
        raise RuntimeError("the order statistics did not lie between the ends of their groups")
    again = _bracketed(_matched(values, missed, keys, n_missed, "left_semi"), keys, probs, n_missed, min(1.0, reach * 8))
    return found.filter("NOT __missed").unionByName(again)


def _narrowed(values: DataFrame, state: DataFrame, keys, targets, groups: int, reach: float) -> DataFrame:
    """Narrower brackets, from sketches of the rows inside the present ones."""
    met = _matched(values, state, keys, groups, "inner")
    v = F.col("__v")
    sums = [
        c
        for i in targets
        for c in (
            F.count_if(v < F.col(f"__lo{i}")).alias(f"__before{i}"),
            F.count_if(v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}"))).alias(f"__in{i}"),
            F.kll_sketch_agg_double(F.when(v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}")), v), F.lit(SKETCH)).alias(f"__s{i}"),
        )
    ]
    held = [c for c in state.columns if c not in keys]
    joined = met.groupBy(*keys).agg(*[F.first(c).alias(c) for c in held], *sums)
    joined = joined.select("*", *[F.when(F.col(f"__in{i}") > 0, _grid(F.col(f"__s{i}"))).alias(f"__q{i}") for i in targets])
    kept = [c for c in held if not c.startswith(("__lo", "__hi"))]
    new = []
    for i in targets:
        before, own = F.col(f"__before{i}"), F.col(f"__in{i}").cast("double")
        lost = (before > F.col(f"__a{i}")) | (F.col(f"__b{i}") >= before + own)
        low, high = _bounds(i, F.col(f"__q{i}"), own, before, F.col(f"__lo{i}"), F.col(f"__hi{i}"), reach)
        new += [F.when(lost, F.col("__min")).otherwise(low).alias(f"__lo{i}"), F.when(lost, F.col("__max")).otherwise(high).alias(f"__hi{i}")]
    return joined.select(*keys, *kept, *new)


def _counted(values: DataFrame, state: DataFrame, keys, probs: Sequence[float], groups: int) -> DataFrame:
    """Quantiles read off exact counts: rows below each bracket, and rows by distinct value inside."""
    targets, v = range(len(probs)), F.col("__v")
    met = _matched(values, state, keys, groups, "inner")
    inside = [v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}")) for i in targets]
    # one row a group and value inside a bracket, and one for all others, which only count as below
    by_value = met.groupBy(*keys, F.when(reduce(or_, inside), v).alias("__x")).agg(
        *[F.count_if(inside[i]).alias(f"__in{i}") for i in targets],
        *[F.count_if(v < F.col(f"__lo{i}")).alias(f"__under{i}") for i in targets],
    )
    places = [
        e
        for i in targets
        for e in (
            F.struct(F.lit(i).alias("i"), F.col("__x").alias("x"), F.col(f"__in{i}").alias("c")),
            F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("x"), F.col(f"__under{i}").alias("c")),
        )
    ]
    spread = by_value.select(*keys, F.explode(F.array(*places)).alias("e")).filter("e.c > 0")
    counted = spread.groupBy(*keys, F.col("e.i").alias("__i"), F.col("e.x").alias("__x")).agg(F.sum("e.c").alias("__c"))
    # NULL, all that lies below, comes first
    running = F.sum("__c").over(Window.partitionBy(*keys, "__i").orderBy(F.asc_nulls_first("__x")))
    ranked = counted.withColumn("__cum", running)
    joined = _matched(ranked, state, keys, groups, "inner")
    first = F.lit(None).cast("long")
    second = first
    for i in targets:
        first, second = F.when(F.col("__i") == i, F.col(f"__a{i}")).otherwise(first), F.when(F.col("__i") == i, F.col(f"__b{i}")).otherwise(second)
    picked = joined.groupBy(*keys).agg(
        F.first("__n").alias("__n"),
        F.first("__m").alias("__m"),
        *[
            c
            for i in targets
            for c in (
                F.min(F.when((F.col("__i") == i) & (F.col("__cum") > first), F.struct("__cum", "__x"))).alias(f"__l{i}"),
                F.min(F.when((F.col("__i") == i) & (F.col("__cum") > second), F.struct("__cum", "__x"))).alias(f"__h{i}"),
            )
        ],
    )
    whole = state.select(*keys, F.col("__m").alias("__left")).filter("__left = 0").drop("__left")  # nothing but NaN
    missed, out = F.lit(False), []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("__n") - 1)
        end = lambda rank, value: F.when(rank >= F.col("__m"), F.lit(float("nan"))).otherwise(value)
        low, high = end(F.floor(h), F.col(f"__l{i}.__x")), end(F.ceil(h), F.col(f"__h{i}.__x"))
        missed = missed | F.col(f"__l{i}.__x").isNull() | F.col(f"__h{i}.__x").isNull()
        between = low * (F.ceil(h) - h) + high * (h - F.floor(h))  # as percentile does it, to the last digit
        out.append(F.when((h != F.floor(h)) & (low != high), between).otherwise(low).alias(f"q{i}"))
    found = picked.select(*keys, *out, missed.alias("__missed"))
    return found.unionByName(whole.select(*keys, *[F.lit(float("nan")).alias(f"q{i}") for i in targets], F.lit(False).alias("__missed")))


def quantile(df: DataFrame, column: str, prob: float) -> float | None:
    return exact_quantiles(df, column, [prob])[()][0]
